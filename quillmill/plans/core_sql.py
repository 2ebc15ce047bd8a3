"""SQL counterparts of the core's layouts, path predicates and intent filters."""

from __future__ import annotations

from .extended_sql import FENCE, by_map
from .oracles import CONCEPTS, EDGES, FILES, HYGIENE, q, relevance

NOISE = {
    "business_logic": ("test_ _test log_ debug_ mock_", "testing logging configuration", 0.2), "debugging": ("test_ _test", "testing", 0.1), "onboarding": ("mock_ _mock stub_ fake_ internal_ __", "testing logging", 0.25),
    "security_review": ("test_ _test mock_", "testing", 0.1), "migration": ("test_", "testing", 0.2),
}


def quiet(intent: str) -> str:
    names, concepts, _ = NOISE[intent]
    return "not (" + " or ".join(f"contains(lower(name), {q(n)})" for n in names.split()) + f") and concept not in ({', '.join(map(q, concepts.split()))})"


def escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


#: Nodes on or behind a cycle, which an order by removal of what nobody points to never reaches.
BEHIND = f"""{EDGES}, cl as (select src as a, dst as b from ed union select cl.a, ed.dst from cl join ed on ed.src = cl.b), cy as (select distinct a as id from cl where a = b), be as (select id from cy union select b from cl join cy on cl.a = cy.id)"""


def graphs_and_plugins() -> dict[str, str]:
    lines = "string_split(content, chr(10))"
    longest = f"list_max(list_transform({lines}, lambda x: length(x)))"
    deepest = f"list_max(list_transform({lines}, lambda x: length(regexp_extract(x, '^\\s*')) // 4))"
    module = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:\{[^}]*\}\s+from\s+)?[\"']?([\w./-]+)[\"']?|use\s+([\w:]+))"
    return {
        "graph_cycles": f"with recursive {BEHIND} select count(*) as edges_left, count(*) > 0 as cyclic from ed where src in (select id from be)",
        "graph_toposort": f"""with recursive {BEHIND}, n as (select src as id from ed union select dst from ed), w as (select id, 0 as level from n where id not in (select dst from ed) union select ed.dst, w.level + 1 from w join ed on ed.src = w.id where ed.dst not in (select id from be)),
            l as (select id, max(level) as level from w group by 1) select level, count(*) as nodes from l group by 1""",
        "plugin_metric": f"with {FILES} select 'longest_line' as plugin, count(*) as files, max({longest})::double as most from f union all select 'nesting', count(*), max({deepest})::double from f",
        "plugin_tags": f"with {FILES} select tag, count(*) as files from f, (values ('TODO'), ('FIXME'), ('HACK')) t(tag) where contains(content, tag) group by 1",
        "import_modules": f"""with {FILES}, m as (select file_id, unnest(regexp_extract_all(content, {q(module)})) as x from f), g as (select distinct file_id, case when regexp_extract(x, {q(module)}, 1) <> '' then regexp_extract(x, {q(module)}, 1) when regexp_extract(x, {q(module)}, 2) <> '' then regexp_extract(x, {q(module)}, 2) when regexp_extract(x, {q(module)}, 3) <> '' then regexp_extract(x, {q(module)}, 3) end as module from m)
            select module, count(*) as files from g group by 1""",
    }


def core() -> dict[str, str]:
    small = "case when lower(compression_level) = 'skeleton' then ' [SKELETON]' || case when original_tokens is not null then ' (original: ' || original_tokens || ' tokens)' else '' end else '' end"
    nl = "chr(10)"
    body = r"case when content = '' then '' else array_to_string(list_transform(string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n'), lambda x: '+ ' || x || chr(10)), '') end"
    attrs = """case when lower(compression_level) = 'skeleton' then ' skeleton="true"' || case when original_tokens is not null then ' original_tokens="' || original_tokens || '"' else '' end else '' end"""
    base = "from processed_files where content is not null"
    source = r"regexp_extract(path, '\.([^./]+)$', 1) in ('rs','py','js','ts','tsx','jsx','go','java','c','cpp','h','hpp','rb','php','swift','kt','scala','cs','fs','vb','lua','pl','pm')"
    test = "(contains(lower(path), 'test') or contains(lower(path), 'spec'))"
    clean = f"len(list_filter(string_split(path, '/'), lambda c: c in ({','.join(map(q, HYGIENE))}) or ends_with(c, '.egg-info') or ends_with(c, '.swp') or ends_with(c, '.swo') or ends_with(c, '.pyc'))) = 0"
    return graphs_and_plugins() | {
        "render_core_plusminus": f"select proc_id, md5('+++ ' || path || {small} || {nl} || {body} || '--- ' || path || ' [md5:' || coalesce(md5, '') || ']' || {nl} || {nl}) as digest {base}",
        "render_core_xml": f"""select proc_id, md5('<file path="' || {escaped('path')} || '" md5="' || coalesce(md5, '') || '" language="' || coalesce(language, '') || '"' || {attrs} || '>' || {nl} || {escaped('content')} || {nl} || '</file>' || {nl}) as digest {base}""",
        "render_core_markdown": f"select proc_id, md5('## ' || path || {small} || {nl} || {nl} || '```' || {by_map(FENCE, '')} || {nl} || content || case when ends_with(content, {nl}) then '' else {nl} end || '```' || {nl} || {nl}) as digest {base}",
        "path_predicates": f"with {FILES} select file_id, {source} as is_source, {test} as is_test, {source} and len(string_split(path, '/')) <= 3 and {clean} and not {test} as explorable from f",
        "noise_by_intent": f"with {CONCEPTS} select * from (" + " union all ".join(f"select {q(k)} as intent, count(*) as n from cc where name is not null and {quiet(k)} and {relevance(k)} >= {v[2]}" for k, v in NOISE.items()) + ") where n > 0",
        "concept_filters": f"with {CONCEPTS} select concept_no, language, concept from cc where language in ('python', 'rust') and concept in ('calculation', 'validation', 'decision') and contains(lower(name), 'e')",
        "intent_pipeline": f"""with {CONCEPTS}, s as (select concept_no, concept, name, {relevance('debugging')} as score from cc where name is not null)
            select concept_no, concept, score, case when score < 0.2 then 'skip' when score >= 0.6 then 'read' else 'skim' end as decision from s where {quiet('debugging')} and score >= 0.2 order by score desc, concept_no limit 30""",
    }
