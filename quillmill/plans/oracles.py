"""SQL counterparts of the queries, for DuckDB over the same tables.

Tables, word lists and patterns are written down here once more and not taken from the
operators, so that an error in one place shows as a difference.
"""

from __future__ import annotations

# What the SQL states by itself: languages by extension.
LANGUAGE_BY_EXTENSION = dict(x.split(":") for x in "rs:rust py:python js:javascript jsx:javascript ts:typescript tsx:typescript go:go java:java c:c h:c cpp:cpp hpp:cpp rb:ruby php:php sh:shell bash:shell md:markdown json:json yaml:yaml yml:yaml toml:toml html:html css:css sql:sql".split())
NAME_FRAGMENTS = "calculate_ calc_ _calc validate_ check_ _validate get_ fetch_ _get process_ handle_ _process is_ has_ can_".split()
MANIFESTS = "cargo.toml package.json pyproject.toml setup.py go.mod pom.xml build.gradle composer.json gemfile requirements.txt pipfile".split()
TEST_PATH = r"(^|/)(tests|test|examples|benches)/|(^|/)test_[^/]*$|_test\.(py|rs|go)$|\.(test|spec)\.(js|ts)$"
CORE_PATH = "(^|/)(src|lib|pkg|internal|app|core)/"
HYGIENE = ".git .hg .svn node_modules .npm .yarn .venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache .eggs target dist build out _build .build .idea .vscode .DS_Store Thumbs.db".split()
DEFINITION = r"^\s*(?:(?:pub(?:\([a-z]+\))?|export|default|async|static|unsafe|const)\s+)*(fn|def|func|function|class|struct|enum|trait|impl|interface|type)\b"
LINE_COMMENT = r"^\s*(?://|#[^\[]|#$|--|;)"
STRUCTURE = r"^\s*(?:(?:import|from|use|package|mod|class|def|async def|fn|pub|func|function|export|struct|enum|trait|impl|interface|type)\b|@|#\[)"
NO_CALLS = "if for while switch match return catch fn def function func class super sizeof typeof print println len range str int isinstance assert vec format".split()
# Groups of lenses, greatest priority first.
LENSES = {
    "architecture": ("*.py=100 rust/src/**/*.rs=100 **/*.rs=95 Cargo.toml=90 pyproject.toml=90 *.toml=85 *.json=80 *.yaml=80 *.yml=80 Makefile=75 Dockerfile=70 README.md=65 *.ts=60 *.tsx=60 *.js=55 *.jsx=55", 50),
    "debug": ("*.py=100 *.rs=100 *.js=90 *.ts=90 tests/**=85 test/**=85", 50),
    "security": ("*auth*=100 *secret*=100 *credential*=100 *password*=100 *token*=98 *security*=95 *crypto*=95 *encrypt*=95 *.env*=92 package.json=90 requirements.txt=90 Cargo.toml=90 go.mod=90 Gemfile=90 *config*=88 *settings*=88 package-lock.json=85 Cargo.lock=85 **/server/**=80 **/api/**=80 **/routes/**=78 **/handlers/**=78 **/middleware/**=76 *handler*=75 *endpoint*=75 *parse*=72 *input*=70 *valid*=70 *sanitize*=70 Dockerfile=65 docker-compose*.yml=65 *.yaml=55 *.yml=55 *.rs=45 *.py=45 *.js=40 *.ts=40 tests/**=35 test/**=35", 25),
    "onboarding": ("README.md=100 CONTRIBUTING.md=98 CLAUDE.md=97 CHANGELOG.md=95 *.md=90 Cargo.toml=88 package.json=88 pyproject.toml=88 Makefile=85 Dockerfile=80 **/main.rs=75 **/lib.rs=75 **/main.py=75 **/index.js=75 **/index.ts=75 **/mod.rs=70 *.toml=65 *.yaml=60 *.yml=60 *.json=55 tests/**=40 test/**=40 *.rs=35 *.py=35 *.js=30 *.ts=30", 20),
}
# Concepts of names in the order of the rules, then of documentation.
NAME_RULES = [
    ("testing", "^test_|_test$|_spec|_tests"), ("error_handling", "handle_error|on_error|_error|recover|^err_|_err$"), ("validation", "validate|check_|is_valid|^is_|^has_|verify|ensure"),
    ("logging", "^log_|logger|_log|trace|debug_|metric|telemetry"), ("configuration", "^config|_config|settings|options|params|builder|_opts$"), ("calculation", "calculate|compute|_total|_sum|_avg|_count|score|_price|_cost|estimate|eval"),
    ("transformation", "transform|convert|map_|_to_|into_|from_|parse|serialize|deserialize|encode|decode"), ("decision", "decide|route|dispatch|should_|select|choose|pick|match_|filter|when_|^(main|run|start|execute|process)$|^handle_"),
    ("infrastructure", "connect|socket|http|network|database|db_|file_|fs_|io_|read_file|write_file|send_|recv_|fetch"),
]
DOC_RULES = [("calculation", "calculate|compute|score"), ("validation", "validate|check|verify"), ("transformation", "transform|convert|parse"), ("error_handling", "error|handle|recover"), ("configuration", "config|setting|option"), ("decision", "entry point|main|start")]
# Concept weights of intents; documentation and visibility boosts; thresholds to skip and to read; bounds of a plan.
WEIGHTS = {
    "business_logic": "calculation 1.0 validation 0.9 decision 0.85 transformation 0.7 error_handling 0.4 logging 0.1 configuration 0.2 infrastructure 0.2 testing 0.05 unknown 0.5",
    "debugging": "error_handling 1.0 logging 0.9 validation 0.7 decision 0.6 calculation 0.5 transformation 0.5 configuration 0.4 infrastructure 0.3 testing 0.2 unknown 0.4",
    "onboarding": "decision 1.0 calculation 0.8 configuration 0.7 validation 0.6 transformation 0.5 error_handling 0.4 infrastructure 0.3 logging 0.2 testing 0.3 unknown 0.4",
    "security_review": "validation 1.0 error_handling 0.9 configuration 0.8 infrastructure 0.7 decision 0.6 transformation 0.5 calculation 0.4 logging 0.3 testing 0.1 unknown 0.5",
    "migration": "infrastructure 1.0 configuration 0.9 error_handling 0.7 transformation 0.6 validation 0.5 calculation 0.4 decision 0.4 logging 0.3 testing 0.1 unknown 0.5",
}
BOOSTS = {"business_logic": (0.15, 0.1), "debugging": (0.1, 0.05), "onboarding": (0.25, 0.15), "security_review": (0.1, 0.15), "migration": (0.1, 0.1)}
LIMITS = {"business_logic": (0.3, 0.7), "debugging": (0.2, 0.6), "onboarding": (0.2, 0.5), "security_review": (0.3, 0.7), "migration": (0.2, 0.6)}
# Positions 8 to 35 of a symbol's vector: what is looked at, for what, and its value.
SEMANTIC = [("text", x, 0.9) for x in ("error|exception|result|try", "valid|check|assert|verify", "process|transform|convert|parse", "read|write|file|stream", "calc|compute|sum|count", "init|new|create|build", "clean|close|drop|free", "config|setting|option|param", "async|await|thread|spawn")]
SEMANTIC += [("lower_name", "^(get|is_|has_)", 0.9), ("lower_name", "^(set|update|modify)", 0.9)]
SEMANTIC += [("text", x, 0.9) for x in ("add|remove|push|pop|insert|delete", "find|search|lookup|query", "format|display|render|to_string", "test|mock|expect|assert", "helper|util|misc")]
BEHAVIOURAL = [
    ("not text", "mut|write|set|modify", 0.7), ("text", "mut", 0.9), ("signature", "Result|Option", 0.9), ("signature", "Fn|fn\\(|callback", 0.9), ("signature", "<.*>|>.*<", 0.9), ("signature", "^pub ", 0.9), ("not signature", "self", 0.9),
    ("name", "^(new$|default$|from_|with_)", 0.9), ("name", "^(drop|close|cleanup)$", 0.9), ("iterator", "", 0.9), ("name", "^(fmt|clone$|default$|eq$|cmp$)", 0.9), ("name", "^(to_|into_|as_|from_)", 0.9),
]
BUDGET = 50_000


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FILES = "f as (select * exclude (path), regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path from file_entries where content is not null)"
EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"
LANG = "case " + EXT + " " + " ".join(f"when {q(k)} then {q(v)}" for k, v in LANGUAGE_BY_EXTENSION.items()) + " else 'text' end"
TOP = "coalesce(list_filter(string_split(path, '/'), lambda c: not contains(c, '.'))[1], 'root')"
PARENT = "regexp_extract(path, '^((?s:.*))/[^/]*$', 1)"
P = "lower(path)"
TIER = f"case when regexp_extract({P}, '([^/]*)$', 1) in ({','.join(map(q, MANIFESTS))}) or regexp_matches({P}, '/configs?/|\\.(?:toml|yaml|yml)$') or (ends_with({P}, '.json') and not contains({P}, '/test')) then 'config' when regexp_matches({P}, {q(TEST_PATH)}) then 'tests' when regexp_matches({P}, {q(CORE_PATH)}) then 'core' else 'other' end"
RANK = f"case {TIER} when 'core' then 0 when 'config' then 1 when 'tests' then 2 else 3 end"
COST = "(strlen(content) // 4 + (70 + 2 * strlen(path)) // 4)"
BASE = "regexp_extract(path, '([^/]*)$', 1)"


def simple(text: str, pattern: str) -> str:
    stars = pattern.count("*")
    if pattern[:2] == "*.":
        return f"ends_with({text}, {q(pattern[1:])})"
    if stars == 2 and pattern[0] == pattern[-1] == "*":
        return f"contains({text}, {q(pattern[1:-1])})"
    if stars == 1:
        a, b = pattern.split("*")
        return f"(starts_with({text}, {q(a)}) and ends_with({text}, {q(b)}))"
    return f"({text} = {q(pattern)})"


def lens_match(pattern: str) -> str:
    if pattern.startswith("**/") and pattern.endswith("/**"):
        return f"(contains(path, {q('/' + pattern[3:-3] + '/')}) or starts_with(path, {q(pattern[3:-3] + '/')}))"
    if pattern.startswith("**/"):
        return simple(BASE, pattern[3:])
    if pattern.endswith("/**"):
        return f"(starts_with(path, {q(pattern[:-2])}) or path = {q(pattern[:-3])})"
    if "/**/" in pattern:
        return f"(starts_with(path, {q(pattern.split('/**/')[0] + '/')}) and {simple(BASE, pattern.split('/**/')[1])})"
    own = simple("path", pattern)
    return own if pattern.startswith("*") else f"({own} or {simple(BASE, pattern)})"


def lens(name: str) -> str:
    groups, fallback = LENSES[name]
    return "case " + " ".join(f"when {lens_match(g.split('=')[0])} then {g.split('=')[1]}" for g in sorted(groups.split(), key=lambda g: -int(g.split("=")[1]))) + f" else {fallback} end"


LINES = "string_split(content, chr(10))"
STRUCT_LINES = f"list_filter({LINES}, lambda x: regexp_matches(x, {q(STRUCTURE)}))"
REDUCED_TEXT = f"array_to_string(case when len({STRUCT_LINES}) > 0 then {STRUCT_LINES} else {LINES}[1:20] end, chr(10))"
REDUCED = f"(strlen({REDUCED_TEXT}) // 4 + (70 + 2 * strlen(path)) // 4)"
GROUPED = f"case when ends_with(path, '.py') or ends_with(path, '.rs') then {REDUCED} else {COST} end"
EXPLODED = "x as (select file_id, repo_id, path, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from f)"
SYMBOL = DEFINITION + r"\s+([A-Za-z_]\w*)"
SYMBOLS = f"sy as (select file_id, repo_id, path, line_no, regexp_extract(line, {q(SYMBOL)}, 1) as kind, regexp_extract(line, {q(SYMBOL)}, 2) as name from x where regexp_matches(line, {q(SYMBOL)}))"
CALLS = f"""ca as (select distinct file_id, callee from (select file_id, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) as callee from x
    where not regexp_matches(line, {q(LINE_COMMENT)}) and not regexp_matches(line, {q(DEFINITION)})) where callee not in ({','.join(map(q, NO_CALLS))}))"""
CALLEES = "ci as (select callee, count(*) as callers from ca group by 1)"
DEFINED = "de as (select name, count(*) as definitions, min(file_id) as file_id from sy where kind in ('fn', 'def', 'func', 'function') group by 1)"
EVENTS = "ev as (select * from change_events qualify row_number() over (partition by event_no order by seen_ts, ts) = 1)"
CHURN = """ch as (select repo_id, path, count(*) as changes, count(*) filter (ts > n - interval 30 day) as n30, count(*) filter (ts > n - interval 90 day) as n90, count(*) filter (ts > n - interval 365 day) as n365,
    greatest(date_sub('day', min(ts), max(n)), 0) as age_days, greatest(date_sub('day', max(ts), max(n)), 0) as dormant_days, cast(sum(coalesce(lines_added, 0)) as bigint) as added, cast(sum(coalesce(lines_removed, 0)) as bigint) as removed
    from ev, (select max(ts) as n from ev) group by 1, 2)"""
CLASS = "case when {a} > 30 then 'supernova' when {b} > 10 then 'high' when {b} > 3 then 'moderate' when {b} > 0 then 'low' else 'dormant' end"
MEMBERS = """me as (select e.repo_id, c.file_id, c.language, greatest(end_line - start_line + 1, 0) as lines, coalesce(strlen(trim(documentation)) > 0, false) as documented,
    coalesce(is_deprecated, false) as deprecated, coalesce(len(dependencies), 0) as deps from concepts c join file_entries e using (file_id))"""
CENSUS = """ce as (select file_id, count(*) as callables, cast(coalesce(sum(lines), 0) as bigint) as lines, count(*) filter (documented) as documented, count(*) filter (deprecated) as deprecated, count(*) filter (lines > 50) as large,
    cast(coalesce(max(deps), 0) as bigint) as max_deps, round(count(*) * 1000.0::double / greatest(coalesce(sum(lines), 0), 1), 4) as density, round(count(*) filter (documented)::double / count(*), 4) as doc_ratio from me group by 1)"""
CONCEPT = "case " + " ".join(f"when regexp_matches(lower(name), {q(r)}) then {q(k)}" for k, r in NAME_RULES) + " " + " ".join(f"when regexp_matches(lower(coalesce(documentation, '')), {q(r)}) then {q(k)}" for k, r in DOC_RULES) + " when visibility = 'public' then 'calculation' else 'infrastructure' end"


def relevance(intent: str) -> str:
    words = WEIGHTS[intent].split()
    weight = "case concept " + " ".join(f"when {q(k)} then {v}" for k, v in zip(words[::2], words[1::2])) + " else 0.3 end"
    doc, public = BOOSTS[intent]
    return f"""round(greatest(0.0, least(1.0, 0.6 * ({weight})::double + case when documentation is null then 0.0 when strlen(documentation) > 50 then {doc} else {doc}::double / 2 end::double
        + case when visibility = 'public' then {public} else -0.05 end::double + case when lines < 5 then -0.1 when lines <= 30 then 0.1 when lines <= 100 then 0.0 else -0.1 end::double
        + case when strlen(name) < 4 then -0.05 when strlen(name) <= 30 and regexp_matches(name, '[_A-Z]') then 0.05 else 0.0 end::double)), 4)"""


CONCEPTS = f"""c0 as (select *, {CONCEPT} as concept, greatest(end_line - start_line + 1, 0) as lines from concepts),
    cc as (select *, {relevance('business_logic')} as score from c0)"""
_normal = "lower(substr(name, 1, 1) || regexp_replace(substr(name, 2), '([A-Z])', '_\\1', 'g'))"
for _f in NAME_FRAGMENTS:
    _normal = f"replace({_normal}, {q(_f)}, '')"
NORMAL = f"regexp_replace(regexp_replace({_normal}, '__+', '_', 'g'), '^_+|_+$', '', 'g')"
EDGES = "ed as (select distinct src, dst from (select concept_id as src, unnest(dependencies) as dst from concepts) where src is not null and dst is not null and src <> dst)"
HIER = """h as (select 'r' || r_regionkey as id, null as parent_id, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
    union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer)"""
LONG = "lo as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as dim from embeddings)"
OBSERVER = "lower(trim(observer_email))"
AFTER = "[\\t\\r]"


def greedy(cost: str, columns: str, reduced: bool) -> str:
    """Sequential greedy pass as a recursion over ranked rows."""
    fits = "case when cost <= left_ then cost when reduced <= left_ then reduced end" if reduced else "case when cost <= left_ then cost end"
    return f"""with recursive {FILES},
        ranked as materialized (select file_id, {cost} as cost, {REDUCED if reduced else '0'} as reduced, row_number() over (order by {RANK}, -{lens('architecture')}, path, file_id) as r from f),
        walk as (select 0::bigint as r, null::bigint as file_id, {BUDGET}::bigint as left_, null::bigint as took, null::varchar as method
            union all select k.r, k.file_id, w.left_ - coalesce({fits}, 0), {fits}, case when cost <= left_ then 'full' else 'reduced' end from walk w join ranked k on k.r = w.r + 1)
        select {columns} from walk where took is not null"""


def nearest(score: str, order: str) -> str:
    return f"""with p as (select a.vec_id as query, b.vec_id, {score} as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
        r as (select query, row_number() over (partition by query order by score {order}, vec_id) as rank, score from p)
        select query, rank, round(score, 5) as score from r where rank <= 10"""


COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))))"
EUC = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))))"
MAN = "list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double)))"
CENTER = f"{LONG}, ce as (select label, dim, avg(x) as m from lo group by 1, 2), di as (select vec_id, lo.label, sqrt(sum((x - m) * (x - m))) as d from lo join ce using (label, dim) group by 1, 2)"


def symbol_vectors() -> str:
    """Union of one select for every position that a concept can have."""
    at = {0: "0.1", 2: "least(ln / 100.0::double, 1.0)", 3: "least(deps / 20.0::double, 1.0)", 4: "1.0", 6: "case when ln < 10 then 1.0 else 0.0 end", 7: "case when ln > 50 then 1.0 else 0.0 end"}
    for i, (what, pattern, value) in enumerate(SEMANTIC + BEHAVIOURAL, 8):
        column = {"text": "t", "name": "name", "lower_name": "lower(name)", "signature": "''"}.get(what.removeprefix("not "), "''")
        test = "name in ('iter', 'next')" if what == "iterator" else f"{'not ' if what.startswith('not') else ''}regexp_matches({column}, {q(pattern)})"
        at[i] = f"case when {test} then {value} else 0.0 end"
    at |= {36: "least(strlen(name) / 50.0::double, 1.0)", 37: "case when contains(name, '_') then 1.0 else 0.0 end", 38: "case when name <> upper(name) and name <> lower(name) and not contains(name, '_') then 1.0 else 0.0 end", 39: "case when regexp_matches(name, '^[A-Z_]*$') then 1.0 else 0.0 end"}
    at |= {40: "case when documentation is not null then 1.0 else 0.0 end", 41: "least(strlen(coalesce(documentation, '')) / 500.0::double, 1.0)", 42: "case when regexp_matches(name, '[0-9]$') then 1.0 else 0.0 end", 43: "case when regexp_matches(name, '^(?:get|set|is|has|on|do)_') then 1.0 else 0.0 end"}
    base = "with b as (select concept_no, coalesce(name, '') as name, documentation, greatest(end_line - start_line, 0) as ln, coalesce(len(dependencies), 0) as deps, lower(coalesce(name, '') || '  ' || coalesce(documentation, '')) as t from concepts)"
    parts = " union all ".join(f"select concept_no, {i}::int as position, ({x})::double as value from b" for i, x in at.items())
    return f"{base} select concept_no, position, round(value, 6) as value from ({parts}) where value <> 0"


def oracle_sql() -> dict[str, str]:
    esc = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    body = "case when ends_with(content, chr(10)) then content else content || chr(10) end"
    lines_ = "string_split(regexp_replace(content, '\\n$', ''), chr(10))"
    n40 = f"len({LINES})"
    counts = f"""lc as (select file_id, {LANG} as language, case when content = '' then 0 else len({lines_}) end as total,
        case when content = '' then 0 else len(list_filter({lines_}, lambda x: trim(regexp_replace(x, '{AFTER}', '', 'g')) = '')) end as blank,
        case when content = '' then 0 else len(list_filter({lines_}, lambda x: regexp_matches(x, {q(LINE_COMMENT)}))) end as comment from f)"""
    risk = f"""de as (select repo_id, path, max(len(regexp_extract_all(content, 'TODO|FIXME|no qa|XXX')) * 50.0::double / greatest(strlen(content), 1)) as debt from f group by 1, 2),
        cn as (select repo_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path, sum(n365) as n from ch group by 1, 2),
        ri as (select repo_id, path, n, coalesce(debt, 0.0) as debt from cn left join de using (repo_id, path))"""
    human = "strlen(content)"
    return {
        "scan_size_filter": f"with {FILES} select file_id, strlen(content) as bytes from f where strlen(content) <= 2000",
        "decode_line_ends": f"with {FILES} select file_id, md5(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as md5 from f",
        "hash_md5": f"with {FILES} select file_id, md5(content) as md5, coalesce(lower(md5) = md5(content), false) as agrees from f",
        "hash_sha256_path": f"with {FILES} select file_id, sha256(path) as path_hash from f",
        "lang_by_extension": f"with {FILES} select file_id, {LANG} as language from f",
        "parent_dir": f"with {FILES} select file_id, {PARENT} as parent from f",
        "top_dir": f"with {FILES} select {TOP} as top, count(*) as files from f group by 1",
        "glob_include_exclude": f"""with {FILES} select file_id, 'include' as rule from f where starts_with(path, 'src/') or regexp_matches(path, '\\.py(/|$)') or regexp_matches(path, '^src/.*\\.rs(/|$)')
            union all select file_id, 'ignore' from f where not regexp_matches(path, '\\.json(/|$)') and not regexp_matches(path, '(^|/)tests(/|$)') and not regexp_matches(path, '^src/.*\\.go(/|$)')""",
        "hygiene_filter": f"with {FILES} select file_id, path from f where len(list_filter(string_split(path, '/'), lambda c: c in ({','.join(map(q, HYGIENE))}) or ends_with(c, '.egg-info') or ends_with(c, '.swp') or ends_with(c, '.swo') or ends_with(c, '.pyc'))) = 0",
        "tier_classify": f"with {FILES} select file_id, {TIER} as tier from f",
        "token_estimate": "select doc_id, strlen(text) // 4 as tokens from documents",
        "file_cost": f"with {FILES} select file_id, {COST} as cost from f",
        "human_bytes": f"with {FILES} select file_id, case when {human} < 1024 then {human} || 'B' when {human} < 1048576 then printf('%.1f', {human} / 1024.0::double) || 'K' else printf('%.1f', {human} / 1048576.0::double) || 'M' end as size_text from f",
        "metadata_suffix": f"with {FILES} select file_id, concat_ws(' ', case when strlen(content) > 10000 then 'size=' || strlen(content) end, case when (1735689600 - mtime) / 86400.0::double < 30 or (1735689600 - mtime) / 86400.0::double > 1825 then 'mtime=' || mtime end) as suffix from f",
        "escape_xml": f"select doc_id, md5({esc.format('text')}) as md5 from documents where text is not null",
        "lens_priority_max": f"with {FILES} select file_id, cast({lens('architecture')} as int) as architecture, cast({lens('debug')} as int) as debug, cast({lens('security')} as int) as security from f",
        "priority_blend": f"""with {FILES}, l as (select repo_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path, max(utility) as learned from processed_files where utility is not null group by 1, 2)
            select file_id, cast(round({lens('architecture')} * 0.7::double + coalesce(learned, 0.5) * 100 * 0.3::double) as bigint) as priority from f left join l using (repo_id, path)""",
        "budget_strings": "select vector_id, (input_budget // 1000) * 1000 as budget from budget_vectors",
        "sort_topk_files": f"with {FILES} select file_id, path, mtime from f where mtime is not null order by mtime desc, path, file_id limit 100",
        "budget_greedy_drop": greedy(GROUPED, "file_id, took as cost", False),
        "budget_hybrid": greedy(f"case when {GROUPED} > {BUDGET // 10} then {REDUCED} else {GROUPED} end", "file_id, method, took as cost", True),
        "budget_adaptive_drop": f"""with {FILES}, a as (select file_id, {TIER} as tier, {REDUCED} as cost from f),
            b as (select *, sum(cost) over (order by case tier when 'other' then 0 when 'tests' then 1 when 'config' then 2 else 3 end, file_id) - cost as gone, sum(cost) over () as total from a)
            select file_id, tier, cost from b where total - gone > {BUDGET}""",
        "budget_report": f"select count(*) as kept, cast(sum(cost) as bigint) as used, round(sum(cost) / {BUDGET}::double * 100, 4) as used_percent, cast({BUDGET} - sum(cost) as bigint) as remaining from ({greedy(GROUPED, 'file_id, took as cost', False)})",
        "budget_by_tier": f"with {FILES} select {TIER} as tier, count(*) as files, cast(sum({COST}) as bigint) as cost, max({COST}) as largest from f group by 1",
        "attention_tiers": """select case when coalesce(truncated, false) and coalesce(priority, 50) < 80 then 'cold' when coalesce(priority, 50) >= 95 or coalesce(utility, 0.0) > 0.8 then 'critical' when coalesce(priority, 50) >= 80 then 'high' else 'normal' end as attention,
            count(*) as files, cast(sum(coalesce(tokens, 0)) as bigint) as tokens from processed_files group by 1""",
        "render_plusminus": f"with {FILES} select file_id, md5('++++++++++ ' || path || ' ++++++++++' || chr(10) || {body} || '---------- ' || path || ' ' || md5(content) || ' ' || path || ' ----------' || chr(10)) as md5 from f",
        "render_xml": f"with {FILES} select file_id, md5('<file path=\"' || {esc.format('path')} || '\" md5=\"' || md5(content) || '\"><![CDATA[' || chr(10) || replace(content, ']]>', ']]]]><![CDATA[>') || chr(10) || ']]></file>' || chr(10)) as md5 from f",
        "render_markdown": f"with {FILES} select file_id, md5('## ' || path || chr(10) || chr(10) || '```' || {LANG} || chr(10) || content || chr(10) || '```' || chr(10)) as md5 from f",
        "truncate_simple": f"with {FILES} select file_id, md5(case when {n40} <= 40 then content else array_to_string({LINES}[1:40], chr(10)) || chr(10) || '... truncated after 40 of ' || {n40} || ' lines (' || ({n40} - 40) * 100 // {n40} || '% cut)' end) as md5 from f",
        "truncate_gap": f"with {FILES} select file_id, md5(case when {n40} <= 40 then content else array_to_string({LINES}[1:16], chr(10)) || chr(10) || '... gap of ' || {n40} - 20 || ' lines' || chr(10) || array_to_string({LINES}[{n40} - 3:{n40}], chr(10)) end) as md5 from f",
        "truncate_structure": f"with {FILES} select file_id, len(string_split({REDUCED_TEXT}, chr(10))) as kept_lines from f",
        "line_counts": f"with {FILES}, {counts} select file_id, language, total, total - blank - comment as code, comment, blank from lc",
        "language_stats": f"with {FILES}, {counts} select coalesce(language, 'all') as language, count(*) as files, cast(sum(total) as bigint) as total, cast(sum(total - blank - comment) as bigint) as code, cast(sum(comment) as bigint) as comment, cast(sum(blank) as bigint) as blank from lc group by rollup (language)",
        "regex_symbol_extract": f"with {FILES}, {EXPLODED}, {SYMBOLS} select file_id, line_no, kind, name from sy",
        "regex_counts": f"with {FILES} select file_id, len(regexp_extract_all(content, 'TODO|FIXME')) as markers, len(regexp_extract_all(content, 'https?://[a-z0-9.]+')) as links, len(regexp_extract_all(content, '[0-9]+')) as numbers from f",
        "call_extract_distinct": f"with {FILES}, {EXPLODED}, {CALLS} select file_id, callee from ca",
        "usages": f"with {FILES}, {EXPLODED} select file_id, line_no, md5(line) as line_md5 from x where regexp_matches(line, '\\bharbor\\b') and not regexp_matches(line, {q(DEFINITION)}) order by file_id, line_no limit 200",
        "calls_inner_join": f"with {FILES}, {EXPLODED}, {SYMBOLS}, {CALLS}, {CALLEES}, {DEFINED} select name, callers, definitions, file_id from ci join de on callee = name",
        "calls_left_join": f"with {FILES}, {EXPLODED}, {SYMBOLS}, {CALLS}, {CALLEES}, {DEFINED} select name is not null as resolved, count(*) as names, cast(sum(callers) as bigint) as callers from ci left join de on callee = name group by 1",
        "external_calls_anti": f"with {FILES}, {EXPLODED}, {SYMBOLS}, {CALLS}, {CALLEES}, {DEFINED} select callee, callers from ci where callee not in (select name from de)",
        "census_per_parent": f"with {MEMBERS}, {CENSUS} select * from ce",
        "census_rollup": f"with {MEMBERS} select coalesce(repo_id, -1) as repo_id, count(*) as callables, cast(sum(lines) as bigint) as lines, count(*) filter (documented) as documented, round(count(*) filter (documented)::double / count(*), 4) as doc_ratio from me group by rollup (repo_id)",
        "census_health": f"""with {MEMBERS}, {CENSUS}, d as (select *, deprecated::double / callables * 0.2::double as debt from ce)
            select file_id, round(greatest(0.0, least(1.0, 1 - least(debt, 0.3::double) - least(0.05::double * large, 0.2::double) - case when doc_ratio < 0.1 then 0.2 when doc_ratio < 0.3 then 0.1 else 0.0 end::double - case when density > 50 then 0.15 when density > 30 then 0.05 else 0.0 end::double)), 4) as score,
            case when debt > 0.1::double and doc_ratio < 0.1 then 'critical' when large > 3 or debt > 0.05::double then 'high_debt' when doc_ratio >= 0.2 and density <= 30 then 'healthy' else 'stable' end as rating from d""",
        "large_item_list": f"with {MEMBERS}, l as (select distinct repo_id, file_id from me where lines > 30) select repo_id, string_agg(file_id::varchar, ',' order by file_id) as large_files from l group by 1",
        "metric_doc_coverage": f"with {MEMBERS} select language, count(*) as callables, round(avg(documented::int), 4) as coverage, round(avg(deps), 4) as avg_deps from me group by 1",
        "complexity_argmax": "select language, round(avg(complexity_score::double), 4) as average, arg_min(concept_no, (-complexity_score, concept_no)) as most_complex from concepts where complexity_score is not null group by 1",
        "language_shares": "select language, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 4) as percent from concepts group by 1",
        "churn_per_key": f"with {EVENTS}, {CHURN} select * from ch",
        "churn_class": f"with {EVENTS}, {CHURN} select {CLASS.format(a='n30', b='n90')} as churn_class, case when age_days < 30 then 'newborn' when age_days < 365 then 'young' when age_days < 730 then 'mature' else 'ancient' end as age_class, count(*) as files from ch group by 1, 2",
        "churn_dir_rollup": f"""with {EVENTS}, {CHURN}, c as (select * exclude (path), regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path from ch),
            g as (select {PARENT} as dir, count(*) as files, cast(sum(n90) as bigint) as n90, max(n30) as hottest, cast(floor(avg(age_days)) as bigint) as mean_age from c group by 1) select *, {CLASS.format(a='hottest', b='(n90 // files)')} as churn_class from g""",
        "top_observers": f"with {EVENTS} select {OBSERVER} as email, count(*) as changes, min(ts) as first_ts, max(ts) as last_ts from ev where observer_email is not null group by 1 order by changes desc, email limit 10",
        "top3_per_key": f"with {EVENTS}, c as (select repo_id, {OBSERVER} as email, count(*) as changes from ev where observer_email is not null group by 1, 2) select *, row_number() over (partition by repo_id order by changes desc, email) as rank from c qualify rank <= 3",
        "observer_counts": f"with {EVENTS} select repo_id, count(distinct {OBSERVER}) as observers, count(*) as changes from ev group by 1",
        "dormant_keys": f"with {EVENTS}, {CHURN} select repo_id, path, dormant_days from ch where dormant_days >= 180",
        "hot_keys": f"with {EVENTS}, {CHURN} select repo_id, path, n30, n90 from ch where n90 > 3",
        "tectonic_mean": f"with {FILES}, {EVENTS}, {CHURN}, {risk} select repo_id, path, round((least(n / 6.0::double, 1.0) + least(debt / 0.02::double, 1.0)) / 2, 6) as risk from ri where n >= 2 and debt >= 0.01",
        "tectonic_product": f"with {FILES}, {EVENTS}, {CHURN}, {risk} select repo_id, n > 10 and debt * 20 > 0.2 as risky, count(*) as files from ri group by 1, 2",
        "drift_report": f"""with {FILES}, {EXPLODED}, {SYMBOLS}, {EVENTS}, {CHURN}, p as (select repo_id, path, count(*) as callables from sy group by 1, 2),
            c as (select repo_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path, max(age_days) as age_days, min(dormant_days) as dormant_days, sum(n90) as n90 from ch group by 1, 2),
            j as (select coalesce(callables, 0) as k, age_days, dormant_days, n90 from c left join p using (repo_id, path)),
            a as (select sum(k) as total, coalesce(sum(k) filter (age_days <= 90), 0) as new, coalesce(sum(k) filter (dormant_days >= 730), 0) as ancient, coalesce(sum(k) filter (dormant_days < 730 and n90 > 0), 0) as active, coalesce(sum(k) filter (dormant_days < 730 and n90 = 0), 0) as dormant, coalesce(sum(k) filter (dormant_days < 180), 0) as moved from j)
            select cast(total as bigint) as total, cast(new as bigint) as new, cast(ancient as bigint) as ancient, cast(active as bigint) as active, cast(dormant as bigint) as dormant, cast(moved as bigint) as moved, round(coalesce(moved * 100.0::double / nullif(total, 0), 0), 6) as drift_percent, round(coalesce(moved * 100.0::double / nullif(total, 0), 0) * 365.0::double / 180, 6) as drift_per_year from a""",
        "rolling_velocity": "with g as (select ts::date as day, count(*) as n from events group by 1) select day::varchar as day, n, round((n - first_value(n) over w) / count(*) over w, 6) as velocity from g window w as (order by day rows between 6 preceding and current row)",
        "cosine_topk": nearest(COS, "desc"),
        "euclid_topk": nearest(EUC, "asc"),
        "manhattan_topk": nearest(MAN, "asc"),
        "normalize_zscore": f"with {LONG}, st as (select dim, avg(x) as m, greatest(stddev_pop(x), 0.001) as s from lo group by 1) select vec_id, cast(dim as int) as dim, round((x - m) / s, 4) + 0.0 as z from lo join st using (dim)",
        "normalize_minmax": f"with {LONG}, st as (select dim, min(x) as a, case when max(x) - min(x) < 0.001 then 1.0 else max(x) - min(x) end as w from lo group by 1) select vec_id, cast(dim as int) as dim, round((x - a) / w, 4) + 0.0 as x from lo join st using (dim)",
        "alignment_score": f"select a.vec_id, round(({COS} + 1) / 2, 5) as alignment from embeddings a join embeddings b on a.vec_id = b.vec_id + 1",
        "cluster_metrics": f"with {CENTER} select label, count(*) as size, round(avg(d), 4) as mean_distance, round(max(d), 4) as max_distance, round(1 / (1 + avg(d)), 4) as cohesion from di group by 1",
        "cluster_representative": f"with {CENTER} select label, round(min(d), 4) as distance from di group by 1",
        "graph_roots": f"with {EDGES} select distinct src as id from ed where src not in (select dst from ed)",
        "graph_leaves": f"with {EDGES} select distinct dst as id from ed where dst not in (select src from ed)",
        "graph_most_called": f"with {EDGES} select dst as id, count(*) as callers from ed group by 1 order by callers desc, id limit 20",
        "hierarchy_path": f"with recursive {HIER}, w as (select id, 0 as depth, name as path from h where parent_id is null union all select h.id, w.depth + 1, w.path || '/' || h.name from h join w on h.parent_id = w.id) select * from w",
        "hierarchy_children": f"with {HIER} select parent_id as id, count(*) as children, min(name) as first_child from h where parent_id is not null group by 1",
        "hierarchy_siblings": "select n_nationkey, count(*) over (partition by n_regionkey) - 1 as siblings from nation",
        "concept_infer": f"with {CONCEPTS} select concept_no, concept from cc",
        "relevance_score": f"with {CONCEPTS} select concept_no, score from cc",
        "reading_decision": f"with {CONCEPTS} select case when score > 0.7 then 'read' when score > 0.4 then 'skim' else 'skip' end as decision, count(*) as n, cast(sum(greatest(ceil(lines / 20.0) + (documentation is not null)::int, 1)) as bigint) as minutes from cc group by 1",
        "explore_plan": f"with {CONCEPTS} select concept_no, name, score from cc where score >= 0.4 order by score desc, concept_no limit 50",
        "lang_balanced_top": f"with {CONCEPTS}, t as (select * from cc order by score desc, concept_no limit 30) select concept_no, language, row_number() over (partition by language order by score desc, concept_no) as rank from t qualify rank <= 8",
        "noise_filter": "select language, count(*) as n from concepts where not regexp_matches(lower(name), 'test|mock|debug|trace') and not coalesce(is_deprecated, false) group by 1",
        "name_normalize": f"select concept_no, {NORMAL} as normal from concepts",
        "equivalence_classes": f"select {NORMAL} as normal, count(distinct language) as languages, count(*) as members from concepts where {NORMAL} <> '' and language is not null group by 1 having count(distinct language) > 1",
        "group_namer": f"""with {CONCEPTS}, g as (select file_id, concept, count(*) as n from cc group by 1, 2), b as (select file_id, sum(n) as total, arg_min(concept, (-n, concept)) as concept, max(n) as n from g group by 1),
            e as (select file_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path from file_entries) select file_id, case when n * 100 >= 40 * total then concept else {TOP} end as group_name from b join e using (file_id)""",
        "union_last_wins": f"""with {FILES}, u as (select repo_id, path, max(file_id) as id, 0 as source from f group by 1, 2
            union all select repo_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', ''), max(proc_id), 1 from processed_files group by 1, 2) select repo_id, path, arg_max(id, source) as id, max(source) as source from u group by 1, 2""",
        "set_diff_quality": f"""with {FILES}, {EXPLODED}, {SYMBOLS}, a as (select distinct file_id, name, 1 as a from sy where kind in ('fn', 'def', 'func', 'function')), b as (select distinct file_id, name, 1 as b from concepts where name is not null),
            j as (select a, b from a full join b using (file_id, name)), n as (select count(*) filter (a is not null and b is not null) as matched, count(*) filter (b is null) as missed, count(*) filter (a is null) as extra from j)
            select *, round(matched / nullif(matched + extra, 0), 6) as precision, round(matched / nullif(matched + missed, 0), 6) as recall from n""",
        "faded_patterns": "select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) >= 5",
        "last_50": "select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events qualify rank <= 50",
        "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
        "ema_utility": """with o as (select user_id::varchar as path, least(greatest(value / 100, 0.0), 1.0) as u, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as k, count(*) over (partition by user_id) as n from events where value is not null)
            select path, round(sum(u * 0.3::double * pow(0.7::double, k)) + 0.5::double * pow(0.7::double, max(n)), 5) as score, count(*) as reports from o group by 1""",
        "zoom_symbol": f"""with {FILES}, {EXPLODED}, {SYMBOLS}, a as (select name, count(*) as places, arg_min(file_id, (file_id, line_no)) as file_id, arg_min(line_no, (file_id, line_no)) as line_no from sy group by 1)
            select name, places, file_id, line_no, md5(array_to_string({LINES}[line_no:line_no + 7], chr(10))) as excerpt_md5 from a join f using (file_id)""",
        "nation_rollup": "with o as (select o_custkey, count(*) as orders from orders group by 1) select r_name, n_name, cast(sum(orders) as bigint) as orders from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join o on c_custkey = o_custkey group by rollup (r_name, n_name)",
        "binary_detect": f"with {FILES} select file_id, contains(substr(content, 1, 8192), chr(0)) as is_binary from f",
        "truncate_smart": f"""with {FILES}, {EXPLODED}, d as (select file_id, line_no as at from x where regexp_matches(line, {q(DEFINITION)})),
            k as (select distinct file_id, line_no from x where line_no <= 10 or regexp_matches(line, 'TODO|FIXME|XXX|HACK|__main__|\\bmain\\(')
                union select x.file_id, x.line_no from x join d on x.file_id = d.file_id and x.line_no between d.at and d.at + 5)
            select f.file_id, count(k.line_no) as important from f left join k using (file_id) group by 1""",
        "graph_depth": f"""with recursive {EDGES}, w as (select distinct src as id, 0 as level from ed where src not in (select dst from ed) union select ed.dst, w.level + 1 from w join ed on ed.src = w.id where w.level < 60),
            m as (select id, min(level) as level from w group by 1) select level, count(*) as nodes from m group by 1""",
        "graph_components": f"""with recursive {EDGES}, b as (select src, dst from ed union select dst, src from ed), w as (select src as id, src as seen from b union select w.id, b.dst from w join b on b.src = w.seen),
            m as (select id, min(seen) as component from w group by 1) select component, count(*) as size from m group by 1""",
        "graph_scc": f"""with recursive {EDGES}, w as (select src as a, dst as b from ed union select w.a, ed.dst from w join ed on ed.src = w.b),
            m as (select x.a as id, least(x.a, min(x.b)) as component from w x join w y on x.a = y.b and x.b = y.a group by x.a) select component, count(*) as size from m group by 1 having count(*) > 1""",
        "equivalents_theta": f"""with n as (select concept_no, language, {NORMAL} as normal from concepts), p as (select a.concept_no as query, b.concept_no, round(1 - levenshtein(a.normal, b.normal) / greatest(strlen(a.normal), strlen(b.normal))::double, 6) as score
            from n a join n b on a.language <> b.language and a.concept_no <> b.concept_no where a.concept_no % 50 = 0 and a.normal <> '' and b.normal <> '')
            select query, concept_no, score, case when score > 0.85 then 'high' when score > 0.7 then 'medium' else 'low' end as confidence from p where score >= 0.7""",
        "symbol_vectors": symbol_vectors(),
    }
