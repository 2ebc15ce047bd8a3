"""SQL counterparts of the extended queries; values are written down here and not taken from the operators."""

from __future__ import annotations

from .oracles import (
    BASE, BOOSTS, BUDGET, CALLEES, CALLS, CHURN, COS, COST, CONCEPTS, DEFINITION, EDGES, EUC, EVENTS, EXPLODED, EXT, FILES, GROUPED, HIER, LANG, LIMITS, LINE_COMMENT, LINES, NORMAL, PARENT, RANK, REDUCED, REDUCED_TEXT, SYMBOLS, TIER, TOP, greedy, lens, q, relevance,
)

INTENTS = list(BOOSTS)
FENCE = "py python rs rust js javascript ts typescript jsx jsx tsx tsx json json toml toml yaml yaml yml yaml md markdown html html css css sh bash bash bash go go java java c c cpp cpp cc cpp cxx cpp h cpp hpp cpp rb ruby php php sql sql xml xml".split()
GRAMMAR = "rs rust py python pyw python pyi python ts typescript mts typescript cts typescript tsx tsx js javascript mjs javascript cjs javascript jsx jsx p abl i abl w abl cls abl c c h c cpp cpp cc cpp cxx cpp hpp cpp hxx cpp hh cpp java java go go rb ruby rake ruby gemspec ruby php php phtml php cs csharp swift swift kt kotlin kts kotlin scala scala sc scala html html htm html css css scss css sass css json json jsonc json yaml yaml yml yaml toml toml md markdown markdown markdown sh bash bash bash zsh bash ksh bash sql sql".split()
KIND = "case concept when 'logging' then 'observability' else concept end"
TYPE_WEIGHTS = {
    "business_logic": "calculation 1.0 validation 0.9 decision 0.8 transformation 0.7 service 0.6", "debugging": "error_handling 1.0 observability 0.9 validation 0.7 decision 0.6 integration 0.5", "security": "validation 1.0 error_handling 0.9 endpoint 0.8 database_operation 0.7 configuration 0.6",
    "onboarding": "service 1.0 endpoint 0.9 data_structure 0.8 configuration 0.7 infrastructure 0.6", "migration": "infrastructure 1.0 configuration 0.9 database_operation 0.8 integration 0.7 error_handling 0.5",
}
PAIRS = "calculation transformation 0.6 validation error_handling 0.5 service endpoint 0.7 data_structure database_operation 0.5 configuration infrastructure 0.6 observability error_handling 0.4 testing validation 0.3".split()
# Classes of shell scripts: hundredths for each pattern, what must be exceeded, patterns.
SHELL = [
    (20, 30, ["(?i)docker\\s+(build|push|pull|run|compose)", "(?i)kubectl\\s+(apply|delete|rollout|get|describe)", "(?i)helm\\s+(install|upgrade|uninstall|template)", "(?i)terraform\\s+(apply|plan|destroy|init)", "(?i)ansible(-playbook)?", "(?i)aws\\s+(s3|ec2|ecs|lambda|deploy)", "(?i)gcloud\\s+(deploy|run)", "(?i)az\\s+(webapp|functionapp|container)", "(?i)(deploy|release|rollout|publish)\\s+"]),
    (25, 30, ["set\\s+-[euo]+", "set\\s+-o\\s+(errexit|nounset|pipefail)", "trap\\s+['\"].*?['\"]\\s+(EXIT|ERR|INT|TERM)", "\\|\\|\\s*(exit|return|die|fatal)", "if\\s+\\[\\s*\\$\\?\\s*-ne\\s*0\\s*\\]", "(?i)(handle|catch|recover).*error"]),
    (15, 20, [*(f"(?i)\\b{w}\\s+" for w in "awk sed jq grep cut sort uniq xargs tr".split()), "\\|\\s*while\\s+read"]),
    (25, 30, ["(?i)cron(tab)?", "#\\s*@(hourly|daily|weekly|monthly|yearly)", "\\d+\\s+\\d+\\s+\\*\\s+\\*\\s+\\*", "(?i)systemd|systemctl", "(?i)\\bat\\s+", "(?i)\\bwatch\\s+", "while\\s+true\\s*;?\\s*do", "(?i)schedule|scheduled"]),
    (25, 30, ["(?i)\\btar\\s+[a-z]*[czx]", "(?i)\\brsync\\s+", "(?i)\\bcp\\s+-[ra]", "(?i)\\bdd\\s+", "(?i)(backup|bak|snapshot|archive)", "(?i)pg_dump|mysqldump|mongodump"]),
    (20, 30, ["(?i)\\blog\\s", "(?i)logger\\s+", "(?i)syslog", "(?i)(prometheus|grafana|datadog|newrelic)", "(?i)health.*check", "(?i)(alert|notify|slack|email)", "(?i)\\btop\\s|\\bhtop\\s|\\bvmstat\\s"]),
    (20, 30, ["(?i)\\btest\\s+", "(?i)(pytest|jest|mocha|rspec|unittest)", "(?i)assert|expect", "(?i)mock|stub|fake", "(?i)(integration|unit|e2e).*test", "\\[\\s*-[a-z]\\s+"]),
    (20, 30, ["(?i)\\bmake\\s+", "(?i)\\bcmake\\s+", "(?i)\\bcargo\\s+(build|test|run)", "(?i)\\bnpm\\s+(run|build|install)", "(?i)\\byarn\\s+(build|install)", "(?i)\\bgo\\s+(build|test)", "(?i)\\bmvn\\s+", "(?i)\\bgradle\\s+", "(?i)(compile|build|package)"]),
    (25, 30, ["(?i)\\brm\\s+-[rf]+", "(?i)\\bfind\\s+.*-delete", "(?i)(cleanup|clean|purge|prune)", "(?i)docker\\s+(system\\s+)?prune", "(?i)apt(-get)?\\s+autoremove"]),
    (20, 30, ["(?i)(init|setup|install|bootstrap)", "(?i)apt(-get)?\\s+install", "(?i)yum\\s+install", "(?i)pip\\s+install", "(?i)npm\\s+install", "(?i)\\bmkdir\\s+", "(?i)configure"]),
    (20, 30, [*(f"(?i)\\b{w}\\s+" for w in "curl wget ssh scp".split()), "(?i)\\bnetstat\\s+|\\bss\\s+", "(?i)\\bping\\s+", "(?i)\\bnc\\s+|\\bnetcat\\s+", "(?i)iptables|firewall"]),
    (20, 30, ["(?i)\\bchmod\\s+", "(?i)\\bchown\\s+", "(?i)ssl|tls|certificate", "(?i)\\bgpg\\s+|\\bopenssl\\s+", "(?i)password|secret|credential", "(?i)\\bsudo\\s+"]),
]
SHELL_NAMES = "deployment error_handling data_processing automation backup monitoring testing build cleanup setup network security".split()
CLEAN = "regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '')"
DECORATORS = "pytest|fixture|unittest|mock|patch|^test=testing dataclass|attr|pydantic|config|settings=configuration validator|validates|validate|^classmethod$=validation ^abstractmethod$|^staticmethod$|^property$|override|singleton=infrastructure cache|memoize=caching log|trace|timer|profile=logging route|api|endpoint|^(get|post|put|delete)$=api_routing".split()


def by_map(words: list[str], default: str) -> str:
    return f"case {EXT} " + " ".join(f"when {q(a)} then {q(b)}" for a, b in zip(words[::2], words[1::2])) + f" else {q(default)} end"


def globs(patterns: list[str]) -> str:
    """Does a pattern hit the path, a leading part of it or a component; of the shapes that lenses use."""
    out = []
    for p in patterns:
        if p.endswith("/**"):
            out.append(f"starts_with(path, {q(p[:-2])})")
        elif p.startswith("**/") and p.count("*") == 4:
            out.append(f"contains(path, {q(p[4:-1])})")
        elif p.startswith("**/"):
            out.append(f"regexp_matches(path, {q('(^|/)' + p[3:].replace('.', '[.]') + '(/|$)')})")
        elif p.startswith("*."):
            out.append(f"regexp_matches(path, {q(p[1:].replace('.', '[.]') + '(/|$)')})")
        else:
            out.append(f"regexp_matches(path, {q('(^|/)' + p.replace('.', '[.]') + '(/|$)')})")
    return "(" + " or ".join(out) + ")"


def lens_apply() -> str:
    ignored = {
        "architecture": "tests/** test/** docs/** doc/** htmlcov/** coverage.xml *.html *.css CONTEXT.txt *.txt test_vectors/** research/** LLM/** target/** dist/** scripts/** .github/**", "debug": "*.pyc __pycache__ .git",
        "security": "docs/** doc/** *.md *.txt htmlcov/** coverage/**", "onboarding": "target/** dist/** node_modules/** .git/** *.lock *.min.js",
    }
    rest = {"architecture": (2000, "path asc"), "debug": (0, "mtime desc"), "security": (0, "path asc"), "onboarding": (500, "path asc")}
    return f"with {FILES} " + " union all ".join(f"select {q(k)} as lens, file_id, {rest[k][0]} as truncate, {q(rest[k][1])} as \"order\" from f where not {globs(v.split())}" for k, v in ignored.items())


def shell_scores() -> str:
    points = []
    for i, (step, above, patterns) in enumerate(SHELL):
        total = f"{step} * (" + " + ".join(f"regexp_matches(content, {q(p)})::int" for p in patterns) + ")"
        if not i:
            total += " + 10 * (" + " + ".join(f"contains(lower(content), {q(t)})::int" for t in "docker kubectl helm terraform ansible aws gcloud az jenkins github gitlab".split()) + ")"
        points.append(f"case when {total} > {above} then least({total}, 100) else 0 end")
    first = "regexp_extract(lower(content), '^(#![^\\n]*)', 1)"
    dialect = "case " + " ".join(f"when contains({first}, {q(x)}) then {q(x)}" for x in ("bash", "zsh", "ksh", "fish")) + " else 'sh' end"
    return f"""with {FILES}, p as (select file_id, {dialect} as dialect, [{', '.join(points)}] as v from f where ends_with(lower(path), '.sh')),
        n as (select *, [{', '.join(map(q, SHELL_NAMES))}] as names from p)
        select file_id, dialect, case when list_max(v) > 0 then names[list_position(v, list_max(v))] else 'unknown' end as "primary", cast(i as int) as position, v[i + 1] / 100.0::double as confidence from n, range(12) r(i) where v[i + 1] > 0"""


def intent_decisions() -> str:
    parts = []
    for k in INTENTS:
        skip, deep = LIMITS[k]
        parts.append(f"""select {q(k)} as intent, case when complexity > 0.7 and s < {skip} then 'skip' when complexity > 0.7 and s > {deep} and centrality < 0.3 then 'bookmark' when s < {skip} then 'skip' when s >= {deep} then 'read' else 'skim' end as decision, count(*) as n
            from (select *, {relevance(k)} as s from u) group by 1, 2""")
    return f"""with {CONCEPTS}, {EDGES}, d as (select dst as name, count(*) as uses from ed group by 1),
        u as (select cc.*, least(coalesce(uses, 0) / 10.0::double, 1.0) as centrality, coalesce(complexity_score::double / 20.0, 0.0) as complexity from cc left join d on cc.name = d.name) {' union all '.join(parts)}"""


def type_similarity(a: str, b: str) -> str:
    pairs = " ".join(f"when ({a} = {q(x)} and {b} = {q(y)}) or ({a} = {q(y)} and {b} = {q(x)}) then {v}" for x, y, v in zip(PAIRS[::3], PAIRS[1::3], PAIRS[2::3]))
    return f"case when {a} = {b} then 1.0 {pairs} when {a} = 'unknown' or {b} = 'unknown' then 0.1 else 0.2 end::double"


def intent_score() -> str:
    home = "case language when 'python' then 1.0 when 'rust' then 0.5 else 0.0 end::double"
    score = lambda words: "case k " + " ".join(f"when {q(a)} then {b}" for a, b in zip(words[::2], words[1::2])) + " else 0.1 end::double"
    return f"with {CONCEPTS}, u as (select *, {KIND} as k from cc) select concept_no, k as kind, " + ", ".join(f"round({score(v.split())} * (0.5 + 0.5 * {home}), 4) as {k}" for k, v in TYPE_WEIGHTS.items()) + " from u"


HISTORY = f"""{EXPLODED}, {SYMBOLS}, {EVENTS}, {CHURN}, pe as (select repo_id, path, count(*) as callables from sy group by 1, 2),
    de as (select repo_id, path, max(len(list_filter({LINES}, lambda x: regexp_matches(x, 'TODO|FIXME|XXX'))) / len({LINES})::double) as debt from f group by 1, 2),
    cl as (select repo_id, {CLEAN} as path, sum(n30) as n30, sum(n90) as n90, max(age_days) as age_days, min(dormant_days) as dormant_days from ch group by 1, 2),
    fh as (select cl.*, coalesce(callables, 0) as callables, coalesce(debt, 0.0) as debt from cl left join pe using (repo_id, path) left join de using (repo_id, path))"""
AGE = "case when age_days < 30 then 'newborn' when age_days < 365 then 'young' when age_days < 730 then 'mature' else 'ancient' end"
LEVELS = f"""{EDGES}, ro as (select distinct src as id from ed where src not in (select dst from ed)), wa as (select id, 0 as level from ro union select ed.dst, wa.level + 1 from wa join ed on ed.src = wa.id where wa.level < 60),
    lv as (select id, min(level) as level from wa group by 1)"""


def smart() -> str:
    """Text of the important lines; gaps are told from the line before in the list."""
    total = f"len({LINES})"
    gap = f"array_to_string({LINES}[1:28], chr(10)) || chr(10) || '... gap of ' || {total} - 35 || ' lines' || chr(10) || array_to_string({LINES}[{total} - 6:{total}], chr(10))"
    return f"""with {FILES}, {EXPLODED}, d as (select file_id, line_no as at from x where regexp_matches(line, {q(DEFINITION)})),
        k as (select distinct file_id, line_no from x where line_no <= 10 or regexp_matches(line, 'TODO|FIXME|XXX|HACK|__main__|\\bmain\\(') union select x.file_id, x.line_no from x join d on x.file_id = d.file_id and x.line_no between d.at and d.at + 5),
        o as (select k.file_id, k.line_no, x.line, lag(k.line_no) over (partition by k.file_id order by k.line_no) as before from k join x using (file_id, line_no)),
        t as (select file_id, count(*) as n, string_agg(case when before is not null and line_no > before + 1 then chr(10) || '... [' || line_no - before - 1 || ' lines omitted] ...' || chr(10) || chr(10) else '' end || line || chr(10), '' order by line_no) as body from o group by 1)
        select file_id, md5(case when {total} <= 70 then content when n > 70 or n < 50 then {gap} else body end) as md5 from f join t using (file_id)"""


def markdown() -> str:
    lines = "string_split(regexp_replace(content, '\\n$', ''), chr(10))"
    links = f"flatten(list_transform({lines}, lambda x: regexp_extract_all(x, '\\[[^\\]]+\\]\\(([^\\)]+)\\)', 1)))[1:10]"
    rule = "repeat('=', 70)"
    return f"""with {FILES}, m as (select file_id, path, content, {lines} as ls, {links} as links from f where ends_with(lower(path), '.md'))
        select file_id, md5(case when len(ls) <= 12 then content else array_to_string(ls[1:12], chr(10)) || chr(10) || chr(10) || {rule} || chr(10) || 'TRUNCATED at line 12/' || len(ls) || ' (' || (len(ls) - 12) * 100 // len(ls) || '% reduction)' || chr(10) || 'Language: Markdown' || chr(10) || 'Category: documentation'
        || case when len(links) > 8 then chr(10) || 'Key imports: ' || array_to_string(links[1:8], ', ') || ', ...' when len(links) > 0 then chr(10) || 'Key imports: ' || array_to_string(links, ', ') else '' end
        || chr(10) || chr(10) || 'To get full content: --include "' || path || '" --truncate 0' || chr(10) || {rule} || chr(10) end) as md5 from m"""


def pattern_set() -> str:
    patterns = {"url": "https?://[a-z0-9.]+", "number": "[0-9]+", "todo": "TODO|FIXME", "quoted": '"[^"\\n]*"', "call": "[A-Za-z_]\\w*\\("}
    return f"with {FILES}, h as (" + " union all ".join(f"select {q(k)} as pattern, len(regexp_extract_all(content, {q(v)})) as n from f" for k, v in patterns.items()) + ") select pattern, count(*) as files, cast(sum(n) as bigint) as matches from h where n > 0 group by 1"


def oracle_sql() -> dict[str, str]:
    from .core_sql import core

    return core() | main()


def main() -> dict[str, str]:
    name = "regexp_extract(line, '\\b(fn|def|func|function)\\s+([A-Za-z_]\\w*)(<[^>]*>)?\\(([^()]*)\\)', {})"
    own = f"list_filter(list_transform(string_split({name.format(4)}, ','), lambda p: trim(p)), lambda p: p <> '' and not regexp_matches(p, '^(&?(mut )?self|cls|this|\\*|/)$'))"
    params = f"""pa as (select file_id, line_no, {name.format(2)} as name, len({own}) as n_params from x where regexp_matches(line, {q(DEFINITION)}) and regexp_matches(line, '\\b(fn|def|func|function)\\s+([A-Za-z_]\\w*)(<[^>]*>)?\\(([^()]*)\\)'))"""
    sig = f"case {EXT} " + " ".join(f"when {q(e)} then {q(c)}" for c, es in {"//": "rs js ts go java c cpp vue svelte", "#": "py rb yaml yml toml sh bash", "": "html htm xml css json md"}.items() for e in es.split()) + " end"
    sl = "case when content = '' then [] else string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n') end"
    trimmed = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
    decorated = "case " + " ".join(f"when regexp_matches(lower(decorator), {q(x.split('=')[0])}) then {q(x.split('=')[1])}" for x in DECORATORS) + " else 'unknown' end"
    minutes = "greatest(ceil(lines / 20.0) + (documentation is not null)::int, 1)::bigint"
    contained = "list_filter(string_split(path, '/'), lambda p: p not in ('', '.'))"
    cosine_sum = "lo as (select label, vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as dim, sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) as n from embeddings)"
    dot3 = lambda x, y: "(" + " + ".join(f"{x}.embedding[{i}]::double * {y}.embedding[{i}]::double" for i in (1, 2, 3)) + ")"
    cosine3 = f"{dot3('a', 'b')} / sqrt({dot3('a', 'a')}) / sqrt({dot3('b', 'b')})"
    calls_to = "t as (select distinct ca.file_id::varchar as src, coalesce(de.id, 'external:' || callee) as dst from ca left join de on callee = de.name)"
    return {
        "lens_apply": lens_apply(),
        "lens_structured": f"with {FILES} select file_id, ends_with(path, '.py') or ends_with({BASE}, '.rs') as structured from f",
        "whitelist_strict": f"with {FILES} select file_id from f where {globs(['*.py', 'Cargo.toml'])} or regexp_matches(path, '(^|/)config/.*\\.js(/|$)')",
        "budget_truncate": greedy(GROUPED, "file_id, method, took as cost", True),
        "budget_raw": greedy("(strlen(content) // 4)", "file_id, took as cost", False).replace(", path, file_id) as r", ", file_id) as r"),
        "budget_adaptive_upgrade": f"""with recursive {FILES}, a as materialized (select file_id, greatest({COST} - {REDUCED}, 0) as step, row_number() over (order by {RANK}, file_id) as r from f),
            w as (select 0::bigint as r, null::bigint as file_id, 20000::bigint as left_, false as took union all select a.r, a.file_id, w.left_ - case when step <= left_ then step else 0 end, step <= left_ from w join a on a.r = w.r + 1)
            select file_id, 'full' as level from w where took""",
        "budget_applied": f"""with {FILES}, a as (select file_id, {TIER} as tier, {REDUCED} as cost, strlen({REDUCED_TEXT}) // 4 as small from f),
            b as (select *, sum(cost) over (order by case tier when 'other' then 0 when 'tests' then 1 when 'config' then 2 else 3 end, file_id) - cost as gone, sum(cost) over () as total from a)
            select 'skeleton' as level, count(*) as files, cast(sum(small) as bigint) as tokens from b where total - gone <= {BUDGET} having count(*) > 0""",
        "sort_files": f"""with {FILES} select file_id, row_number() over (partition by repo_id order by path, file_id) as by_name, row_number() over (partition by repo_id order by mtime desc, path, file_id) as by_mtime, row_number() over (partition by repo_id order by ctime, path, file_id) as by_ctime
            from f where mtime is not null and ctime is not null""",
        "extension_labels": f"with {FILES} select file_id, {by_map(FENCE, '')} as fence, {by_map(GRAMMAR, 'unknown')} as grammar from f",
        "formats": f"""with {FILES} select file_id, format('{{:,}}', strlen(content)) as bytes_text, case when {PARENT} <> '' then {PARENT} || '::' else '' end || {BASE} as qualified, case when starts_with(path, 'src/') then substr(path, 5) else path end as below_src,
            not starts_with(path, '/') and coalesce(list_min(list_transform(range(1, len({contained}) + 1), lambda i: list_sum(list_transform({contained}[1:i], lambda p: case when p = '..' then -1 else 1 end)))), 0) >= 0 as contained,
            replace(replace(replace(replace(replace(regexp_replace(path, '[\\x00-\\x1f\\x7f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as safe from f""",
        "compact_times": f"""with {EVENTS}, a as (select event_no, ts, floor(epoch((select max(ts) from ev)))::bigint - floor(epoch(ts))::bigint as s from ev)
            select event_no, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' when s < 86400 then s // 3600 || 'h' when s < 2592000 then s // 86400 || 'd' else strftime(ts, '%Y-%m') end as age from a""",
        "input_type": f"with {FILES}, g as (select repo_id, count(*) as files from f group by 1) select repo_id, files, case when files = 1 then 'file' when files < 50 then 'small' when files > 500 then 'large' else 'medium' end as input_type from g",
        "repo_languages": f"""with {FILES}, n as (select repo_id, {LANG} as language, count(*) as n from f group by 1, 2), r as (select *, row_number() over (partition by repo_id order by n desc, language) as r from n)
            select repo_id, max(language) filter (r = 1) as first, max(language) filter (r = 2) as second from r where r <= 2 group by 1""",
        "language_index": f"with {FILES}, {EXPLODED}, {SYMBOLS} select {LANG} as language, kind, count(*) as n from sy group by 1, 2",
        "intent_scores": f"with {CONCEPTS} select concept_no, {', '.join(f'{relevance(k)} as {k}' for k in INTENTS)} from cc",
        "intent_decisions": intent_decisions(),
        "intent_score": intent_score(),
        "type_similarities": f"with {CONCEPTS}, n as (select {KIND} as kind, count(*) as n from cc group by 1) select x.kind as a, y.kind as b, x.n as na, y.n as nb, {type_similarity('x.kind', 'y.kind')} as similarity from n x join n y on x.kind <= y.kind",
        "explore_time": f"""with recursive {CONCEPTS}, t as (select *, {minutes} as m from cc where score >= 0.3 order by score desc, concept_no limit 25), k as materialized (select *, row_number() over (order by score desc, concept_no) as r from t),
            w as (select 0::bigint as r, null::bigint as concept_no, 0::bigint as used, null::varchar as decision union all
                select k.r, k.concept_no, w.used + case when k.score > 0.7 and w.used + k.m <= 30 then k.m else 0 end, case when k.score > 0.7 and w.used + k.m <= 30 then 'read' when k.score > 0.4 then 'skim' else 'skip' end from w join k on k.r = w.r + 1)
            select r as rank, concept_no, decision from w where r > 0""",
        "group_brightest": f"with {CONCEPTS}, m as (select *, max(score) over (partition by file_id) as top from cc where file_id is not null) select file_id, concept_no from m where abs(score - top) < 0.001",
        "group_statistics": f"""with {CONCEPTS}, g as (select file_id, concept, count(*) as n, sum(score) as s, max(score) as m from cc where file_id is not null group by 1, 2)
            select file_id, cast(sum(n) as bigint) as size, round(sum(s), 4) as total_score, max(m) as top_score, arg_min(concept, (-n, concept)) as dominant from g group by 1""",
        "next_step": f"""with {CONCEPTS}, g as (select file_id, max(score) as t, round(1 - (max(score) - min(score)), 4) as c from cc where file_id is not null group by 1)
            select file_id, case when t >= 0.9 then 'start_here' when c >= 0.8 then 'deep_dive' else 'explore' end as action, case when t >= 0.9 then 9 when c >= 0.8 then 7 when t >= 0.7 then 6 else 4 end as priority from g""",
        "canonical_names": f"with g as (select file_id, {NORMAL} as canonical, count(*) as n from concepts where file_id is not null group by 1, 2) select file_id, arg_min(canonical, (-n, canonical)) as canonical, cast(sum(n) as bigint) as members from g group by 1",
        "name_patterns": """with g as (select file_id, min(name) as a, max(name) as b, min(reverse(name)) as c, max(reverse(name)) as d from concepts where file_id is not null group by 1),
            h as (select file_id, a[1:list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: a[1:n] = b[1:n]))] as p, c[1:list_max(list_filter(range(0, least(length(c), length(d)) + 1), lambda n: c[1:n] = d[1:n]))] as s from g)
            select file_id, case when length(p) >= 3 then p end as prefix, case when length(s) >= 3 then reverse(s) end as suffix from h""",
        "bright_items": "select case when utility >= 0.9 then 'brilliant' when utility >= 0.8 then 'bright' when utility >= 0.5 then 'steady' else 'dim' end as brightness, count(*) as n, count(*) filter (utility >= 0.8) as bright from processed_files where utility is not null group by 1",
        "truncate_markdown": markdown(),
        "truncate_smart_text": smart(),
        "signature_counts": f"""with {FILES}, s as (select file_id, {EXT} as extension, {sig} as one, {sl} as ls from f), c as (select file_id, extension, len(ls) as total, len(list_filter(ls, lambda x: {trimmed} = '')) as blank, case when one = '' then 0 else len(list_filter(ls, lambda x: starts_with({trimmed}, one))) end as comment from s where one is not null)
            select file_id, extension, total, total - blank - comment as code, comment, blank from c""",
        "truncation_statistics": f"""with {FILES}, t as (select {LANG} as language, strlen(content) // 4 as a, strlen({REDUCED_TEXT}) // 4 as b from f)
            select language, count(*) as files, cast(sum(a) as bigint) as full_tokens, cast(sum(b) as bigint) as kept_tokens, round(100.0::double * sum(a - b) / nullif(sum(a), 0), 4) as saved_percent from t group by 1""",
        "doc_comments": f"""with {FILES}, {EXPLODED}, l as (select file_id, line_no, regexp_matches(line, '^\\s*(///|//!|//|#[^\\[]|#$|\\*|/\\*)') as c, regexp_matches(line, {q(DEFINITION)}) as d from x),
            o as (select *, max(case when not c then line_no end) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as other from l)
            select file_id, line_no, line_no - 1 - coalesce(other, 0) as doc_lines from o where d""",
        "parameter_counts": f"with {FILES}, {EXPLODED}, {params} select * from pa",
        "metric_avg_params": f"with {FILES}, {EXPLODED}, {params} select file_id, count(*) as callables, count(*) filter (n_params > 5) as heavy, round(sum(n_params) / count(*), 4) as avg_params from pa group by 1",
        "decorator_categories": f"""with {FILES}, {EXPLODED}, d as (select regexp_extract(line, '^\\s*@([A-Za-z_][\\w.]*)', 1) as decorator from x where ends_with(lower(path), '.py') and regexp_matches(line, '^\\s*@([A-Za-z_][\\w.]*)'))
            select {decorated} as category, count(*) as n, count(distinct decorator) as decorators from d group by 1""",
        "task_markers": f"with {FILES}, {EXPLODED} select file_id, line_no, regexp_extract(line, '\\b(TODO|FIXME|XXX|HACK|BUG|NOTE)\\b', 1) as marker from x where regexp_matches(line, {q(LINE_COMMENT)}) and regexp_matches(line, '\\b(TODO|FIXME|XXX|HACK|BUG|NOTE)\\b')",
        "shell_pattern_scores": shell_scores(),
        "pattern_set": pattern_set(),
        "regex_rewrites": f"with {FILES} select file_id, md5(regexp_replace(content, '[0-9]+', '#', 'g')) as replaced, len(string_split_regex(content, '[;,]')) as pieces, regexp_extract(content, '([a-z_]+)\\(([a-z_]+)', 1) as caller, regexp_extract(content, '([a-z_]+)\\(([a-z_]+)', 2) as argument from f",
        "geological_summary": f"""with {FILES}, {HISTORY}, g as (select count(*) filter (n90 >= 10 and debt >= 0.2) as stressed, count(*) filter (dormant_days >= 730) as ancient, count(*) filter (dormant_days >= 730 and callables >= 5) as ancient_core, count(*) filter (n30 >= 30) as bursts from fh)
            select *, case when bursts > 0 then 'high_volcanic' when stressed > 5 then 'tectonic_stress' when stressed > 0 then 'minor_shifts' else 'stable' end as activity from g""",
        "ancient_files": f"with {FILES}, {HISTORY} select repo_id, path, dormant_days, callables, callables >= 5 as is_core from fh where dormant_days >= 365",
        "risk_ranking": f"with {FILES}, {HISTORY} select repo_id, path, round((least(n90 / 30.0::double, 1.0) + least(debt / 0.4::double, 1.0)) / 2, 6) as risk from fh where n90 >= 10 and debt >= 0.2",
        "drift_by_dir": f"""with {FILES}, {HISTORY}, c as (select *, {TOP} as dir, case when age_days > 0 and age_days <= 90 then 'new' when dormant_days >= 730 then 'ancient' when n90 > 0 then 'active' else 'dormant' end as k from fh where callables > 0),
            g as (select dir, coalesce(sum(callables) filter (k = 'new'), 0) as new, coalesce(sum(callables) filter (k = 'ancient'), 0) as ancient, coalesce(sum(callables) filter (k = 'active'), 0) as active, coalesce(sum(callables) filter (k = 'dormant'), 0) as dormant,
                floor(avg(age_days) filter (age_days > 0))::bigint as mean_age, min(age_days) filter (age_days > 0) as young, max(age_days) filter (age_days > 0) as old from c group by 1)
            select dir, new::bigint as new, ancient::bigint as ancient, active::bigint as active, dormant::bigint as dormant, mean_age, round((new + active) * 200.0::double / (new + ancient + active + dormant), 6) as drift_per_year,
                case when young <= 90 then 'newborn' when old >= 730 and new = 0 and active = 0 then 'ancient' when new > ancient then 'growing' when active > 0 then 'active' else 'dormant' end as stage from g""",
        "drift_class": f"""with {FILES}, {HISTORY}, g as (select repo_id, sum(callables) as t, coalesce(sum(callables) filter (dormant_days < 180), 0) as m from fh group by 1), r as (select repo_id, m * 100.0::double / nullif(t, 0) * 365.0::double / 180 as rate from g)
            select repo_id, round(rate, 4) as drift_per_year, case when rate is null then 'none' when rate < 10 then 'minimal' when rate < 25 then 'low' when rate < 50 then 'moderate' when rate < 75 then 'high' else 'extreme' end as drift from r""",
        "age_class": f"with {EVENTS}, {CHURN} select repo_id, {AGE} as age_class, count(*) as files from ch group by 1, 2",
        "silhouette_by_label": f"""with p as (select a.vec_id, a.label, b.label as other, avg({EUC}) as m from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 and a.label is not null and b.label is not null group by 1, 2, 3),
            s as (select vec_id, label, coalesce(max(m) filter (other = label), 0.0) as a, min(m) filter (other <> label) as b from p group by 1, 2) select vec_id, label, round(a, 4) as a, round(b, 4) as b, round((b - a) / greatest(a, b), 4) as silhouette from s""",
        "components_by_similarity": f"""with recursive e as (select a.vec_id as s, b.vec_id as t from embeddings a join embeddings b on a.vec_id <> b.vec_id where {cosine3} >= 0.99), w as (select vec_id as id, vec_id as seen from embeddings union select w.id, e.t from w join e on e.s = w.seen),
            m as (select id, min(seen) as component from w group by 1) select component, count(*) as size from m group by 1""",
        "class_cohesion": f"""with {cosine_sum}, d as (select label, dim, sum(x / n) as s, sum(x / n * (x / n)) as o from lo group by 1, 2), g as (select label, sum(s * s) as al, sum(o) as o from d group by 1), k as (select label, count(*) as members from embeddings group by 1)
            select label, members, round(case when members < 2 then 1.0 else (al - o) / (members * (members - 1)) end, 5) as cohesion from g join k using (label)""",
        "vector_fit": "select vec_id, round(list_sum(list_transform(embedding[1:48], lambda x: greatest(0.0, least(1.0, x::double)))), 4) as short, round(list_sum(list_transform(embedding, lambda x: greatest(0.0, least(1.0, x::double)))), 4) as long, 80 as size, 0.0::double as other_size from embeddings",
        "weighted_vectors": "select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * case when label % 2 = 0 and i <= 8 then 2 else 1 end)), 4) as total from embeddings",
        "best_partner": f"with p as (select a.vec_id as query, {COS} as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select query, round(max(score), 5) as score from p group by 1",
        "graph_neighbors": f"with {EDGES}, n as (select src as id from ed union select dst from ed) select id, coalesce((select string_agg(src, ',' order by src) from ed where dst = id), '') as callers, coalesce((select string_agg(dst, ',' order by dst) from ed where src = id), '') as callees from n",
        "graph_reachable": f"with recursive {EDGES}, w as (select min(src) as id from ed where src not in (select dst from ed) union select ed.dst from w join ed on ed.src = w.id) select id from w",
        "graph_shortest_path": f"with recursive {LEVELS} select cast(level as int) as step, 1::bigint as nodes from (select unnest(range(0, max(level) + 1)) as level from lv)",
        "graph_metadata": f"""with recursive {LEVELS}, w2 as (select src as a, dst as b from ed union select w2.a, ed.dst from w2 join ed on ed.src = w2.b), n as (select src as id from ed union select dst from ed)
            select (select count(*) from n) as nodes, (select count(*) from ed) as edges, cast((select max(level) from lv) as int) as depth, exists (select 1 from w2 where a = b) as cyclic""",
        "dbscan": """with p as (select c_custkey as id, c_nationkey as g, c_acctbal / 250 as x from customer), n as (select a.id, a.g, a.x, count(b.id) as n from p a left join p b on a.g = b.g and a.id <> b.id and abs(a.x - b.x) <= 1.0 group by 1, 2, 3),
            c as (select *, case when x - lag(x) over (partition by g order by x, id) <= 1.0 then 0 else 1 end as cut from n where n >= 4), i as (select *, sum(cut) over (partition by g order by x, id) as island from c), k as (select *, min(id) over (partition by g, island) as cluster from i),
            b as (select n.id, min(k.cluster) as cluster from n join k on n.g = k.g and abs(n.x - k.x) <= 1.0 where n.n < 4 group by 1), o as (select id, cluster from k union all select id, cluster from b)
            select coalesce(cluster, -1) as cluster, count(*) as size from p left join o using (id) group by 1""",
        "graph_without": f"with {EDGES}, g as (select dst as id from ed group by 1 order by count(*) desc, 1 limit 5) select count(*) as edges, count(distinct src) as sources from ed where src not in (select id from g) and dst not in (select id from g)",
        "call_graph": f"""with {FILES}, {EXPLODED}, {SYMBOLS}, {CALLS}, de as (select name, min(file_id::varchar) as id from sy where kind in ('fn', 'def', 'func', 'function') group by 1), {calls_to}
            select case when starts_with(dst, 'external:') then 'external' else 'defined' end as kind, count(*) as edges, count(distinct dst) as nodes from t group by 1""",
        "breadcrumb": f"with recursive {HIER}, w as (select id, 1 as steps, name as crumbs from h where parent_id is null union all select h.id, w.steps + 1, w.crumbs || ' > ' || h.name from h join w on h.parent_id = w.id) select id, crumbs, steps from w",
        "marked_paths": """with e as (select user_id::varchar as path, event_type = 'view' as seen, value / 100 as u, row_number() over (partition by user_id, event_type = 'view' order by ts desc, event_id desc) as r from events)
            select path, round(max(u) filter (not seen and r = 1), 6) as utility, count(*) filter (seen) as views from e group by 1""",
        "stream_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
        "stream_faded": "select event_type as pattern, count(*) as n, count(*) >= 5 as faded from events group by 1",
        "retrieval_quality": f"""with {FILES}, {EXPLODED}, {SYMBOLS}, a as (select distinct file_id, name, 1 as a from sy where kind in ('fn', 'def', 'func', 'function')), b as (select distinct file_id, name, 1 as b from concepts where name is not null), j as (select file_id, a, b from a full join b using (file_id, name)),
            n as (select {LANG} as language, count(*) filter (a = 1 and b = 1) as hit, count(a) as wanted, count(b) as given from j join f using (file_id) group by 1)
            select language, round(hit / nullif(given, 0), 6) as precision, round(hit / nullif(wanted, 0), 6) as recall, round(2 * hit / nullif(given + wanted, 0), 6) as f1 from n""",
        "edge_endpoints": """with e as (select language as from_language, unnest(dependencies) as name from concepts), t as (select name, min(language) as to_language from concepts where name is not null group by 1)
            select from_language, coalesce(to_language, 'external') as to_language, count(*) as edges from e left join t using (name) group by 1, 2""",
        "calls_by_name": f"with {FILES}, {EXPLODED}, {CALLS}, {CALLEES} select callee, callers from ci order by callers desc, callee limit 100",
    }
