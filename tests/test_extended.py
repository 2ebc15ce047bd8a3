"""Operators of the second round on fixtures worked out by hand, and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.operators import budget, classify, filters, graph, history, match, semantic, shell, text, vectors
from quillmill.plans import extended, extended_sql, oracles, queries
from quillmill.streaming import state


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "pattern,path,hit",
    [
        ("src/*.py", "src/a/b.py", True), ("*.py", "a/b.py", True), ("**/x.rs", "x.rs", True), ("**/x.rs", "a/b/x.rs", True), ("src/**", "src", False), ("src/**", "src/a", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        (".git", ".git/config", True), ("tests", "a/tests/b.py", True), ("?.py", "ab.py", False), ("[ab].py", "x/a.py", True), ("{x,y}.js", "y.js", True), ("*.p", "a.py", False), ("a.b", "axb", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, filters.glob(F.col("p"), pattern), p=path) is hit


def test_ignore_beats_include_and_the_strict_whitelist(spark):
    df = spark.createDataFrame([("main.py",), ("important.tmp",), ("lib/util.js",)], "path string")
    p = F.col("path")
    assert rows(df.where(filters.included(p, ["*.tmp"], ["*.js"]))) == [("lib/util.js",), ("main.py",)]
    assert rows(df.where(filters.whitelisted(p, ["*.js"]))) == [("lib/util.js",)] and df.where(filters.whitelisted(p, [])).count() == 3


def test_lens_groups(spark):
    p = F.col("p")
    assert one(spark, classify.lens_priority(p, "architecture"), p="rust/src/core/a.rs") == 100
    assert one(spark, classify.lens_priority(p, "architecture"), p="a/b.rs") == 95
    assert one(spark, classify.structured(p, "architecture"), p="a/b.rs") and not one(spark, classify.structured(p, "architecture"), p="a.toml")
    # an ending is taken as it stands, its stars too
    assert one(spark, classify.lens_priority(p, "security"), p="prod.env.local") == 25
    assert [one(spark, classify.lens_keeps(p, "architecture"), p=x) for x in ("tests/a.py", "src/a.py", "b.css")] == [False, True, False]


def allocate(files, budget_):
    """The allocator in plain Python: (key, tier, skeleton, full)."""
    level, order = {k: "skeleton" for k, *_ in files}, ["core", "config", "tests", "other"]
    used = sum(s for _, _, s, _ in files)
    if used <= budget_:
        for t in order:
            for k, tier, s, f in files:
                if tier == t and max(f - s, 0) <= budget_ - used:
                    level[k], used = "full", used + max(f - s, 0)
    else:
        for t in reversed(order):
            for k, tier, s, _ in files:
                if tier == t and used > budget_:
                    level[k], used = "drop", used - s
    return level


def test_adaptive_allocator(spark):
    r = random.Random(2)
    for n, limit in ((3, 100), (3, 15), (40, 900), (40, 2500), (40, 10**6)):
        files = [(i, r.choice(["core", "config", "tests", "other"]), r.randint(1, 30), r.randint(0, 90)) for i in range(n)]
        df = spark.createDataFrame(files, "id bigint, tier string, small bigint, large bigint")
        assert dict(rows(budget.adaptive(df, "id", "tier", "small", "large", limit))) == allocate(files, limit)
    df = spark.createDataFrame([(1, "core", 10, 80), (2, "core", 10, 50), (3, "other", 10, 30)], "id bigint, tier string, small bigint, large bigint")
    assert dict(rows(budget.adaptive(df, "id", "tier", "small", "large", 100))) == {1: "full", 2: "skeleton", 3: "skeleton"}
    body = spark.createDataFrame([(1, "long", "s"), (2, "long", "s"), (3, "long", "s")], "id bigint, content string, small string")
    assert {tuple(x) for x in budget.applied(body, budget.adaptive(df, "id", "tier", "small", "large", 100), "id", "content", "small").select("id", "content").collect()} == {(1, "long"), (2, "s"), (3, "s")}
    assert budget.adaptive(df.limit(0), "id", "tier", "small", "large", 5).count() == 0


def test_long_chains_converge(spark):
    """150 nodes in a row, an order that label propagation likes least; no limit of rounds cuts it off."""
    ids = list(range(150))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "src bigint, dst bigint")
    assert {r["component"] for r in graph.components(edges).collect()} == {0}
    line = spark.createDataFrame([(i, i + 1) for i in range(24)], "src bigint, dst bigint")
    assert graph.levels(line, spark.createDataFrame([(0,)], "id bigint")).agg(F.max("level")).first()[0] == 24
    assert graph.levels(line, spark.createDataFrame([(0,)], "id bigint"), 3).count() == 4


def test_reach_paths_and_neighbours(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("q", "a"), ("a", "b")], "src string, dst string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("b",)], "id string"))) == [("b",), ("c",), ("d",)]
    assert rows(graph.shortest_path(edges, "a", "d")) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert rows(graph.shortest_path(edges, "d", "a")) == [] and rows(graph.shortest_path(edges, "a", "a")) == [(0, "a")]
    n = {r["id"]: (r["callers"], r["callees"]) for r in graph.neighbors(edges).collect()}
    assert n["c"] == (["b", "x"], ["d"]) and n["q"] == ([], ["a"])
    assert rows(graph.without(edges, spark.createDataFrame([("b",), ("x",)], "id string"))) == [("c", "d"), ("q", "a")]
    m = graph.metadata(edges).first()
    assert (m["nodes"], m["edges"], m["depth"], m["cyclic"]) == (6, 6, 4, False)
    assert graph.metadata(edges.limit(0)).first()["nodes"] == 0


def test_call_graph_has_external_nodes(spark):
    calls = spark.createDataFrame([("f", "g"), ("f", "print"), ("g", "g"), ("f", "g")], "src string, callee string")
    defined = spark.createDataFrame([("f", "f"), ("g", "g"), ("h", "g")], "id string, name string")
    nodes, edges = graph.call_edges(calls, defined)
    assert rows(edges) == [("f", "external:print"), ("f", "g"), ("g", "g")]
    assert rows(nodes) == [("external:print", "external"), ("f", "defined"), ("g", "defined"), ("h", "defined")]


def test_silhouettes_and_kmeans(spark):
    r = random.Random(3)
    points = [(i, [float(c * 10 + r.random()), float(c % 2 * 10 + r.random())], c) for i, c in enumerate([0, 1, 2] * 40)]
    df = spark.createDataFrame(points, "vec_id bigint, embedding array<float>, label int")
    got = {x["vec_id"]: x["cluster"] for x in vectors.kmeans(df, 3, rounds=4).collect()}
    assert len({(got[i], c) for i, _, c in points}) == 3  # clusters are the labels
    assert {x["cluster"] for x in vectors.kmeans(df.limit(2), 5, rounds=1).collect()} == {0, 1} and vectors.kmeans(df.limit(0), 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], "vec_id bigint, embedding array<float>")
    assert vectors.kmeans(same, 3, rounds=2).count() == 4
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    for x in vectors.silhouettes(df, "label").collect():
        i = x["vec_id"]
        mean = lambda c: (lambda v: sum(v) / len(v))([dist(points[i][1], p) for j, p, k in points if k == c and j != i])
        a, b = mean(points[i][2]), min(mean(c) for c in {0, 1, 2} - {points[i][2]})
        assert abs(x["silhouette"] - (b - a) / max(a, b)) < 1e-4


def test_vector_shapes_and_components(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.vector_distance(v(1.0), v(1.0, 2.0))) == float("inf") and one(spark, vectors.vector_similarity(v(1.0), v(1.0, 2.0))) == 0
    assert one(spark, vectors.fitted(v(-1.0, 0.5, 3.0), 2)) == [0, 0.5] and one(spark, vectors.fitted(v(2.0), 3)) == [1, 0, 0]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert rows(vectors.similar_components(df, 0.9, cells=2)) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    pairs = semantic.class_cohesion(df.withColumn("g", F.lit("x")), "g").first()
    assert abs(pairs["cohesion"] - (2 / (4.01**0.5) + 0.1 / (4.01**0.5)) / 6) < 1e-6


def test_types_and_hybrid_similarity(spark):
    t = lambda a, b: one(spark, semantic.type_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert [t("testing", "testing"), t("validation", "testing"), t("unknown", "service"), t("service", "testing")] == [1.0, 0.3, 0.1, 0.2]
    h = lambda e, n, k, p="default": one(spark, semantic.hybrid(F.lit(e), F.lit(n), F.lit(k), p))
    assert abs(h(0.5, 0.5, 1.0) - 0.6) < 1e-9 and abs(h(0.5, 0.8, 1.0) - 0.84) < 1e-9 and h(1.0, 1.0, 1.0) == 1.0
    c = spark.createDataFrame([(1, "get_total", "python", "calculation", [1.0, 0.0]), (2, "calculateTotal", "rust", "calculation", [1.0, 0.1]), (3, "total", "python", "calculation", [1.0, 0.0])], "concept_no bigint, name string, language string, type string, embedding array<float>")
    assert {(r["query"], r["concept_no"]) for r in semantic.equivalents(c, c).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_time_plan(spark):
    items = spark.createDataFrame([(1, 0.9, 20), (2, 0.8, 15), (3, 0.75, 10), (4, 0.5, 5), (5, 0.2, 1)], "id bigint, score double, minutes int")
    got = {r["id"]: r["decision"] for r in semantic.time_plan(items, 30, [F.desc("score")], 5).collect()}
    assert got == {1: "read", 2: "skim", 3: "read", 4: "skim", 5: "skip"}


def test_history_by_directory(spark):
    f = spark.createDataFrame([("a", 4, 10, 5, 9, 0, 0.0), ("a", 6, 900, 800, 0, 0, 0.0), ("b", 5, 900, 800, 0, 31, 0.5), ("c", 1, 400, 100, 0, 0, 0.0)], "dir string, callables bigint, age_days bigint, dormant_days bigint, n90 bigint, n30 bigint, debt double")
    got = {r["dir"]: r for r in history.dir_drift(f, "dir").collect()}
    assert (got["a"]["stage"], got["a"]["drift_per_year"]) == ("newborn", 80.0) and got["b"]["stage"] == "ancient" and got["c"]["stage"] == "dormant"
    g = history.geology(f).first()
    assert (g["ancient"], g["ancient_core"], g["bursts"], g["activity"]) == (2, 2, 1, "high_volcanic")
    assert history.geology(f.limit(0)).first()["activity"] == "stable"


def test_long_comments_keep_their_state(spark):
    html = "<p>\n\n<!-- a\nb\n\nc -->\n<i/>\n<!-- d -->\n"
    df = spark.createDataFrame([(1, "x.html", html), (2, "y.py", "# a\nx = 1\n"), (3, "z.zzz", "a"), (4, "e.py", ""), (5, "n.py", None), (6, "r.rb", "=begin\nx\n=end\ny\r\n")], "file_id bigint, path string, content string")
    got = {r["file_id"]: (r["total"], r["code"], r["comment"], r["blank"]) for r in text.signature_counts(df, "file_id", "content", S.extension(F.col("path"))).collect()}
    assert got[1] == (8, 2, 4, 2) and got[2] == (2, 1, 1, 0) and got[4] == (0, 0, 0, 0) and got[6] == (4, 1, 3, 0) and 3 not in got


def test_text_rows(spark):
    code = "# adds\n# two\ndef add(a, b=1):\n    pass\nclass A:\n    @staticmethod\n    def f(self, x, *, y): pass\n    # TODO later\n"
    df = spark.createDataFrame([(1, code), (2, ""), (3, None)], "file_id bigint, content string")
    assert rows(text.doc_before(df, "file_id", "content")) == [(1, 3, 2), (1, 5, 0), (1, 7, 0)]
    assert rows(text.parameters(df, "file_id", "content")) == [(1, 3, "add", 2), (1, 7, "f", 2)]
    assert rows(text.decorators(df, "file_id", "content")) == [(1, 6, "staticmethod", "infrastructure")]
    assert rows(text.markers(df, "file_id", "content")) == [(1, 8, "TODO")]
    long = "\n".join(f"x{i}" for i in range(60)) + "\ndef f():\n" + "\n".join(f"y{i}" for i in range(200))
    flags = one(spark, text.important_lines(F.col("c")), c=long)
    assert [i for i, x in enumerate(flags) if x] == [*range(10), *range(60, 66)]
    out = one(spark, text.truncate_markdown(F.col("c"), 2, F.lit("a.md")), c="[a](u)\nb\n[c](v) [d](w)\n")
    assert out.startswith("[a](u)\nb\n\n===") and "Key imports: u, v, w\n" in out and "2/3 (33% reduction)" in out


def test_shell_scripts(spark):
    script = "#!/usr/bin/env zsh\nset -euo pipefail\ntrap 'x' EXIT\ndocker build .\nkubectl apply -f x\n"
    assert one(spark, shell.dialect(F.col("c")), c=script) == "zsh" and one(spark, shell.dialect(F.col("c")), c="echo") == "sh"
    v = one(spark, shell.vector(F.col("c")), c=script)
    assert v[0] == 0.6 and v[1] == 0.5 and sum(v[2:]) == 0 and one(spark, shell.primary(F.col("c")), c=script) == "deployment"
    assert one(spark, shell.primary(F.col("c")), c="") == "unknown"


def test_formats(spark):
    assert one(spark, S.thousands(F.lit(1234567))) == "1,234,567" and one(spark, S.qualified_name(F.lit("a::b"), F.lit("c"))) == "a::b::c"
    assert [one(spark, S.compact_age(F.lit(n))) for n in (5, 65, 7300, 90000, 10**7)] == ["5s", "1m", "2h", "1d", None]
    assert [one(spark, S.contained(F.col("p")), p=p) for p in ("a/../b", "../a", "a/../../b", "/etc", "./a")] == [True, False, False, False, True]
    assert one(spark, S.path_from(F.col("p"), "src"), p="src/a.py") == "a.py" and one(spark, S.safe_path(F.col("p")), p='a\\b"\x01') == "a/b&quot;"


def test_histories(spark):
    log = [(1, 1, "record", "a"), (1, 2, "record", "b"), (1, 3, "undo", None), (1, 4, "record", "c"), (2, 1, "undo", None), (2, 2, "record", "x"), (2, 3, "undo", None), (2, 4, "redo", None), (2, 5, "redo", None), (None, 1, "record", "z")]
    df = spark.createDataFrame(log, "user bigint, seq int, action string, item string")
    assert {r["user"]: (r["items"], r["at"]) for r in state.undo_redo(df, "user").collect()} == {1: (["a", "c"], 1), 2: (["x"], 0)}
    many = spark.createDataFrame([(1, i, "record", str(i)) for i in range(70)], "user bigint, seq int, action string, item string")
    assert state.undo_redo(many, "user").first()["items"] == [str(i) for i in range(20, 70)] and state.undo_redo(df.limit(0), "user").count() == 0


def test_marks_and_sessions(spark):
    m = spark.createDataFrame([("a", "mark", 0.2, 1), ("a", "view", None, 2), ("a", "mark", 0.9, 3), ("b", "view", None, 4)], "path string, kind string, utility double, seq int")
    assert rows(state.marks(m)) == [("a", 0.9, 1), ("b", None, 1)]
    s = [("s", "create", None, 1), ("s", "add_zoom", "x", 2), ("t", "create", None, 3), ("s", "add_zoom", "y", 4), ("s", "remove_zoom", "x", 5), ("s", "activate", None, 6), ("u", "create", None, 7), ("u", "add_zoom", "q", 8), ("u", "delete", None, 9)]
    df = spark.createDataFrame(s, "session string, action string, zoom string, seq int")
    assert rows(state.sessions(df)) == [("s", True, ["y"]), ("t", False, [])]


def test_sql_stands_alone():
    """The SQL counterparts take nothing from the operators."""
    import ast
    import inspect

    for module in (oracles, extended_sql):
        names = [n.module or "" for n in ast.walk(ast.parse(inspect.getsource(module))) if isinstance(n, ast.ImportFrom)]
        assert not [n for n in names if n.startswith(("operators", "functions"))]
    assert set(extended_sql.oracle_sql()) <= set(queries.queries()) and extended.BUDGET == queries.BUDGET


def test_similar_names_compares_few_names_and_loses_none(spark):
    draw = random.Random(7)
    words = ["get", "Total", "Router", "anchor", "Fenêtre", "éé", "ééé", "😀", "x", "Window", "retain", "_", "calc"]
    names = ["".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(160)] + ["éé", "ééé", "a😀😀", "a😀b"]
    c = spark.createDataFrame([(i, n, draw.choice(["python", "rust", None])) for i, n in enumerate(names)] + [(1000, "éé", "python"), (1001, "ééé", "rust")], "concept_no bigint, name string, language string")
    found = match.similar(c, 0.7, every=2, block=20)
    # names are made normal once each; a pair of them needs no pattern
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "levenshtein" in x and "regexp_replace" in x]
    n = c.withColumn("normal", S.normal_name(F.col("name"))).where("normal <> ''")
    score = F.round(S.name_similarity(F.col("a.name"), F.col("b.name")), 6)
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.concept_no % 2 = 0 and a.language <> b.language and a.concept_no <> b.concept_no")).select(F.col("a.concept_no").alias("query"), F.col("b.concept_no").alias("concept_no"), score.alias("score")).where("score >= 0.7")
    want = sorted(tuple(r) for r in pairs.collect())
    assert len(want) > 50 and sorted((r["query"], r["concept_no"], r["score"]) for r in found.collect()) == want


def _dbscan_by_hand(points, eps, least):
    near = {a: [b for b in points if a != b and sum((x - y) * (x - y) for x, y in zip(points[a], points[b])) ** 0.5 <= eps] for a in points}
    core, labels = sorted(a for a in points if len(near[a]) >= least), {}
    for a in core:
        todo = [] if a in labels else [a]
        while todo:
            b = todo.pop()
            if b not in labels:
                labels[b] = a
                todo += [c for c in near[b] if len(near[c]) >= least]
    border = {a: min(labels[b] for b in near[a] if b in labels) for a in points if a not in labels and any(b in labels for b in near[a])}
    return {a: (labels | border).get(a, -1) for a in points}


@pytest.mark.parametrize("dims,spread,direct", [(2, 12, 10_000), (2, 12, 1), (3, 5, 1), (1, 60, 4)])
def test_dbscan_equals_full_comparison(spark, dims, spread, direct):
    draw = random.Random(dims + direct)
    points = {i: [draw.choice([draw.uniform(-spread, spread), float(draw.randint(-spread, spread)) / 2]) for _ in range(dims)] for i in range(260)}
    points |= {1000 + i: [float(spread + 8 + i % 2)] * dims for i in range(6)}
    df = spark.createDataFrame(list(points.items()) + [(5000, [float("nan")] * dims), (5001, None), (5002, [1e300] * dims)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["cluster"] for r in vectors.dbscan(df, 1.0, 3, cells=2, direct=direct).collect()}
    assert len(set(got.values())) > 3 and got == _dbscan_by_hand(points, 1.0, 3) | {5000: -1, 5001: -1, 5002: -1}


def test_dbscan_lists_no_neighbours_of_dense_points(spark, monkeypatch):
    listed = []
    for name in ("cut", "stored"):
        if hasattr(vectors, name):
            keep = getattr(vectors, name)
            monkeypatch.setattr(vectors, name, lambda df, keep=keep: (listed.append((out := keep(df)).count()), out)[1])
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 200, F.lit(0.0)).alias("embedding"))
    assert {(r["cluster"], r["n"]) for r in vectors.dbscan(df, 1.0, 4, cells=2).groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {(0, 600)}
    assert max(listed) <= 600
