import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import scalars as S
from quillmill.operators import budget, classify, filters, graph, history, text, vectors
from quillmill.operators.plugins import Registry
from quillmill.operators.syntax_tree import declarations, skeleton
from quillmill.sources import scan
from quillmill.streaming.state import History, ema_batch, ema_stream, ignored_stream, step, windows_stream


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("content,expected", [("1234567", 1), ("12345678", 2), ("éééé", 2), ("", 0)])
def test_tokens(spark, content, expected):
    assert one(spark, S.tokens(F.col("c")), c=content) == expected


def test_file_cost_and_budget_strings(spark):
    assert one(spark, S.file_cost(F.col("p"), F.col("c")), p="x" * 16, c="y" * 21) == 30
    assert [one(spark, S.budget_tokens(F.col("t")), t=t) for t in ("100k", "2M", "7", "")] == [100000, 2000000, 7, None]


def test_greedy_with_skip(spark):
    df = spark.createDataFrame([(1, 50), (2, 60), (3, 40)], "id bigint, cost bigint")
    for batch in (1, 2, 100):
        assert [r["id"] for r in budget.greedy(df, "id", ["id"], "cost", 100, batch=batch).orderBy("id").collect()] == [1, 3]
    assert budget.greedy(df.limit(0), "id", ["id"], "cost", 100).count() == 0


def test_adaptive_drop(spark):
    df = spark.createDataFrame([(1, "core", 10), (2, "tests", 10), (3, "other", 10)], "id bigint, tier string, cost bigint")
    assert {r["id"] for r in budget.adaptive_drop(df, "id", "tier", "cost", 15).collect()} == {2, 3}
    assert budget.adaptive_drop(df, "id", "tier", "cost", 30).count() == 0


def test_classes(spark):
    ages = [one(spark, classify.age_class(F.col("d")), d=d) for d in (29, 30, 364, 365, 729, 730)]
    assert ages == ["newborn", "young", "young", "mature", "mature", "ancient"]
    churn = [one(spark, classify.churn_class(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((31, 31), (30, 30), (0, 10), (0, 4), (0, 3), (0, 1), (0, 0))]
    assert churn == ["supernova", "high", "moderate", "moderate", "low", "low", "dormant"]
    assert one(spark, classify.blend(F.col("s"), F.col("l")), s=50, l=0.5) == 50
    assert one(spark, classify.blend(F.lit(100), F.lit(None).cast("double"))) == 85
    assert abs(one(spark, classify.health_score(F.lit(0.0), F.lit(0), F.lit(0.05), F.lit(40.0))) - 0.75) < 1e-9
    assert abs(one(spark, classify.relevance(F.lit("calculation"), F.lit("d" * 60), F.lit("public"), F.lit(10), F.lit("calc_total"))) - 1.0) < 1e-9
    assert abs(one(spark, history.tectonic_mean(F.lit(15), F.lit(0.2))) - 0.5) < 1e-9
    assert abs(one(spark, history.tectonic_product(F.lit(15), F.lit(0.3))) - 0.3) < 1e-9


def test_names_and_days(spark):
    assert one(spark, S.normal_name(F.col("n")), n="calculateTotal") == one(spark, S.normal_name(F.col("n")), n="get_total") == "total"
    assert one(spark, S.normal_name(F.col("n")), n="HTTPGet") == "h_t_t_p"
    a, b = F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp")
    assert one(spark, S.whole_days(a, b)) == 0


@pytest.mark.parametrize("pattern,path", [("tests/**", "tests/a.py"), ("**/*.rs", "src/a.rs"), ("*conf*", "app/config.py"), ("*.py", "a/b.py"), ("Cargo.toml", "x/Cargo.toml")])
def test_lens_globs(spark, pattern, path):
    assert one(spark, filters.lens_glob(F.col("p"), pattern), p=path)


def test_inclusion(spark):
    keep = lambda p, i, k: one(spark, filters.included(F.col("p"), i, k), p=p)
    assert not keep("a.tmp", ["*.tmp"], ["*.tmp"]) and keep("main.py", ["*.tmp"], ["*.rs"]) and not keep("main.py", [], ["*.rs"]) and not keep("a/tests/x.py", ["tests"], [])


def test_truncation(spark):
    c = "\n".join(str(i) for i in range(100))
    gap = one(spark, text.truncate_gap(F.col("c"), 10), c=c).split("\n")
    assert gap[:4] == ["0", "1", "2", "3"] and gap[-1] == "99" and "95" in gap[4]
    assert one(spark, text.truncate_simple(F.col("c"), 10), c=c).endswith("(90% cut)")
    assert one(spark, text.truncate_simple(F.col("c"), 10), c="a") == "a"


def edges(spark):
    return spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src bigint, dst bigint")


def test_graph(spark):
    e = edges(spark)
    reach = graph.levels(e, spark.createDataFrame([(1,)], "id bigint"))
    assert {(r["id"], r["level"]) for r in reach.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    scc = {r["id"]: r["component"] for r in graph.strongly_connected(e).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {r["id"]: r["component"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert {r[0] for r in graph.roots(e).collect()} == {5} and {r[0] for r in graph.leaves(e).collect()} == {4, 6}
    order, rest = graph.peel(e)
    assert {(r["id"], r["level"]) for r in order.collect()} == {(5, 0), (6, 1)} and rest.count() == 4


def test_scc_of_two_rings(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 7), (7, 8), (8, 9), (9, 7)], "src bigint, dst bigint")
    assert {r["id"]: r["component"] for r in graph.strongly_connected(e).collect()} == {1: 1, 2: 1, 7: 7, 8: 7, 9: 7}


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5 * 0.1), 0.0, 0.0, 0.0]) for i in range(10)] + [(99, [500.0, 0.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert abs(one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.7071) < 1e-4
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    labels = {r["vec_id"]: r["cluster"] for r in vectors.dbscan(df, 0.5, 2).collect()}
    assert {labels[i] for i in range(5)} == {0} and {labels[i] for i in range(5, 10)} == {5} and labels[99] == -1
    assert [vectors.estimate_k(n) for n in (2, 8, 50)] == [1, 2, 5]
    groups = {r["vec_id"]: r["cluster"] for r in vectors.kmeans(df.where("vec_id < 99"), 2).collect()}
    assert len({groups[i] for i in range(5)}) == 1 and groups[0] != groups[9]


def test_ema_batch_equals_stream(spark, tmp_path):
    rows = [("a", 1.0, 1), ("b", 0.2, 2), ("a", 0.0, 3), ("a", 0.7, 4)]
    assert abs(step(0.5, 1.0) - 0.65) < 1e-9
    df = spark.createDataFrame(rows, "path string, utility double, seq bigint")
    batch = {r["path"]: round(r["score"], 9) for r in ema_batch(df).collect()}
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ema_stream(s).writeStream.format("memory").queryName("ema").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["path"]: round(r["score"], 9) for r in spark.table("ema").collect()} == batch


def test_windows_and_ignored_streams(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,id) as ts, 'x' as event_type, 'p' as pattern, 1.0D as value from range(6)")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, f in (("win", windows_stream), ("ign", ignored_stream)):
        q = f(s).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("win").first()["n"] == 6 and spark.table("ign").first()["faded"]


def test_undo_redo():
    h = History(3)
    h.record("a"), h.record("b")
    assert h.undo() == "a"
    h.record("c")
    assert h.items == ["a", "c"] and h.redo() == "c"
    h.record("d"), h.record("e")
    assert h.items == ["c", "d", "e"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\ny\r")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\0b")
    (tmp_path / "src" / "c.txt").write_bytes(b"caf\xe9")
    (tmp_path / "node_modules" / "d.js").write_bytes(b"1")
    (tmp_path / "big.txt").write_bytes(b"x" * 50)
    got = {r["path"]: r for r in scan.scan_tree(spark, str(tmp_path), max_size=40).collect()}
    assert set(got) == {"src/a.py", "src/b.bin", "src/c.txt"}
    assert got["src/a.py"]["content"] == "x = 1\ny\n" and got["src/b.bin"]["content"] is None and got["src/c.txt"]["content"] == "café"
    spark.dataSource.register(scan.TreeSource)
    listed = {r["path"] for r in spark.read.format("quilltree").option("root", str(tmp_path)).load().collect()}
    assert listed == {"big.txt", "src/a.py", "src/b.bin", "src/c.txt"}
    (tmp_path / "Cargo.toml").write_text("")
    assert scan.project_type(str(tmp_path / "src")) == "rust"
    assert scan.load_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}


def test_declarations_and_skeletons(spark):
    code = "class A:\n    @deco\n    def f(self, x):\n        '''Doc.'''\n        def g(): pass\n        return g\n\ndef h(\n    a,\n): return 1\n"
    df = spark.createDataFrame([(1, "a.py", code), (2, "b.py", "def ("), (3, "c.py", None)], "file_id bigint, path string, content string")
    got = {(r["file_id"], r["kind"], r["name"], r["depth"]) for r in declarations(df).collect()}
    assert got == {(1, "class", "A", 0), (1, "method", "f", 1), (1, "function", "g", 2), (1, "function", "h", 0), (2, "error", None, None)}
    assert skeleton(code, "python") == "class A:\n    def f(self, x):\n        ...\ndef h(\n    a,\n): return 1\n    ..."
    rust = "use a::b;\nstruct S { x: u8 }\nimpl S {\n    fn f(&self) -> u8 {\n        let y = 1;\n        y\n    }\n}\n"
    assert skeleton(rust, "rust") == "use a::b;\nstruct S { x: u8 }\nimpl S {\n    fn f(&self) -> u8 { ... }\n}"


def test_plugins_fail_alone(spark):
    r = Registry()
    r.metric("size")(lambda p, t: len(t))
    r.metric("broken")(lambda p, t: 1 / 0)
    r.tag("words")(lambda p, t: t.split())
    df = spark.createDataFrame([(1, "a", "x y"), (2, "b", None)], "file_id bigint, path string, content string")
    got = {(x["plugin"], x["value"], x["tag"], x["error"]) for x in r.run(df).collect()}
    assert got == {("size", 3.0, None, None), ("broken", None, None, "ZeroDivisionError"), ("words", None, "x", None), ("words", None, "y", None)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_sql_counterparts(spark):
    """A sample of queries against DuckDB; the driver compares them all."""
    import duckdb

    from quillmill.plans import oracles, queries

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(d):
        c.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    for name in ("budget_greedy_drop", "lens_priority_max", "census_rollup", "churn_class", "calls_inner_join", "relevance_score"):
        a, b = queries.queries()[name](spark, d).toPandas(), c.execute(oracles.oracle_sql()[name]).df()
        rows = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x.notna(), None).values.tolist()))
        assert rows(a) == rows(b), name
