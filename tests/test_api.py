import pytest

from quillmill.plans import api
from quillmill.streaming.state import ema_batch


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "src/core/a.py", "def run(x):\n    return x\n" * 40), (2, "README.md", "# words\n"), (3, "tests/test_a.py", "def test_run():\n    assert True\n"), (4, "b.rs", "struct Run;\nfn go() {}\n"), (5, "n.py", None)]
    return spark.createDataFrame(rows, "file_id bigint, path string, content string")


def test_context_under_budget(files):
    out = api.get_context(files, token_budget="200").collect()
    assert sum(r["cost"] for r in out) <= 200 and "src/core/a.py" not in {r["path"] for r in out if r["method"] == "full"}
    whole = api.get_context(files, token_budget="1M", fmt="xml").collect()
    assert [r["path"] for r in whole][0] == "src/core/a.py" and len(whole) == 4 and all(r["method"] == "full" for r in whole)
    small = api.get_context(files, token_budget="250", skeleton=True).collect()
    assert {r["path"]: r["method"] for r in small}["src/core/a.py"] == "reduced"


def test_learned_order(spark, files, tmp_path):
    for seq, u in enumerate((1.0, 1.0, 1.0)):
        api.report_utility(spark, str(tmp_path / "u"), "README.md", u, seq)
    learned = ema_batch(spark.read.parquet(str(tmp_path / "u")))
    assert learned.first()["score"] > 0.8
    assert api.get_context(files, learned=learned, token_budget="1M").count() == 4
    with pytest.raises(ValueError):
        api.report_utility(spark, str(tmp_path / "u"), "x", 2.0, 1)


def test_zoom(files):
    assert {r["path"] for r in api.zoom(files, "function=go").collect()} == {"b.rs"}
    assert api.zoom(files, "class=Run").first()["first_line"] == 1
    assert api.zoom(files, "file=a.py:1-2").count() == 2
    assert api.zoom(files, "file=core/a.py:2-2").first()["excerpt"] == "    return x"
    assert api.zoom(files, "module=src.core").count() == 1
    with pytest.raises(ValueError):
        api.zoom(files, "nothing")


def test_budgets_and_lenses():
    assert api.parse_budget("100k") == 100_000 and api.parse_budget("2M") == 2_000_000 and "debug" in api.list_lenses()
    with pytest.raises(ValueError):
        api.parse_budget("")


def test_explore(spark):
    c = spark.createDataFrame([(1, "calculate_total", "Calculates the sum of all the given parts of it, twice.", "public", 1, 10), (2, "x", None, "private", 1, 2)], "concept_no bigint, name string, documentation string, visibility string, start_line int, end_line int")
    out = api.explore(c).collect()
    assert [(r["concept_no"], r["concept"], r["decision"]) for r in out] == [(1, "calculation", "read")]
