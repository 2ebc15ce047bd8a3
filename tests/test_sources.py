"""Trees of files with ignore rules, records with defaults, cached scans."""

import os

import pytest

from quillmill.sources import scan


def write(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def listed(spark, root, **options):
    spark.dataSource.register(scan.TreeSource)
    return sorted(r["path"] for r in spark.read.format("quilltree").options(root=str(root), **options).load().collect())


@pytest.mark.parametrize(
    "rules,path,folder,said",
    [
        ("*.log", "a/b.log", False, True), ("*.log\n!keep.log", "keep.log", False, False), ("/out", "out", True, True), ("/out", "a/out", True, None), ("docs/*.md", "docs/a.md", False, True), ("docs/*.md", "x/docs/a.md", False, None),
        ("tmp/", "tmp", False, None), ("tmp/", "a/tmp", True, True), ("**/gen/*.py", "a/b/gen/x.py", False, True), ("a/**", "a/b/c", False, True), ("# no\n\n", "no", False, None), ("[ab].c", "b.c", False, True), ("?.c", "ab.c", False, None), ("\\!x", "!x", False, True),
    ],
)
def test_ignore_rules(rules, path, folder, said):
    assert scan.IgnoreRules(rules).verdict(path, folder) is said


def test_tree_with_ignore_files(spark, tmp_path):
    write(tmp_path, {"a.py": "x", "b.log": "x", ".hidden": "x", ".gitignore": "*.log\nbuild2/\n!src/keep.log\n", "src/keep.log": "x", "src/drop.log": "x", "src/m.py": "xx", "build2/c.py": "x", "src/deep/.gitignore": "*.py\n!z.py\n", "src/deep/y.py": "x", "src/deep/z.py": "x", "node_modules/q.js": "x", "src/big.py": "x" * 50})
    os.symlink(tmp_path / "a.py", tmp_path / "src" / "link.py")
    assert listed(spark, tmp_path) == ["a.py", "src/big.py", "src/deep/z.py", "src/keep.log", "src/m.py"]
    assert listed(spark, tmp_path, ignore_files="false", max_size="40", depth="1") == ["a.py", "b.log", "build2/c.py", "src/drop.log", "src/keep.log", "src/m.py"]
    assert "src/link.py" in listed(spark, tmp_path, follow="true") and ".hidden" in listed(spark, tmp_path, hidden="true")
    assert scan.quick_count(spark.read.format("quilltree").options(root=str(tmp_path)).load(), 3) == 3


def test_records_and_snapshots(spark, tmp_path):
    schema = "path string, utility double"
    at = str(tmp_path / "store")
    assert scan.load_records(spark, at, schema).count() == 0
    scan.save_records(spark.createDataFrame([("a", 0.5)], schema), at)
    (tmp_path / "store" / "part-x.json").write_text("not json\n")
    assert [tuple(r) for r in scan.load_records(spark, at, schema).collect()] == [("a", 0.5)]
    folder = str(tmp_path / "cache")
    get = lambda n, head, now: scan.snapshot(spark.range(n), folder, "1", head, now).count()
    assert [get(3, "h", 0), get(5, "h", 60), get(5, "g", 60), get(7, "g", 90_000)] == [3, 3, 5, 7]
