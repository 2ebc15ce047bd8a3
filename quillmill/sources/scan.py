"""Sources: trees of files, change events, configuration, repositories."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.filters import HYGIENE, hygienic, included

MAX_SIZE = 5_242_880
# What tells a kind of project by its marker file.
MARKERS = [("Cargo.toml", "rust"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python"), ("package.json", "node"), ("go.mod", "go"), ("pom.xml", "java"), ("build.gradle", "java")]


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, max_size: int = MAX_SIZE) -> DataFrame:
    """``path, content, md5, mtime, size, binary``: files below a root, by the inclusion rule.

    The size limit and the modification time reach the file listing; content is decoded
    as UTF-8, else Latin-1, and line ends become LF. Content of binary files is null.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_size)
    base = "file:" + os.path.abspath(root) if "://" not in root and not root.startswith("file:") else root
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + base.rstrip("/").replace(".", r"\.") + "/", "")
    named = raw.withColumn("path", path).where(hygienic(F.col("path")) & included(F.col("path"), ignore or [], include or []))
    binary = F.contains(F.substring("content", 1, 8192), F.lit(b"\0"))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    clean = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return named.select("path", F.when(~binary, clean).alias("content"), F.md5("content").alias("md5"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), binary.alias("binary"))


class IgnoreRules:
    """The rules of ignore files: the last one that matches decides, of the nearest folder that has one.

    A pattern with a slash before its end is anchored to its file's folder, one with a slash
    at its end hits folders only, ``!`` takes a path back; ``*`` and ``?`` stay within a name.
    """

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            folder, line = line.endswith("/"), line.rstrip("/")
            head = "" if "/" in line else "(?:.*/)?"
            self.rules.append((re.compile(head + self._pattern(line.lstrip("/")) + r"\Z"), keep, folder))

    @staticmethod
    def _pattern(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "[" and "]" in glob[i + 2 :]:
                end = glob.index("]", i + 2)
                out, i = out + "[" + glob[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
        return out

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored, False: taken back, None: no rule says anything; ``path`` from the file's folder on."""
        for pattern, keep, only_folders in reversed(self.rules):
            if (folder or not only_folders) and pattern.match(path):
                return not keep
        return None


class TreeSource(DataSource):
    """``spark.read.format("quilltree")``: a listing that prunes directories before it descends.

    Options: ``root``, ``depth`` (default 64), ``hidden`` (false), ``ignore_files`` (true: the
    rules of ``.gitignore`` files count), ``follow`` (false: links are left out), ``max_size``.
    Each directory directly below the root is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "quilltree"

    def schema(self) -> str:
        return "path string, size bigint, mtime double, depth int"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.root, self.depth, self.most = options["root"], int(options.get("depth", 64)), int(options.get("max_size", MAX_SIZE))
        self.hidden, self.ignore, self.follow = flag("hidden", "false"), flag("ignore_files", "true"), flag("follow", "false")

    def partitions(self) -> list[InputPartition]:
        rules = self._rules("", {})
        return [InputPartition(x) for x in ["", *sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=self.follow) and self._kept(e.name, True, rules))]]

    def _rules(self, folder: str, above: dict[str, IgnoreRules]) -> dict[str, IgnoreRules]:
        """Rules in force in a folder, by the folder of their file, nearest last."""
        at = os.path.join(self.root, folder, ".gitignore")
        if not self.ignore or not os.path.isfile(at):
            return above
        with open(at, encoding="utf-8", errors="replace") as f:
            return {**above, folder: IgnoreRules(f.read())}

    def _kept(self, path: str, folder: bool, rules: dict[str, IgnoreRules]) -> bool:
        name = path.rsplit("/", 1)[-1]
        if folder and name in HYGIENE or not self.hidden and name.startswith("."):
            return False
        for base in reversed(rules):
            said = rules[base].verdict(path[len(base) + 1 :] if base else path, folder)
            if said is not None:
                return not said
        return True

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        top = self._rules("", {})
        in_force = {"": top, partition.value: self._rules(partition.value, top) if partition.value else top}
        for folder, dirs, names in os.walk(os.path.join(self.root, partition.value), followlinks=self.follow):
            at = os.path.relpath(folder, self.root).replace(os.sep, "/")
            at = "" if at == "." else at
            rules, depth = in_force[at], at.count("/") + 1 if at else 0
            below = lambda n: f"{at}/{n}" if at else n
            dirs[:] = [] if partition.value == "" or depth >= self.depth else sorted(d for d in dirs if self._kept(below(d), True, rules))
            for d in dirs:
                in_force[below(d)] = self._rules(below(d), rules)
            for n in sorted(names):
                full = os.path.join(folder, n)
                if not self._kept(below(n), False, rules) or not self.follow and os.path.islink(full) or not os.path.isfile(full):
                    continue
                s = os.stat(full)
                if s.st_size <= self.most:
                    yield below(n), s.st_size, s.st_mtime, depth


def quick_count(files: DataFrame, limit: int) -> int:
    """Number of files, counted no further than ``limit``."""
    return files.limit(limit).count()


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store, journal or list of sessions written as JSON lines; missing or malformed gives no rows."""
    try:
        read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return read


def save_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def change_events(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """Change events of a table, newest first; ``truncated`` tells whether more than ``depth`` exist."""
    events = spark.read.parquet(path)
    if depth is None:
        return events.withColumn("truncated", F.lit(False))
    newest = events.orderBy(F.desc("ts"), F.desc("event_no")).limit(depth + 1)
    more = newest.count() > depth
    return newest.orderBy(F.desc("ts"), F.desc("event_no")).limit(depth).withColumn("truncated", F.lit(more))


def load_config(path: str, defaults: dict | None = None) -> dict:
    """JSON configuration over defaults; a missing or malformed file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        found = {}
    return {**(defaults or {}), **(found if isinstance(found, dict) else {})}


def project_type(root: str) -> str:
    """Kind of project by the nearest marker file upwards; the search stops at a ``.git`` folder."""
    at = os.path.abspath(root)
    while True:
        for marker, kind in MARKERS:
            if os.path.exists(os.path.join(at, marker)):
                return kind
        up = os.path.dirname(at)
        if up == at or os.path.isdir(os.path.join(at, ".git")):
            return "unknown"
        at = up


def snapshot(df: DataFrame, folder: str, version: str, head: str, now: int, ttl: int = 86_400) -> DataFrame:
    """A cached scan: reused while version, head and age match, else written again.

    What it was made for stands in a table beside it, on the same file system.
    """
    spark = df.sparkSession
    meta = load_records(spark, f"{folder}/meta", "version string, head string, at bigint").first()
    if not (meta and meta["version"] == version and meta["head"] == head and now - meta["at"] <= ttl):
        df.write.mode("overwrite").parquet(f"{folder}/data")
        save_records(spark.createDataFrame([(version, head, now)], "version string, head string, at bigint").coalesce(1), f"{folder}/meta")
    return spark.read.parquet(f"{folder}/data")
