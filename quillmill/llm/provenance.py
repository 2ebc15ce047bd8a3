"""Files that nobody wrote by hand: generated, minified, vendored, data dumps, binaries.

Method: token shingles (five tokens, comments left out) in two forms. With identifiers and
literals masked, every source file gets a banded MinHash signature. Clusters of at least
three texts whose shapes are alike throughout (``alike``) though their names differ are
generated where they lie within one repository, and blobs, in any repositories, where they
hold only literals. A file whose shingles repeat many times over few distinct ones is a
family of equal statements by itself: generated code where names remain, a data blob where
only literals do. Such a file is a seed: one with a similarity of at least ``similar`` is
enough to make a member within its repository generated, and a member of a literal-only
cluster in any repository a blob. With names kept, MinHash banding proposes
copies, signatures verify a similarity of at least ``similar``, and a cluster that spans
repositories is a vendored library. What needs no neighbours is read from the content
itself: binary bytes, minified layout, lock file structure. Formats of settings, JSON among
them, repeat shapes by nature and take no part in masked clusters.

Equal signatures are compared once. The members of a bucket are compared with two of it,
one of its least and one of its greatest repository; those that match neither, in any
bucket, are compared with all others of their buckets. Both ends of a verified pair count.

Defined results: null content is judged by extension and ``is_binary``; empty text is
hand-written; re-scans are judged like their originals and do not make a second
repository; descriptors may be missing; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .hashing import mix

SHINGLE = 5
BINS, BANDS = 64, 16
FEW = 48  # distinct masked shingles of a seed, at most
# Extensions of binary formats, and names of lock files.
BINARY = set("png jpg jpeg gif ico bmp webp tif tiff pdf zip gz tgz bz2 xz 7z zst rar jar war whl egg so dll dylib exe bin o a lib obj class pyc pyo pyd wasm woff woff2 ttf otf eot mp3 mp4 wav ogg avi mov sqlite db dat npy npz parquet pkl pickle pb onnx".split())
LOCKS = set("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock pipfile.lock gemfile.lock composer.lock go.sum uv.lock pdm.lock mix.lock packages.lock.json flake.lock podfile.lock deno.lock bun.lock".split())
# Formats of lists of settings or rules, which repeat by nature.
CONFIGURATION = set("css scss less sh bash zsh fish bat ps1 toml ini cfg conf properties xml html htm csv tsv".split())
# Words that keep their identity when identifiers are masked.
KEYWORDS = set("if else for while return def class function const let var fn pub struct impl use import package func type match in from async await static export new try except catch raise throw range mut self this None null true false not and or is with as enum extends default switch case break continue loop where trait mod go defer chan map interface lambda yield pass".split())
_TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\#(?![!\[0-9a-fA-F]{2})[^\n]*|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(0[xX][0-9a-fA-F_]+|\d[\w.]*)|([^\W\d]\w*)|([^\s\w])")
_BANNER = re.compile(r"^\s*(?:/\*[\s\S]*?\*/\s*)+")
_OWN_LINE = re.compile(r"^[ \t]*//[^\n]*\n?", re.M)
_CONTROL = re.compile("[\x00-\x08\x0e-\x1a\x1c-\x1f\x7f-\x9f�]")
_LOCK_TEXT = re.compile(r"\"lockfileVersion\"\s*:|(?:^|\n)\[\[package\]\]\n(?:[^\n]*\n){1,6}?(?:checksum|source|files)\b|(?:^|\n)# yarn lockfile v1|\"_meta\":\s*\{\s*\"hash\":\s*\{\s*\"sha256\"")


class _Numbers(dict):
    """A stable number of every token text; a bounded memory that only saves time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        n = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) | 1 << 32
        return n


_NUMBER = _Numbers()


def binary(content: str | None, ext: str, flag) -> bool:
    if content is None:
        return ext in BINARY or flag is True
    if not content:
        return ext in BINARY
    bad = len(_CONTROL.findall(content))
    return "\0" in content or bad > 0.02 * len(content) + 8


def minified(content: str, ext: str) -> bool:
    """Script or style whose lines are long and hold hardly any space."""
    if ext not in ("js", "css", "mjs", "cjs", "html", "svg") or len(content) < 400:
        return False
    content = _OWN_LINE.sub("", _BANNER.sub("", content))
    lines = [x for x in content.split("\n") if x.strip()]
    if not lines:
        return False
    long = sum(len(x) for x in lines if len(x) > 200)
    space = sum(map(content.count, (" ", "\t", "\n", "\r")))
    words = re.findall(r"[^\s\"'`]{120,}", content)
    return long > 0.7 * sum(map(len, lines)) and (space < 0.08 * len(content) or sum(map(len, words)) > 0.5 * len(content))


def _shingles(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(SHINGLE):
            h = h * np.uint64(0x100000001B3) + ids[j : j + n]
    return mix(h)


def signature(distinct: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes; an empty bin borrows from the next."""
    at = np.searchsorted(distinct, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    inside = np.append(distinct, np.uint64(0))[at]
    full = (at < len(distinct)) & ((inside >> np.uint64(58)) == np.arange(BINS, dtype=np.uint64))
    value = (inside >> np.uint64(20)).astype(np.int64) & 0x7FFFFFFF
    where = np.flatnonzero(full)
    source = where[np.searchsorted(where, np.arange(BINS)) % len(where)]
    gap = (source - np.arange(BINS)) % BINS
    return (value[source] + gap * 0x9E3779B1 & 0x7FFFFFFF).astype(np.int32)


def _band_keys(sig: np.ndarray) -> list[int]:
    rows = BINS // BANDS
    with np.errstate(over="ignore"):
        h = np.zeros(BANDS, np.uint64)
        for j in range(rows):
            h = h * np.uint64(0x9E3779B97F4A7C15) + sig[j::rows][:BANDS].astype(np.uint64)
        return (mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))).view(np.int64).tolist()


def features(content: str | None, path: str | None, flag) -> tuple[str, np.ndarray | None, np.ndarray | None, bool]:
    """(kind, named signature, masked signature, whether a seed can be similar to it) of a file.

    kind is "" where neighbours must tell, "literal" where they must and it holds only literals.
    """
    name = re.split(r"[/\\]", path or "")[-1].lower()
    ext = name.rpartition(".")[2] if "." in name else ""
    if binary(content, ext, flag):
        return "binary", None, None, False
    if name in LOCKS or (content and (ext == "lock" or ext == "json") and _LOCK_TEXT.search(content)):
        return "lock", None, None, False
    if not content or ext in ("md", "txt", "rst", "yaml", "yml", "env", "local", "pem", "key"):
        return "", None, None, False
    if minified(content, ext):
        return "minified", None, None, False
    found = _TOKEN.findall(content)
    number = _NUMBER
    named = np.array([number[a or b or c or d] for a, b, c, d in found if a or b or c or d], np.uint64)
    if len(named) < 30:
        return "", None, None, False
    masked = np.array([3 if c and c not in KEYWORDS else 1 if a else 2 if b else number[c or d] for a, b, c, d in found if a or b or c or d], np.uint64)
    names = np.unique(_shingles(named))
    shapes, times = np.unique(_shingles(masked), return_counts=True)
    n, distinct = len(masked), len(shapes)
    literal = int(((masked == 1) | (masked == 2)).sum())
    words = int((masked == 3).sum())
    kind, low = "", None
    if ext not in CONFIGURATION and ext != "json" and n >= 60:
        kind, low = "literal" if words <= 0.05 * n else "", signature(shapes)
    if ext == "json":
        # keys are strings too: only bare values, numbers above all, make data of it
        numbers = int((masked == 2).sum())
        if n >= 200 and (numbers > 0.8 * literal or distinct * 12 <= n and numbers > 0.4 * literal):
            kind, low = "blob", signature(shapes)
    elif ext not in CONFIGURATION and n >= 60 and distinct <= FEW and int(times[times >= 4].sum()) >= 0.75 * len(masked):
        kind = "blob" if kind == "literal" else "family"
    if kind in ("", "literal") and ext not in CONFIGURATION and literal >= 8 and words <= 12:
        # few literals, each very long
        if sum(len(a) for a, *_ in found if len(a) > 60) > 0.8 * len(content):
            kind, low = "blob", signature(shapes)
    # a seed that holds names has at most FEW shapes, the others hold only literals
    return kind, signature(names) if len(names) >= 30 else None, low, kind != "" or distinct * 0.8 <= FEW


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [features(c, p, f if isinstance(f, (bool, np.bool_)) else None) for c, p, f in zip(pdf["content"], pdf["path"], pdf["flag"])]
        yield pd.DataFrame({"file": pdf["file"], "repo": pdf["repo"], "kind": [k for k, *_ in out], "sig": [None if s is None else s.tolist() for _, s, _, _ in out], "bands": [None if s is None else _band_keys(s) for _, s, _, _ in out], "low_sig": [None if s is None else s.tolist() for _, _, s, _ in out], "low": [_band_keys(s) if near and s is not None else None for _, _, s, near in out]})


def _slices(sig: str, n: int) -> Column:
    """Hashes of ``n`` parts of a signature."""
    width = BINS // n
    return F.array(*[F.xxhash64(F.lit(i), F.slice(sig, i * width + 1, width)) for i in range(n)])


def _clustered(low: DataFrame, bins: Callable[[str, str], Column], similar: float, alike: float) -> DataFrame:
    """``file, like`` of the members of masked clusters that need no seed.

    A form is a text by its two signatures, in its repository or, of literals only, anywhere.
    Two are linked that agree in ``alike`` of the masked bins and in less than ``similar`` of
    the named ones; what is linked with two others, and what is linked with that, are the
    members of all clusters of three or more.
    """
    least = math.ceil(alike * BINS)
    n = BINS - least + 2  # what may differ leaves two slices equal; one alone has 20 times the candidates
    place = F.when(F.col("kind") == "literal", F.lit("any")).otherwise(F.col("repo").cast("string"))
    low = low.withColumn("place", place).where("place is not null").withColumn("form", F.xxhash64("place", "of", "unit"))
    rows = low.select("form", "place", _slices("low_sig", n).alias("x"))
    keys = [F.xxhash64("place", F.lit(i), F.lit(j), F.col("x")[i], F.col("x")[j]) for i, j in combinations(range(n), 2)]
    rows = rows.select("form", F.explode(F.array(*keys)).alias("band")).distinct()
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.array(F.min("form"), F.max("form")).alias("others")).where("n > 1")
    rows = cut(rows.join(buckets, "band"))
    forms = cut(low.join(rows.select("form").distinct(), "form", "left_semi").groupBy("form").agg(F.first("low_sig").alias("low_sig"), F.first("sig").alias("sig")))

    def links(pairs: DataFrame) -> DataFrame:
        """Both directions of every pair of one shape and other names."""
        both = pairs.where("form <> other").distinct().join(forms, "form").join(forms.toDF("other", "other_low", "other_sig"), "other")
        both = both.where((bins("low_sig", "other_low") >= least) & F.coalesce(bins("sig", "other_sig") < int(similar * BINS), F.lit(True)))
        return both.select(F.explode(F.array(F.struct("form", "other"), F.struct(F.col("other").alias("form"), F.col("form").alias("other")))).alias("x")).select("x.*").distinct()

    def members(found: DataFrame) -> DataFrame:
        cores = found.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
        return cores.unionByName(found.join(cores, "form").select(F.col("other").alias("form"))).distinct()

    # most members are told by two of their bucket, the rest meet all others
    found = cut(links(rows.where("n > 2").select("form", F.explode("others").alias("other"))))
    rest = rows.select("band", "form").join(members(found), "form", "left_anti")
    found = found.unionByName(links(rest.join(rows.select("band", F.col("form").alias("other")), "band").select("form", "other"))).distinct()
    return low.join(members(cut(found)), "form").select("file", F.when(F.col("kind") == "literal", F.lit("blob")).otherwise(F.lit("generated")).alias("like"))


def provenance(files: DataFrame, descriptors: DataFrame, similar: float = 0.8, alike: float = 0.95) -> DataFrame:
    """``file_id, kind, cluster_files, cluster_repos`` of every file that is not hand-written.

    kind: binary, lock, minified, generated, blob or vendored.
    """
    spark_kind = "file bigint, repo bigint, kind string, sig array<int>, bands array<bigint>, low_sig array<int>, low array<bigint>"
    flags = descriptors.select(F.col("file_id").cast("bigint").alias("file"), F.col("is_binary").alias("flag")).groupBy("file").agg(F.max("flag").alias("flag"))
    base = files.select(F.col("file_id").cast("bigint").alias("file"), F.col("repo_id").cast("bigint").alias("repo"), "path", "content")
    # the descriptor matters only where there is no content, so only those rows are joined
    empty = base.where("content is null").drop("content").join(flags, "file", "left").withColumn("content", F.lit(None).cast("string"))
    full = spread(base.where("content is not null")).withColumn("flag", F.lit(None).cast("boolean"))
    shape = full.unionByName(empty.select(*full.columns)).mapInPandas(_features, spark_kind)
    shape = cut(shape)
    # vendored: equal signatures are one unit; a unit of two repositories is a copy as it is
    shape = shape.withColumn("unit", F.xxhash64("sig"))
    units = cut(shape.where("sig is not null").groupBy("unit").agg(F.min("repo").alias("low"), F.max("repo").alias("high"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    rows = units.select("unit", "low", "high", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("low").alias("low_repo"), F.max("high").alias("high_repo"), F.min_by("unit", F.struct("low", "unit")).alias("low_unit"), F.max_by("unit", F.struct("high", "unit")).alias("high_unit")).where("low_repo < high_repo")
    sigs = units.select("unit", "sig")

    def bins(one: str, other: str) -> Column:
        """How many bins of two signatures are equal."""
        return F.aggregate(F.zip_with(one, other, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)

    equal = bins("sig", "other_sig")

    def copies(pairs: DataFrame) -> DataFrame:
        """Both ends of every pair that is similar enough."""
        links = pairs.join(sigs, "unit").join(sigs.select(F.col("unit").alias("other"), F.col("sig").alias("other_sig")), "other").where(equal >= F.lit(int(similar * BINS)))
        return links.select(F.explode(F.array("unit", "other")).alias("unit")).distinct()

    # most copies are found by one of two members of their bucket, the rest meet all others
    pairs = rows.join(buckets, "band").select("unit", F.when(F.col("low") == F.col("low_repo"), F.col("high_unit")).otherwise(F.col("low_unit")).alias("other")).where("unit != other").distinct()
    met = cut(units.where("low < high").select("unit").unionByName(copies(pairs)).distinct())
    rest = rows.join(met, "unit", "left_anti").join(buckets.select("band"), "band", "left_semi")
    others = rows.select("band", F.col("unit").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    pairs = rest.join(others, "band").where("unit != other and least(low, other_low) < greatest(high, other_high)").select("unit", "other").distinct()
    vendored = met.unionByName(copies(pairs)).distinct().withColumn("cluster", F.lit(True))
    # families and blobs: what is similar to a seed, in the seed's repository or, of literals only, in any
    low = shape.where("low_sig is not null").withColumn("of", F.xxhash64("low_sig")).withColumn("seed", F.col("kind").isin("family", "blob"))
    places = low.where("low is not null").withColumn("place", F.explode(F.when(F.col("kind") == "family", F.array("repo")).when(F.col("kind") == "blob", F.array(F.lit(None).cast("bigint"))).otherwise(F.array(F.col("repo"), F.lit(None).cast("bigint")))))
    places = places.select("seed", "of", F.coalesce(F.col("place").cast("string"), F.lit("any")).alias("place"), F.explode("low").alias("band")).distinct()
    seeds, asked = places.where("seed").drop("seed"), places.where("not seed").drop("seed")
    shapes = low.where("low is not null").groupBy("of").agg(F.first("low_sig").alias("sig"))
    ends = seeds.groupBy("place", "band").agg(F.array_distinct(F.array(F.min("of"), F.max("of"))).alias("others"))

    def members(pairs: DataFrame) -> DataFrame:
        """Those of ``of, place, other`` that are similar enough."""
        both = pairs.distinct().join(shapes, "of").join(shapes.select(F.col("of").alias("other"), F.col("sig").alias("other_sig")), "other")
        return both.where(equal >= F.lit(int(similar * BINS))).select("of", "place").distinct()

    near = cut(members(asked.join(ends, ["place", "band"]).select("of", "place", F.explode("others").alias("other"))))
    # those that match neither end of a bucket meet all its seeds
    rest = asked.join(near, ["of", "place"], "left_anti").join(ends.where(F.size("others") > 1).select("place", "band"), ["place", "band"], "left_semi")
    near = near.unionByName(members(rest.join(seeds.withColumnRenamed("of", "other"), ["place", "band"]).select("of", "place", "other")))
    near = near.groupBy("of", "place").agg(F.lit(True).alias("near"))
    own = low.where("not seed").select("file", "of", F.col("repo").cast("string").alias("repo"))
    like = own.join(near.where("place <> 'any'").withColumnRenamed("place", "repo"), ["of", "repo"]).select("file", F.lit("generated").alias("like")).unionByName(own.join(near.where("place = 'any'"), "of").select("file", F.lit("blob").alias("like")))
    like = like.unionByName(_clustered(low.where("not seed"), bins, similar, alike)).groupBy("file").agg(F.max("like").alias("like"))
    # the size of a cluster: files and repositories of the fullest bucket
    bands = low.join(like, "file", "left").where("seed or like is not null").select("file", "repo", F.explode(_slices("low_sig", BANDS)).alias("band"))
    groups = bands.groupBy("band").agg(F.count("*").alias("cluster_files"), F.approx_count_distinct("repo").alias("cluster_repos"))
    families = bands.join(groups, "band").groupBy("file").agg(F.max("cluster_files").alias("cluster_files"), F.max("cluster_repos").alias("cluster_repos"))
    out = shape.select("file", "kind", "unit").join(vendored, "unit", "left").join(families, "file", "left").join(like, "file", "left")
    label = F.when(F.col("kind") == "family", "generated").when(~F.col("kind").isin("", "literal"), F.col("kind")).otherwise(F.coalesce("like", F.when(F.col("cluster").isNotNull(), "vendored")))
    return out.withColumn("label", label).where("label is not null").select(F.col("file").alias("file_id"), F.col("label").alias("kind"), F.coalesce("cluster_files", F.lit(1)).alias("cluster_files"), F.coalesce("cluster_repos", F.lit(1)).alias("cluster_repos"))


def handwritten(files: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The files that remain: with content, and not found by ``provenance``."""
    return files.where("content is not null").join(provenance(files, descriptors).select("file_id"), "file_id", "left_anti")
