"""Long exact spans shared between records.

Method: recurring passages are confirmed first (winnowed fingerprints of ``k`` code points
that occur in more than one text), then compiled into sharded Aho-Corasick automata
(pyahocorasick), and every text that holds a recurring passage is streamed through the
automata of the passages' owners, which locates every occurrence. Each occurrence pair is
extended by exact comparison; only runs of at least ``min_chars`` count.

Winnowing with window ``min_chars - k + 1`` is exact: any common run of ``min_chars``
code points has a fingerprint that both texts select, so no pair is lost. A passage is
sharded by its owner (the least document that has it), and a text travels only to shards
of passages it holds, so the work follows the sharing and not (texts x shards).

Shards follow what travels: a passage's holders are counted in characters, and an owner
whose passages call for more than ``shard_chars`` of text is split over several shards.

Groups larger than ``hot`` are refined before any text is moved: each occurrence is
replaced by windows of ``min_chars - step`` code points at every ``step`` offset around
it (a text is winnowed again for this, as only first positions were kept), so boilerplate shorter than the limit falls apart and only groups that are (almost)
all true pairs stay together; these are split into blocks of ``block`` texts.

Before texts are joined with the documents that call for them, a bitmap of those documents'
hashes keeps most of the others from being shuffled; the join alone decides.

Defined results: null text, empty text and texts shorter than ``min_chars`` share
nothing; exact copies are handled once and expanded at the end; a null id is dropped, as
no pair can name it; repeated ids with equal text count once, and of several texts under
one id the one of least digest counts; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread
from .hashing import codes, rolling, winnow

MIN_CHARS = 400
K = 200


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, rep, chars``: each record with the least id that has the same text."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.sha2(text_col, 256).alias("digest"), F.char_length(text_col).alias("chars")).where("doc is not null and digest is not null")
    base = base.groupBy("doc").agg(F.min(F.struct("digest", "chars")).alias("t")).select("doc", "t.*")
    # groups of copies may be large: aggregate (with map-side combine) and join, no window
    least = base.groupBy("digest").agg(F.min("doc").alias("rep"))
    return base.join(least, "digest").select("doc", "rep", "chars", "digest")


def _fingerprints(k: int, w: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                h = rolling(codes(text), k)
                at = winnow(h, w)
                hs, first = np.unique(h[at], return_index=True)
                out.append(pd.DataFrame({"h": hs.view(np.int64), "doc": doc, "pos": at[first].astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _windows(k: int, w: int, length: int, step: int, reach: int):
    """Refined fingerprints of every occurrence of a hot passage: windows of ``length`` at every ``step`` offset to the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, hots in zip(pdf["doc"], pdf["text"], pdf["hots"]):
                values = codes(text)
                fine = rolling(values, k)
                at = winnow(fine, w)
                places = at[np.isin(fine[at].view(np.int64), np.asarray(hots, np.int64))]
                h = rolling(values, length)
                starts = np.zeros(len(h), bool)
                for l in range(0, reach + 1, step):
                    s = places - l
                    starts[s[(s >= 0) & (s < len(h))]] = True
                at = np.flatnonzero(starts)
                if len(at):
                    hs, first = np.unique(h[at], return_index=True)
                    rows.append(pd.DataFrame({"h": hs.view(np.int64), "doc": doc, "pos": at[first].astype(np.int32)}))
            if rows:
                yield pd.concat(rows, ignore_index=True)

    return run


def _grow(a: str, i: int, b: str, j: int, step: int = 1 << 10) -> int:
    """Length of the common run of a[i:] and b[j:], by slices compared in C."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n < most:
        m = min(step, most - n)
        if a[i + n : i + n + m] == b[j + n : j + n + m]:
            n += m
        else:
            lo, hi = 0, m
            while hi - lo > 1:
                mid = (lo + hi) // 2
                if a[i + n + lo : i + n + mid] == b[j + n + lo : j + n + mid]:
                    lo = mid
                else:
                    hi = mid
            return n + lo
    return n


def _back(a: str, i: int, b: str, j: int, step: int = 1 << 12) -> int:
    """Length of the common run that ends before a[i] and b[j]."""
    n, most = 0, min(i, j)
    while n < most:
        m = min(step, most - n)
        got = _grow(a[i - n - m : i - n][::-1], 0, b[j - n - m : j - n][::-1], 0)
        n += got
        if got < m:
            break
        step = min(2 * step, 1 << 20)
    return n


def _called(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``texts`` less most of those whose ``doc`` is not in ``docs``; none that is in it is lost.

    The bitmap has eight bits a document, at most 32 MB of them: beyond that it lets more through.
    """
    bits = min(1 << 28, max(1 << 15, 1 << (8 * docs.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc"), F.lit(bits))
    marks = docs.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    held = texts.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(marks), "bucket")
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*texts.columns)


def _match_shard(min_chars: int, every: bool):
    """Within a shard: automaton of its passages over its texts, then exact extension.

    ``every``: all maximal runs of a pair, else the longest.
    """

    def run(key, texts: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        text = dict(zip(texts["doc"].tolist(), texts["text"].tolist()))
        machine = ahocorasick.Automaton()
        for owner, pos, length in zip(passages["doc"].tolist(), passages["pos"].tolist(), passages["length"].tolist()):
            if owner in text:
                machine.add_word(text[owner][pos : pos + length], length)
        where: dict[str, list[tuple[int, int]]] = {}
        if len(machine):
            machine.make_automaton()
            for doc in sorted(text):
                t = text[doc]
                for end, length in machine.iter(t):
                    where.setdefault(t[end + 1 - length : end + 1], []).append((doc, end + 1 - length))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        runs: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # runs known on a diagonal
        for passage, places in where.items():
            for x in range(len(places)):
                a, i = places[x]
                for b, j in places[x + 1 :]:
                    if a == b:
                        continue
                    if any(s <= i < e for s, e in runs.get((a, b, i - j), ())):
                        continue
                    ahead = _grow(text[a], i, text[b], j)
                    back = _back(text[a], i, text[b], j)
                    runs.setdefault((a, b, i - j), []).append((i - back, i + ahead))
                    if ahead + back >= min_chars:
                        if (a, b) not in found or found[a, b][2] < ahead + back:
                            found[a, b] = (i - back, j - back, ahead + back)
        if every:
            rows = [(a, b, lo, lo - gap, hi - lo) for (a, b, gap), known in runs.items() for lo, hi in known if hi - lo >= min_chars]
        else:
            rows = [(a, b, *v) for (a, b), v in found.items()]
        return pd.DataFrame(rows, columns=["doc_a", "doc_b", "start_a", "start_b", "chars"]).astype("int64")

    return run


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, k: int = K, hot: int = 64, step: int = 8, block: int = 2000, every: bool = False, shard_chars: int = 32_000_000) -> tuple[DataFrame, DataFrame]:
    """``(spans, members)``: the longest shared run of every pair of different texts, and each record's text class.

    ``spans``: ``doc_a, doc_b, start_a, start_b, chars`` between class representatives,
    ``doc_a < doc_b``; ``members``: ``doc, rep, chars``. With ``every``, all maximal runs of
    at least ``min_chars`` instead of the longest of a pair.
    """
    spark = docs.sparkSession
    members = cut(representatives(docs, id_col, text_col))
    reps = members.where((F.col("chars") >= min_chars) & (F.col("doc") == F.col("rep"))).select("doc", "chars", "digest")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.char_length("text") >= min_chars)
    # every copy is fingerprinted; rows of copies leave before anything is shuffled by text
    fps = cut(spread(texts).mapInPandas(_fingerprints(k, min_chars - k + 1), "h bigint, doc bigint, pos int"))
    fps = fps.join(reps.select("doc", "chars"), "doc").dropDuplicates(["h", "doc"])
    counted = fps.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("owner"), F.sum("chars").alias("held")).where("n > 1")
    passages = cut(fps.join(counted, "h").withColumn("length", F.lit(k)))
    warm = passages.where(F.col("n") <= hot)
    if not passages.where(F.col("n") > hot).isEmpty():
        places = passages.where(F.col("n") > hot).groupBy("doc").agg(F.collect_set("h").alias("hots"))
        window = min_chars - step
        named = _called(texts, places.select("doc")).withColumn("digest", F.sha2("text", 256))
        fine = named.join(reps.select("doc", "digest").join(places, "doc"), ["doc", "digest"]).select("doc", "text", "hots").mapInPandas(_windows(k, min_chars - k + 1, window, step, window - k), "h bigint, doc bigint, pos int").dropDuplicates(["h", "doc"])
        fine = fine.join(reps.select("doc", "chars"), "doc")
        again = fine.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("owner"), F.sum("chars").alias("held")).where("n > 1")
        warm = cut(warm.unionByName(fine.join(again, "h").withColumn("length", F.lit(window))))
    # what each owner's passages call for at most, and so how many shards its passages take
    owners = warm.where("doc = owner").groupBy("owner").agg(F.sum("held").alias("held"))
    total = owners.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    shards = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // shard_chars))
    heavy = owners.where(F.col("held") > shard_chars).select("owner", F.ceil(F.col("held") / shard_chars).alias("over"))
    warm = warm.join(heavy, "owner", "left").withColumn("over", F.coalesce("over", F.lit(1)))
    # blocks: a passage in n texts is matched by pairs of blocks of at most ``block`` texts
    keyed = warm.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("doc", "pos", "length", "h", F.pmod(F.xxhash64("owner", F.pmod(F.xxhash64("h"), F.col("over"))), F.lit(shards)).alias("shard"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    key = ["shard", "lo", "hi"]
    # one text is enough to spell a passage: the least of each block pair
    spelled = keyed.groupBy(*key, "h", "length").agg(F.min_by(F.struct("doc", "pos"), F.col("doc")).alias("at")).select(*key, "length", F.col("at.doc").alias("doc"), F.col("at.pos").alias("pos"))
    routed = keyed.select(*key, "doc").distinct()
    named = _called(texts, warm.select("doc").distinct()).withColumn("digest", F.sha2("text", 256))
    routed = routed.join(reps.select("doc", "digest"), "doc").join(named, ["doc", "digest"]).drop("digest")
    spans = routed.groupBy(*key).cogroup(spelled.toDF("shard_", "lo_", "hi_", "length", "doc", "pos").groupBy("shard_", "lo_", "hi_")).applyInPandas(_match_shard(min_chars, every), "doc_a bigint, doc_b bigint, start_a bigint, start_b bigint, chars bigint")
    if every:
        return spans.distinct(), members.drop("digest")  # a run is found in every shard that owns a passage of it
    spans = spans.groupBy("doc_a", "doc_b").agg(F.max_by(F.struct("start_a", "start_b", "chars"), F.struct("chars", -F.col("start_a"), -F.col("start_b"))).alias("s")).select("doc_a", "doc_b", "s.*")
    return spans, members.drop("digest")


def shared_pairs(docs: DataFrame, **options) -> DataFrame:
    """``doc_a, doc_b`` (``doc_a < doc_b``) of all records with a common run, copies expanded."""
    min_chars = options.get("min_chars", MIN_CHARS)
    spans, members = shared_spans(docs, **options)
    a, b = members.select(F.col("rep").alias("doc_a"), F.col("doc").alias("x")), members.select(F.col("rep").alias("doc_b"), F.col("doc").alias("y"))
    across = spans.select("doc_a", "doc_b").join(a, "doc_a").join(b, "doc_b").select("x", "y")
    long = members.where(F.col("chars") >= min_chars)
    copies = long.select("rep", F.col("doc").alias("x")).join(long.select("rep", F.col("doc").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_runs(docs: DataFrame, **options) -> DataFrame:
    """``doc_a, doc_b, start_a, start_b, chars``: every maximal run of every pair of different texts.

    A text is named by the least record that has it.
    """
    return shared_spans(docs, every=True, **options)[0]


def shared_share(docs: DataFrame, **options) -> DataFrame:
    """``doc, rep, chars, shared_chars, shared_share, partner_texts``: how much of each record occurs elsewhere.

    ``rep`` is the record's class of equal texts; with ``shared_runs``, whose pairs are between
    classes, it says all that pairs of records would.

    A record that has an exact copy is shared as a whole when it reaches the limit. Every
    run of each pair of texts counts; runs are united per record before they are summed.
    """
    min_chars = options.get("min_chars", MIN_CHARS)
    spans, members = shared_spans(docs, every=True, **options)
    spans = cut(spans)
    ends = spans.select(F.col("doc_a").alias("rep"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("chars")).alias("e")).unionByName(spans.select(F.col("doc_b").alias("rep"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("chars")).alias("e")))
    # of the runs that begin at one place only the furthest adds
    ends = ends.groupBy("rep", "s").agg(F.max("e").alias("e"))
    # running end of all earlier intervals: what an interval adds is what lies beyond it
    w = Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    new = ends.withColumn("before", F.max("e").over(w)).withColumn("adds", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("before", F.lit(0)))))
    pairs = spans.select("doc_a", "doc_b").distinct()
    partners = pairs.select(F.col("doc_a").alias("rep")).unionByName(pairs.select(F.col("doc_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("partners"))
    own = new.groupBy("rep").agg(F.sum("adds").alias("own")).join(partners, "rep")
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    out = members.join(own, "rep", "left").join(size, "rep")
    shared = F.when((F.col("n") > 1) & (F.col("chars") >= min_chars), F.col("chars").cast("bigint")).otherwise(F.coalesce("own", F.lit(0)))
    return out.select("doc", "rep", F.col("chars").cast("bigint").alias("chars"), shared.alias("shared_chars"), F.round(F.try_divide(shared, F.col("chars")), 6).alias("shared_share"), F.coalesce("partners", F.lit(0)).alias("partner_texts"))
