"""Evaluation items that leaked into a corpus, whole, in part or reworded.

Method: Wu-Manber multi-pattern search over words. Every run of ``M`` words of an item is
a pattern. A shift table over blocks of two words tells at each position whether a pattern
can end there (shift 0) and how far the window may move otherwise; for the remaining
positions the hash of the pattern's suffix selects a bucket of item positions, and direct
comparison of the words along the diagonal confirms how far item and text agree.

Direct comparison scores a diagonal with +1 for an equal and -``penalty`` for a different
word and keeps the maximal segments; segments in the item's order are chained into at
most two stretches that lie near each other. A document contains an item when the chained
words are at least half of the item's. Because sentences are often built alike, a
stretch must agree densely: it needs more than ``penalty`` equal words for every replaced
one ("a few words"), so an item with every fourth word replaced is not found. A second
stretch counts from ``least`` words on, or from a quarter of a short item.

What is compared is bounded only by what this scoring implies (see ``_scan``): no item that
it would accept is left out before. Items of fewer than ``M`` words are found whole.

Items are split into shards of at most ``shard_words`` words (a bound checked by a count,
not assumed); each shard is sent to the executors as one table and scans the corpus once.

Defined results: null or empty texts contain nothing and null or wordless items are
contained nowhere; repeated documents or items give one row each per id pair; items with
equal text all count; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .hashing import mix

M = 3
WORD = re.compile(r"\w+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|&(?:nbsp|#\d+|#x[0-9a-fA-F]+);")
EMPHASIS = re.compile(r"(?<!\w)_{1,3}(?=\w)|(?<=\w)_{1,3}(?!\w)")
HIDDEN = re.compile("[­​-‏⁠﻿]")
_BITS = 20
APART = 19


def words(text: str) -> list[str]:
    """Words without case, markup, invisible characters and compatibility forms."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    if "<" in text or "&" in text:
        text = TAG.sub(" ", text)
    if "_" in text:
        text = EMPHASIS.sub("", text)
    return WORD.findall(text.lower())


def _key(ids: np.ndarray, m: int) -> np.ndarray:
    """One 64-bit value for each run of ``m`` word numbers."""
    n = len(ids) - m + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(m):
            h = h * np.uint64(0x100000001B3) + ids[j : j + n].astype(np.uint64)
    return h


class Patterns:
    """The shard's search tables: block shifts, suffix buckets and the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.item_ids: list[int] = []
        seqs = []
        for item, text in items:
            w = words(text or "")
            if w:
                seqs.append(np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], np.int64))
                self.item_ids.append(item)
        self.size = np.array([len(s) for s in seqs], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64) if seqs else np.zeros(1, np.int64)
        self.words = np.concatenate(seqs) if seqs else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(seqs)), self.size)
        keys, places = [], []
        for s, at in zip(seqs, self.start):
            m = min(M, len(s))
            if m == M:
                keys.append(_key(s, M))
                places.append(at + np.arange(len(s) - M + 1))
        self.short = [i for i, n in enumerate(self.size) if n < M]
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        p = np.concatenate(places) if places else np.empty(0, np.int64)
        order = np.argsort(k, kind="stable")
        self.place = p[order]
        self.key, first = np.unique(k[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        # shift of a block of two words: 0 where it ends a pattern, else the distance to the window's end
        self.shift = np.full(1 << _BITS, M - 1, np.int8)
        for j in range(M - 1):
            pairs = np.unique(np.concatenate([_key(s[j : len(s) - (M - 2 - j)], 2) for s in seqs if len(s) >= M])) if len(k) else np.empty(0, np.uint64)
            slot = self.slot(pairs)
            self.shift[slot] = np.minimum(self.shift[slot], M - 2 - j)

    @staticmethod
    def slot(pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) >> np.uint64(64 - _BITS)).astype(np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, item position) of every pattern occurrence."""
        none = np.empty(0, np.int64)
        if len(ids) < M or not len(self.key):
            return none, none
        # positions whose block has a positive shift cannot end a pattern and are skipped
        ends = np.flatnonzero(self.shift[self.slot(_key(ids[1:], 2))] == 0)
        ends = ends[(ids[ends] > 0) & (ids[ends + 1] > 0) & (ids[ends + 2] > 0)]
        if not len(ends):
            return none, none
        k = ids[ends].astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in (1, 2):
                k = k * np.uint64(0x100000001B3) + ids[ends + j].astype(np.uint64)
        b = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        ok = self.key[b] == k
        ends, b = ends[ok], b[ok]
        n = self.first[b + 1] - self.first[b]
        offset = np.repeat(np.cumsum(n) - n, n)
        where = self.place[np.repeat(self.first[b], n) + np.arange(n.sum()) - offset]
        return np.repeat(ends, n), where


def segments(equal: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """Maximal scoring runs (start, end, equal words) of a diagonal, two equal words at least."""
    out, score, best, s, e = [], 0.0, 0.0, -1, -1
    for i, x in enumerate(equal.tolist()):
        if x:
            if s < 0:
                s, score, best = i, 0.0, 0.0
            score += 1
            if score >= best:
                best, e = score, i + 1
        elif s >= 0:
            score -= penalty
            if score <= 0 or best - score > 3 * penalty:
                out.append((s, e))
                s = -1
    if s >= 0:
        out.append((s, e))
    return [(s, e, int(equal[s:e].sum())) for s, e in out if e - s >= 2]


def chained(parts: list[tuple[int, int, int, int]], penalty: float, join: int, near: int, least: int) -> int:
    """Most words of a chain of parts (item start, item end, text start, words) in order, in two stretches at most.

    Parts closer than ``join`` words make one stretch when bridging the gap pays: every
    word skipped costs ``penalty``. A second stretch of at least ``least`` words may
    begin within ``near`` words of the first.
    """
    parts = sorted(parts)
    score, count, first = [], [], []
    for x, (s, e, t, n) in enumerate(parts):
        top, words_, begin = n - penalty * (e - s - n), n, x
        for y in range(x):
            s0, e0, t0, _ = parts[y]
            over = max(0, e0 - s, t0 + e0 - s0 - t)
            gap = max(s - e0, t - (t0 + e0 - s0), 0)
            if s0 >= s or t0 >= t or over >= n or gap > join:
                continue
            # a shift of the diagonal without a gap is one word inserted or dropped
            bridge = score[y] - penalty * max(gap, 1)
            if bridge > 0 and bridge + n - penalty * (e - s - n) - over > top:
                top, words_, begin = bridge + n - penalty * (e - s - n) - over, count[y] + n - over, first[y]
        score.append(top)
        count.append(words_)
        first.append(begin)
    most = max(count, default=0)
    for x in range(len(parts)):
        if count[x] < least:
            continue
        s, t = parts[first[x]][0], parts[first[x]][2]
        for y in range(len(parts)):
            e0, end0 = parts[y][1], parts[y][2] + parts[y][1] - parts[y][0]
            if count[y] >= least and e0 <= s and 0 <= t - end0 <= near:
                most = max(most, count[x] + count[y])
    return most


def _scan(p: Patterns, share: float, penalty: float, join: int, near: int, least: int):
    least_words = int(M / share)  # items of which M words are enough

    def contained(w: list[str]) -> list[tuple[int, int, int]]:
        get = p.number.get
        ids = np.array([get(x, 0) for x in w], np.int64)
        out = []
        for i in p.short:
            s = p.words[p.start[i] : p.start[i + 1]]
            if len(ids) >= len(s) and any((ids[j : j + len(s)] == s).all() for j in range(len(ids) - len(s) + 1)):
                out.append((i, len(s), len(s)))
        at, where = p.hits(ids)
        if not len(at):
            return out
        # consecutive hits of one diagonal are one run of equal words
        off = len(p.words)
        key = np.sort(((at - where + off) << 32) | at)
        cuts = np.flatnonzero(np.diff(key) != 1) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        head = key[lo]
        begin = head & 0xFFFFFFFF
        place = begin - ((head >> 32) - off)
        item = p.owner[place]
        length = hi - lo + M - 1
        # a stretch goes on behind a replaced word only where four equal words led it, so an item
        # without such a run has runs of M words at most
        leading = np.zeros(len(p.size), bool)
        leading[item[(length > M) | (p.size[item] <= least_words)]] = True
        keep = leading[item]
        if not keep.any():
            return out
        begin, place, item, length = begin[keep], place[keep], item[keep], length[keep]
        # runs of a diagonal that a segment can join: it ends where its score falls by more than
        # 3 * penalty, which a gap without a run of M words does within APART words (in it, two
        # equal words at most stand between two replaced ones)
        ends = begin + length
        gap = np.append(APART + 1, begin[1:] - ends[:-1])
        joins = np.append(False, (item[1:] == item[:-1]) & (np.diff(begin - place) == 0)) & (gap <= APART)
        # a lone run of M words leads no stretch, and goes on with one only close behind its end
        lone = (length == M) & ~joins & ~np.append(joins[1:], False) & (p.size[item] > least_words)
        order = np.lexsort((begin, item))
        reach = np.maximum.accumulate((item[order] << 32) + ends[order])
        behind = np.zeros(len(begin), bool)
        behind[order[1:]] = reach[:-1] >= (item[order[1:]] << 32) + begin[order[1:]] - join
        keep = ~lone | behind
        if not keep.all():
            begin, place, item, length, ends, joins, gap = begin[keep], place[keep], item[keep], length[keep], ends[keep], joins[keep], gap[keep]
        cluster = np.cumsum(~joins) - 1
        # equal words a run stands for: its own and, of the gap before it but for its ends, two of three
        inner = np.maximum(gap - 2, 0)
        most = length + np.where(joins, inner - inner // 3, 0)
        # what is contained lies in a window of the text; two neighbouring cells of a window's
        # length hold every window
        wide = p.size[item] * 4 // 3 + near
        cell = (item << 32) | (begin // wide)
        cells, inverse = np.unique(cell, return_inverse=True)
        total = np.bincount(inverse, weights=most)
        after = np.searchsorted(cells, cells + 1)
        after_ok = (after < len(cells)) & (cells[np.minimum(after, len(cells) - 1)] == cells + 1)
        both = total + np.where(after_ok, total[np.minimum(after, len(cells) - 1)], 0)
        good = both >= share * p.size[cells >> 32]
        if not good.any():
            return out
        # a cluster counts as a whole where one of its runs does
        chosen = np.union1d(np.flatnonzero(good), after[good & after_ok])
        inside = np.zeros(cluster[-1] + 1, bool)
        inside[cluster[np.isin(inverse, chosen)]] = True
        lead = np.flatnonzero(~joins)[inside]
        last = np.append(np.flatnonzero(~joins)[1:], len(begin))[inside] - 1
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for x, y, i, t, w, m in zip(lead.tolist(), last.tolist(), item[lead].tolist(), begin[lead].tolist(), place[lead].tolist(), length[lead].tolist()):
            s0 = int(p.start[i])
            parts = found.setdefault(i, [])
            if x == y:
                parts.append((w - s0, w - s0 + m, t, m))
                continue
            n = int(ends[y]) - t
            for s, e, m in segments(p.words[w : w + n] == ids[t : t + n], penalty):
                if m >= M:
                    parts.append((w - s0 + s, w - s0 + e, t + s, m))
        for i, parts in found.items():
            n = int(p.size[i])
            if sum(x[3] for x in parts) >= share * n:
                m = chained(parts, penalty, join, near, min(least, max(M, n // 4)))
                if m >= share * n:
                    out.append((i, m, n))
        return out

    return contained


def _search(tables, share: float, penalty: float, join: int, near: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = tables.value
        contained = _scan(patterns, share, penalty, join, near, least)
        for pdf in batches:
            rows = [(doc, patterns.item_ids[i], m, n) for doc, text in zip(pdf["doc_id"], pdf["text"]) for i, m, n in contained(words(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched_words", "item_words"]).astype("int64")

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = 0.5, penalty: float = 3.0, join: int = 8, near: int = 60, least: int = 8, shard_words: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, matched_words, item_words``: documents that contain at least ``share`` of an item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    texts = spread(texts)
    wanted = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    # characters bound the words; the number of shards follows the items, never the corpus
    total = wanted.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // (4 * shard_words)))
    out = None
    for s in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s)
        tables = spark.sparkContext.broadcast(Patterns(sorted((r["item_id"], r["text"]) for r in own.toLocalIterator())))
        part = texts.mapInPandas(_search(tables, share, penalty, join, near, least), "doc_id bigint, item_id bigint, matched_words bigint, item_words bigint")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, suite, documents, most_words, item_words``: leaked items with the number of documents that hold them."""
    n = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("matched_words").alias("most_words"), F.max("item_words").alias("item_words"))
    return n.join(items.select("item_id", "suite").dropDuplicates(["item_id"]), "item_id").select("item_id", "suite", "documents", "most_words", "item_words")
