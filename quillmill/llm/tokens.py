"""Token budget per source, language and domain.

Method: a bounded sample of documents is tokenised; per language a regression predicts
tokens from bytes, words, digits, punctuation, upper-case letters, line ends and script
counts; a held-out part of the sample corrects the bias; the regression is applied to
every document by built-in expressions and totals are aggregated. Languages with too few
sampled documents use the regression over all.

The sample has at most ``sample`` documents (a parameter), chosen by hash of the text, so
it does not depend on order or partitioning; everything else covers all documents.

Defined results: null text has 0 tokens and counts as a document; labels are compared
without case, region suffix, space and punctuation; a missing or undetermined language is
told by a classifier of words, ``unknown`` where the text has none of its words; missing
source or domain is ``unknown``; repeated documents count each.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A vocabulary file (ranks, or JSON); the files are never copied.
TOKENIZERS = os.environ.get("QUILLMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# How the byte-level vocabularies cut text before pairs are merged.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FEATURES = ["bytes", "chars", "words", "digits", "punct", "upper", "lines", "wide"]

@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@cache
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(n) for word, n in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """Function from texts to their numbers of tokens.

    A file of ranks is read by the faster library. Where that gives up (runs of white space
    of many thousand characters), the same vocabulary in JSON beside it counts the text.
    """

    def by_json(texts: list[str], at: str = path) -> list[int]:
        return [len(e.ids) for e in _tokenizer(at).encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]

    def by_ranks(texts: list[str]) -> list[int]:
        encode, out = _ranks(path).encode_ordinary, []
        for x in texts:
            try:
                out.append(len(encode(x or "")))
            except BaseException as e:  # noqa: BLE001 - the library's panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
                out += by_json([x], path.removesuffix(".tiktoken") + ".json")
        return out

    return by_ranks if path.endswith(".tiktoken") else by_json


def canonical(label: Column) -> Column:
    """A label without case, surrounding space and the choice of separators; null when nothing is left."""
    c = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-./]+", "_")
    return F.when(c != "", c)


_WORD = re.compile(r"[^\W\d_]+")


class LanguageModel:
    """Naive Bayes over words: which of the labelled languages a text is written in."""

    def __init__(self, labelled: list[tuple[str, str]], words: int = 3000):
        counts: dict[str, Counter] = {}
        for lang, text in labelled:
            counts.setdefault(lang, Counter()).update(set(_WORD.findall(text.lower())))
        texts = Counter(lang for lang, _ in labelled)
        self.languages = sorted(counts)
        # a word's share of the texts of each language, the most telling words first
        share = lambda w, a: (counts[a][w] + 0.5) / (texts[a] + 1.0)
        spread = {w: max(share(w, a) for a in self.languages) - min(share(w, a) for a in self.languages) for w in set().union(*counts.values())} if counts else {}
        best = sorted(spread, key=lambda w: (-spread[w], w))[:words]
        self.weight = {w: [math.log(share(w, a)) for a in self.languages] for w in best}
        self.prior = [math.log(texts[a] / len(labelled)) for a in self.languages]

    def tell(self, text: str | None) -> str:
        seen = [self.weight[w] for w in set(_WORD.findall((text or "").lower())) if w in self.weight]
        if not seen:
            return "unknown"
        scores = [p + sum(s[i] for s in seen) for i, p in enumerate(self.prior)]
        return self.languages[scores.index(max(scores))]


def known_language(label: Column) -> Column:
    """Two-letter language of a label; null where it is missing, ``und`` or no language code."""
    found = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2})(?:[-_][a-z0-9]+)?$", 1)
    return F.when(found != "", found)


def fit_language(rows: DataFrame) -> tuple[LanguageModel, float]:
    """A model from the labelled texts of a sample (``lang, text, h``), and its share of right answers.

    A quarter of them is held out and tells the accuracy; then all are learned.
    """
    got = [(r["lang"], r["text"], r["h"] % 4 == 0) for r in rows.select(known_language(F.col("lang")).alias("lang"), "text", "h").where("lang is not null").collect()]
    learned = LanguageModel([(a, t) for a, t, held in got if not held])
    asked = [(a, t) for a, t, held in got if held]
    right = sum(learned.tell(t) == a for a, t in asked) / len(asked) if asked else 0.0
    return LanguageModel([(a, t) for a, t, _ in got]), right


def clean_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with a column ``language``: the label's, else what the model tells from the text.

    Only texts without a label reach a Python worker.
    """
    @F.pandas_udf("string")
    def tell(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else model.tell(t))

    known = known_language(F.col("lang"))
    guess = tell(F.when(known.isNull(), F.coalesce("text", F.lit(""))))
    return docs.withColumn("language", F.coalesce(known, guess))


def sampled(docs: DataFrame, lang: Column, text: Column, sample: int) -> DataFrame:
    """``lang, text, h`` of the ``sample`` texts of least hash; each text once, null and empty ones never."""
    base = docs.select(lang.alias("lang"), text.alias("text")).where("text is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    # rows far above the least hashes leave where they are read; the order is taken over few
    share = min(1.0, 2.0 * sample / max(docs.count(), 1))
    few = base.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).dropDuplicates(["h"])
    return cut(few.orderBy(F.pmod("h", F.lit(1 << 20)), "h").limit(sample))


def features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(t)
    drop = lambda pattern: (chars - F.char_length(F.regexp_replace(t, pattern, ""))).cast("double")
    return {"bytes": F.octet_length(t).cast("double"), "chars": chars.cast("double"), "words": F.regexp_count(t, F.lit(r"\w+")).cast("double"), "digits": drop("[0-9]"), "punct": drop(r"[\p{Punct}]"), "upper": drop("[A-Z]"), "lines": drop("\n"), "wide": drop(r"[\u0080-\x{10FFFF}]")}


def _counts(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "held": pdf["held"], "x": pdf["x"], "tokens": pd.Series(count(pdf["text"].tolist()), dtype="float64")})

    return run


def _solve(rows: list[tuple[list[float], float]]) -> np.ndarray:
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    scale = np.maximum(np.abs(x).max(axis=0), 1)
    # ridge keeps features that a language does not vary in from taking part
    a = x / scale
    w = np.linalg.solve(a.T @ a + 1e-6 * len(rows) * np.eye(a.shape[1]), a.T @ y)
    return w / scale


class TokenModel:
    """Coefficients and bias of each language; ``""`` is the model over all."""

    def __init__(self, weights: dict[str, np.ndarray], bias: dict[str, float], error: dict[str, float]):
        self.weights, self.bias, self.error = weights, bias, error

    def column(self, lang: Column, x: dict[str, Column]) -> Column:
        def linear(key: str) -> Column:
            out = F.lit(0.0)
            for name, w in zip(FEATURES, self.weights[key]):
                out = out + x[name] * F.lit(float(w * self.bias[key]))
            return F.greatest(out, F.lit(0.0))

        out = linear("")
        for key in sorted(self.weights):
            if key:
                out = F.when(lang == key, linear(key)).otherwise(out)
        return out


def fit(rows: DataFrame, least: int = 60, tokenizer: str = TOKENIZERS) -> TokenModel:
    """A model from a sample ``lang, text, h``."""
    x = features(F.col("text"))
    rows = rows.withColumn("held", F.pmod("h", F.lit(4)) == 0).select("lang", "held", "text", F.array(*[x[f] for f in FEATURES]).alias("x"))
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    got = rows.mapInPandas(_counts(tokenizer), "lang string, held boolean, x array<double>, tokens double").collect()
    weights, bias, error = {}, {}, {}
    for key in ["", *sorted({r["lang"] for r in got if r["lang"]})]:
        own = [(r["held"], list(r["x"]), r["tokens"]) for r in got if not key or r["lang"] == key]
        train, held = [(x, y) for h, x, y in own if not h], [(x, y) for h, x, y in own if h]
        if key and (len(train) < least or len(held) < least // 4):
            continue
        weights[key] = _solve(train) if train else np.array([0.25] + [0.0] * (len(FEATURES) - 1))
        guess, true = sum(float(np.dot(weights[key], x)) for x, _ in held), sum(y for _, y in held)
        bias[key] = true / guess if guess > 0 else 1.0
        # the correction is judged on the other half of what is held out
        one, two = held[::2], held[1::2]
        g1, t1 = sum(float(np.dot(weights[key], x)) for x, _ in one), sum(y for _, y in one)
        g2, t2 = guess - g1, true - t1
        error[key] = abs(g2 * t1 / g1 - t2) / t2 if g1 > 0 and t2 > 0 else 0.0
    return TokenModel(weights, bias, error)


def estimated(docs: DataFrame, sample: int = 4000, tokenizer: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, lang, domain, tokens`` of every document, labels cleaned."""
    rows = sampled(docs, F.col("lang"), F.col("text"), sample)
    told, _ = fit_language(rows)
    model = fit(clean_language(rows, told).select(F.col("language").alias("lang"), "text", "h"), tokenizer=tokenizer)
    named = clean_language(docs, told)
    clean = named.select("doc_id", F.coalesce(canonical(F.col("source")), F.lit("unknown")).alias("source"), F.col("language").alias("lang"), F.coalesce(canonical(F.col("domain")), F.lit("unknown")).alias("domain"), "text")
    return clean.withColumn("tokens", F.round(model.column(F.col("lang"), features(F.col("text")))).cast("bigint")).drop("text")


def accuracy(docs: DataFrame, sample: int = 4000, tokenizer: str = TOKENIZERS) -> DataFrame:
    """``lang, error``: held-out relative error of the totals of each language's regression, ``all`` over everything.

    The row ``told`` holds the share of held-out texts whose language the classifier misses.
    """
    rows = sampled(docs, F.col("lang"), F.col("text"), sample)
    told, right = fit_language(rows)
    model = fit(clean_language(rows, told).select(F.col("language").alias("lang"), "text", "h"), tokenizer=tokenizer)
    out = [(k or "all", float(v)) for k, v in sorted(model.error.items())] + [("told", 1.0 - right)]
    return docs.sparkSession.createDataFrame(out, "lang string, error double")


def totals(docs: DataFrame, sample: int = 4000, tokenizer: str = TOKENIZERS) -> DataFrame:
    """``by, label, documents, tokens``: totals by source, language, domain, and over all."""
    e = estimated(docs, sample, tokenizer)
    cells = e.groupBy("source", "lang", "domain").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    sides = F.explode(F.array(F.struct(F.lit("source").alias("by"), F.col("source").alias("label")), F.struct(F.lit("language").alias("by"), F.col("lang").alias("label")), F.struct(F.lit("domain").alias("by"), F.col("domain").alias("label")), F.struct(F.lit("all").alias("by"), F.lit("all").alias("label"))))
    return cells.select(sides.alias("s"), "documents", "tokens").groupBy("s.by", "s.label").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def file_totals(files: DataFrame, repos: DataFrame, sample: int = 4000, tokenizer: str = TOKENIZERS) -> DataFrame:
    """``language, files, tokens, recorded_files``: file contents by extension, beside what repositories recorded.

    Extensions are compared without case and leading dot, as repositories record them in
    several spellings.
    """
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1))
    lang = F.when(ext != "", ext).otherwise("none")
    model = fit(sampled(files, lang, F.col("content"), sample), tokenizer=tokenizer)
    own = files.select(lang.alias("language"), model.column(lang, features(F.col("content"))).alias("tokens")).groupBy("language").agg(F.count("*").alias("files"), F.round(F.sum("tokens")).cast("bigint").alias("tokens"))
    seen = repos.select(F.explode("languages").alias("k", "n")).select(F.regexp_replace(F.lower(F.trim("k")), r"^\.", "").alias("language"), "n").groupBy("language").agg(F.sum("n").cast("bigint").alias("recorded_files"))
    return own.join(seen, "language", "full")
