"""Matching across languages: equal and similar names, types, confidence, equivalence classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_name
from .classify import match_confidence
from .vectors import blocks


def equal_names(concepts: DataFrame) -> DataFrame:
    """``normal, languages, members``: normal names that occur in more than one language."""
    named = concepts.withColumn("normal", normal_name(F.col("name"))).where("normal <> '' and language is not null")
    return named.groupBy("normal").agg(F.count_distinct("language").alias("languages"), F.count("*").alias("members")).where("languages > 1")


MARKS = ("one", "two", "even", "odd")


def _marks(text: Column) -> list[Column]:
    """Sets of 64 bits: letters that occur, letters that occur twice or more (code points modulo 64), and pairs of neighbours, the text's ends included."""
    padded, zero = F.concat(F.lit(" "), text, F.lit(" ")), F.lit(0).cast("bigint")
    code = lambda i: F.ascii(F.substring(padded, i, F.lit(1)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)))
    letters = F.transform(F.sequence(F.lit(2), F.length(padded) - 1), lambda i: bit(code(i)))
    both = F.aggregate(letters, F.struct(zero.alias("one"), zero.alias("two")), lambda s, b: F.struct(s["one"].bitwiseOR(b).alias("one"), s["two"].bitwiseOR(s["one"].bitwiseAND(b)).alias("two")))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.pmod(code(i) * 37 + code(i + 1), F.lit(128)))
    half = lambda lo: F.aggregate(F.filter(pairs, lambda x: (x >= lo) & (x < lo + 64)), zero, lambda s, x: s.bitwiseOR(bit(x)))
    return [both["one"], both["two"], half(0), half(64)]


def similar(concepts: DataFrame, threshold: float = 0.7, every: int = 50, block: int = 20_000) -> DataFrame:
    """``query, concept_no, score, confidence``: concepts of another language with a similar name.

    The queries are the concepts whose number is divisible by ``every``. Each distinct normal
    name of theirs is compared once with each distinct normal name, in blocks of about
    ``block`` names (a bound on what is broadcast). An edit changes the length by one at most,
    takes away one letter and two pairs of neighbours at most and adds as many; what this rules
    out needs no distance.
    """
    spark = concepts.sparkSession
    named = concepts.select("concept_no", "language", normal_name(F.col("name")).alias("normal")).where("normal <> ''")
    queries = named.where(F.col("concept_no") % every == 0).select(F.col("concept_no").alias("query"), F.col("normal").alias("qn"), F.col("language").alias("ql"))

    def described(names: DataFrame, name: str, tag: str) -> DataFrame:
        return names.select(name, F.length(name).alias(f"{tag}_length"), F.octet_length(name).alias(f"{tag}_bytes"), *[x.alias(f"{tag}_{mark}") for x, mark in zip(_marks(F.col(name)), MARKS)])

    # by number and by no column, so that little data is still compared over all cores and no join takes the partitions over
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = described(named.select("normal").distinct().repartition(parts), "normal", "b")
    longest = F.greatest("a_bytes", "b_bytes")
    # scores are rounded to 6 digits before they meet the threshold
    most = F.floor(longest * (1 - threshold + 1e-6)).cast("int")
    gone = lambda x, y, mark: F.bit_count(F.col(f"{x}_{mark}").bitwiseAND(F.bitwise_not(f"{y}_{mark}")))
    edits = lambda a, b, per: F.greatest(gone("a", "b", a) + gone("a", "b", b), gone("b", "a", a) + gone("b", "a", b)) <= most * per
    near = (F.abs(F.col("a_length") - F.col("b_length")) <= most) & edits("even", "odd", 2) & edits("one", "two", 1) & (F.call_function("levenshtein", F.col("qn"), F.col("normal"), most) >= 0)
    score = F.round(1 - F.levenshtein("qn", "normal") / longest, 6)
    out = None
    for own in blocks(queries.select("qn").distinct(), "qn", block):
        # one condition, cheapest first: a later filter would be put in front of it
        part = names.join(F.broadcast(described(own, "qn", "a")), near & (score >= threshold)).select("qn", "normal", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    found = out.join(queries, "qn").join(named, "normal").where((F.col("language") != F.col("ql")) & (F.col("concept_no") != F.col("query")))
    return found.select("query", "concept_no", "score", match_confidence(F.col("score")).alias("confidence"))
