"""Mixing sources to target shares of the total size.

Method: Efraimidis-Spirakis sampling. Every document gets an exponential key, scaled by
its quality weight; within a source documents are taken in key order until their running
sum of tokens reaches the source's budget. A budget above the source's size first takes
complete epochs and then selects the rest; no source is repeated more than its cap.

The running sum is computed in two levels: token sums of key ranges per source, and exact
order only inside a range. Ranges are cut at quantiles of the source's own scaled keys and
their number follows the source's size, so a source of any size and weight is spread over
tasks.

Without ``total_tokens`` the mixture is the largest in which every source that has
documents still reaches its share. Shares are those of the sources present; an absent
source reaches 0 and is reported.

Defined results: null or empty text is left out; labels are compared without case, space
and punctuation; documents of sources without target are left out; a source whose cap is
null or below 1 is not used; ties of keys go to the document id; repeated ids count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZERS, canonical, counter

QUANTILES = 64
RANGE_ROWS = 20_000


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "weight": pdf["weight"], "tokens": pd.Series(count(pdf["text"].tolist()), dtype="int64")})

    return run


def quality(text: Column) -> Column:
    """Weight between 0.1 and 1: share of letters and white space, less for very short texts."""
    size = F.char_length(text)
    readable = F.char_length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / size
    return F.greatest(F.lit(0.1), readable * F.least(F.lit(1.0), size / 200))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """``(selection, report)``.

    ``selection``: ``doc_id, source, tokens, copies``; ``report``: ``source,
    target_share, available_tokens, budget_tokens, mixed_tokens, reached_share, epochs``.
    """
    goal = targets.select(canonical(F.col("source")).alias("key"), F.col("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats")).dropDuplicates(["key"])
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical(F.col("source")).alias("source"), "text").where("text is not null and text <> '' and source is not null")
    base = base.join(goal.select(F.col("key").alias("source")), "source", "left_semi").withColumn("weight", quality(F.col("text"))).select("doc_id", "source", "weight", "text")
    sized = cut(base.mapInPandas(_count(tokenizer), "doc_id bigint, source string, weight double, tokens bigint"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = sized.withColumn("k", -F.log(u) / F.col("weight"))
    # quantiles of each source, and as many even steps between two as the source's size asks for;
    # they are cut, as an approximate quantile need not come out alike twice
    places = [i / QUANTILES for i in range(1, QUANTILES)]
    scales = cut(keyed.groupBy("source").agg(F.percentile_approx("k", F.array(*map(F.lit, places)), F.lit(10_000)).alias("cuts"), F.min("k").alias("low"), F.max("k").alias("high"), F.ceil(F.count("*") / (QUANTILES * RANGE_ROWS)).alias("steps")))
    scales = scales.select("source", F.concat(F.array("low"), "cuts", F.array("high")).alias("cuts"), "steps")
    q = F.least(F.size(F.filter("cuts", lambda c: c <= F.col("k"))), F.lit(QUANTILES)) - 1
    left, right = F.get("cuts", F.col("q")), F.get("cuts", F.col("q") + 1)
    inside = F.coalesce(F.floor(F.try_divide(F.col("k") - left, right - left) * F.col("steps")), F.lit(0))
    inside = F.least(F.greatest(inside, F.lit(0)), F.col("steps") - 1)
    keyed = keyed.join(scales, "source").withColumn("q", q).withColumn("range", (F.col("q") * F.col("steps") + inside).cast("bigint")).select("doc_id", "source", "tokens", "k", "range")
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"))
    avail = sums.groupBy("source").agg(F.sum("tokens").alias("available")).where("available > 0")
    plan = goal.join(avail.withColumnRenamed("source", "key"), "key", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("usable", (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
    bound = plan.where("usable").agg(F.sum("target_share").alias("present"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("largest"))
    # a handful of rows, one a source: two numbers come to the driver
    row = bound.first()
    present, largest = row["present"] or 1.0, row["largest"] or 0.0
    total = float(total_tokens) if total_tokens is not None else largest * present
    budget = F.when(F.col("usable"), F.least(F.floor(F.lit(total) * F.col("target_share") / F.lit(present)), F.col("available") * F.col("max_repeats"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("budget", budget).withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    per = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of RANGE_ROWS documents
    starts = sums.withColumn("start", F.coalesce(F.sum("tokens").over(per), F.lit(0))).select("source", "range", "start")
    inner = Window.partitionBy("source", "range").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = keyed.join(starts, ["source", "range"]).withColumn("upto", F.col("start") + F.sum("tokens").over(inner))
    chosen = upto.join(plan.select(F.col("key").alias("source"), "name", "epochs", "rest"), "source").withColumn("copies", F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int")).where("copies > 0")
    selection = chosen.select("doc_id", F.col("name").alias("source"), "tokens", "copies")
    mixed = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    done = plan.select(F.col("name").alias("source"), "target_share", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "epochs").join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    report = done.withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))).select("source", "target_share", "available_tokens", "budget_tokens", "mixed_tokens", F.round(F.try_divide("mixed_tokens", "all_tokens"), 6).alias("reached_share"), "epochs")
    return selection, report
