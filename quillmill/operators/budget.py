"""Choosing files under a token budget: greedy with skip, hybrid, and the adaptive allocator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def fold(rows: Iterable[tuple], left: int) -> tuple[list[tuple], int]:
    """Take every row whose full, else whose reduced cost still fits; skip it otherwise and go on."""
    kept = []
    for key, full, reduced in rows:
        if full <= left:
            kept.append((key, "full", full))
            left -= full
        elif reduced is not None and reduced <= left:
            kept.append((key, "reduced", reduced))
            left -= reduced
    return kept, left


def greedy(df: DataFrame, key: str, order: list, full: str, budget: int, reduced: str | None = None, batch: int = 20_000) -> DataFrame:
    """``key, method, cost`` of the rows that a sequential greedy pass with skip keeps.

    The pass is exact but never holds the relation: each round takes the next ``batch``
    rows, in order, among those that still fit what is left of the budget (a distributed
    top-k), and folds them. Only keys and costs move; what is kept is bounded by the budget
    over the least cost, and free rows are kept without being collected. ``order`` must end in
    a unique key.
    """
    spark = df.sparkSession
    costs = df.select(F.col(key).alias("key"), F.col(full).cast("bigint").alias("full"), (F.col(reduced) if reduced else F.lit(None)).cast("bigint").alias("reduced"), F.struct(*order).alias("rank")).where("full is not null")
    # costs come from contents: computed once, then only keys, costs and ranks are read
    costs = cut(costs)
    free = costs.where("full = 0").select("key", F.lit("full").alias("method"), F.col("full").alias("cost"))
    costs = costs.where("full > 0")
    left, kept, after = budget, [], None
    while True:
        open_ = costs.where((F.col("full") <= left) | (F.col("reduced") <= left))
        if after is not None:
            open_ = open_.where(F.col("rank") > F.struct(*[F.lit(x).cast(f.dataType) for x, f in zip(after, costs.schema["rank"].dataType.fields)]))
        rows = open_.orderBy("rank").limit(batch).collect()
        if not rows:
            break
        took, left = fold(((r["key"], r["full"], r["reduced"]) for r in rows), left)
        kept += took
        after = tuple(rows[-1]["rank"])
        if len(rows) < batch:
            break
    kind = costs.schema["key"].dataType.simpleString()
    return spark.createDataFrame(kept, f"key {kind}, method string, cost bigint").unionByName(free).withColumnRenamed("key", key)


def adaptive(df: DataFrame, key: str, tier: str, skeleton: str, full: str, budget: int) -> DataFrame:
    """``key, level``: full, skeleton or drop for every file.

    All files start as skeletons. Where these fit, files are made full while that fits,
    Core first, then Config, Tests and Other, in key order; else files are dropped (see
    ``adaptive_drop``) and none is made full.
    """
    base = df.select(key, F.col(tier).alias("tier"), F.col(skeleton).cast("bigint").alias("small"), F.col(full).cast("bigint").alias("large"))
    base = cut(base)
    needed = base.agg(F.coalesce(F.sum("small"), F.lit(0))).first()[0]
    if needed > budget:
        gone = adaptive_drop(base, key, "tier", "small", budget).select(key, F.lit("drop").alias("level"))
    else:
        rank = F.when(F.col("tier") == "core", 0).when(F.col("tier") == "config", 1).when(F.col("tier") == "tests", 2).otherwise(3)
        steps = base.withColumn("rank_", rank).withColumn("step", F.greatest(F.col("large") - F.col("small"), F.lit(0)))
        gone = greedy(steps, key, ["rank_", key], "step", budget - needed).select(key, F.lit("full").alias("level"))
    return base.select(key).join(gone, key, "left").withColumn("level", F.coalesce("level", F.lit("skeleton")))


def applied(df: DataFrame, levels: DataFrame, key: str, content: str, skeleton: str) -> DataFrame:
    """Files with the content their level asks for; dropped ones are left out."""
    kept = df.join(levels, key).where("level <> 'drop'")
    return kept.withColumn(content, F.when(F.col("level") == "full", F.col(content)).otherwise(F.col(skeleton)))


def adaptive_drop(df: DataFrame, key: str, tier: str, cost: str, budget: int) -> DataFrame:
    """Files the allocator drops when skeletons alone exceed the budget.

    Drop order is Other, Tests, Config, Core, in key order inside a tier; a file is dropped
    while what remains is still above the budget. The running total is taken over tiers
    first and only inside a tier by rows, in key ranges.
    """
    rank = F.when(F.col(tier) == "other", 0).when(F.col(tier) == "tests", 1).when(F.col(tier) == "config", 2).otherwise(3)
    base = cut(df.select(key, F.col(tier).alias("tier"), F.col(cost).cast("bigint").alias("cost"), rank.alias("r")))
    # ranges of keys: sums of ranges are small, rows are ordered only inside one
    ranged = base.withColumn("part", F.floor(F.col(key) / 4096))
    sums = ranged.groupBy("r", "part").agg(F.sum("cost").alias("s"))
    before = sums.withColumn("start", F.coalesce(F.sum("s").over(Window.orderBy("r", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("s").over(Window.partitionBy(F.lit(1)))).drop("s")
    inner = Window.partitionBy("r", "part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(before, ["r", "part"]).withColumn("gone", F.col("start") + F.sum("cost").over(inner) - F.col("cost"))
    return run.where(F.col("total") - F.col("gone") > budget).select(key, "tier", "cost")


def report(kept: DataFrame, budget: int) -> DataFrame:
    """One row: kept files, used tokens, share of the budget, rest."""
    used = F.coalesce(F.sum("cost"), F.lit(0))
    return kept.agg(F.count("*").alias("kept"), used.alias("used"), F.round(used / F.lit(budget) * 100, 4).alias("used_percent"), F.greatest(F.lit(budget) - used, F.lit(0)).alias("remaining"))
