"""Change history: churn, observers, drift, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import whole_days
from . import classify


def once(events: DataFrame) -> DataFrame:
    """Every event once: repeated deliveries keep the earliest arrival."""
    rest = [c for c in events.columns if c != "event_no"]
    first = events.groupBy("event_no").agg(F.min_by(F.struct(*rest), F.struct("seen_ts", "ts")).alias("e"))
    return first.select("event_no", "e.*")


def observer(email: Column) -> Column:
    return F.lower(F.trim(email))


def with_now(events: DataFrame) -> DataFrame:
    """Adds ``as_of``, the latest instant of the data, so that results repeat."""
    return events.withColumn("as_of", F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp"))


def churn(events: DataFrame, keys: list[str], windows: tuple[int, int, int] = (30, 90, 365)) -> DataFrame:
    """First and last change, changes inside each window (strictly), age and dormancy in whole days."""
    e = with_now(events)
    n = [F.count_if(F.col("ts") > F.col("as_of") - F.expr(f"interval {w} days")).alias(f"n{w}") for w in windows]
    out = e.groupBy(*keys).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("as_of").alias("as_of"), *n, F.sum(F.coalesce("lines_added", F.lit(0))).alias("added"), F.sum(F.coalesce("lines_removed", F.lit(0))).alias("removed"))
    return out.withColumn("age_days", whole_days(F.col("first_ts"), F.col("as_of"))).withColumn("dormant_days", whole_days(F.col("last_ts"), F.col("as_of"))).drop("as_of")


def top_observers(events: DataFrame, limit: int = 10) -> DataFrame:
    named = events.withColumn("email", observer(F.col("observer_email"))).where("email is not null")
    out = named.groupBy("email").agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.orderBy(F.desc("changes"), "email").limit(limit)


def top_per_key(events: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    named = events.withColumn("email", observer(F.col("observer_email"))).where("email is not null")
    counts = named.groupBy(*keys, "email").agg(F.count("*").alias("changes"))
    w = Window.partitionBy(*keys).orderBy(F.desc("changes"), "email")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tectonic_mean(n90: Column, debt: Column, churn_limit: int = 10, debt_limit: float = 0.2) -> Column:
    """Risk of a hot and indebted file: mean of both, each capped at 1; null below a limit."""
    risk = (F.least(n90 / (churn_limit * 3.0), F.lit(1.0)) + F.least(debt / (debt_limit * 2), F.lit(1.0))) / 2
    return F.when((n90 >= churn_limit) & (debt >= debt_limit), risk)


def tectonic_product(n90: Column, debt: Column) -> Column:
    """The engine's form: product, for more than 10 changes and debt above .2."""
    return F.when((n90 > 10) & (debt > 0.2), F.least(n90 / 30.0, F.lit(1.0)) * F.least(debt * 2, F.lit(1.0)))


def drift(files: DataFrame, window_days: int = 180) -> DataFrame:
    """Share of callables in files changed inside the window, annualised, with the groups by age.

    ``files``: ``callables, age_days, dormant_days, n90``.
    """
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("callables"))), F.lit(0))
    agg = files.agg(F.coalesce(F.sum("callables"), F.lit(0)).alias("total"), s(F.col("age_days") <= 90).alias("new"), s(F.col("dormant_days") >= 730).alias("ancient"), s((F.col("dormant_days") < 730) & (F.col("n90") > 0)).alias("active"), s((F.col("dormant_days") < 730) & (F.col("n90") == 0)).alias("dormant"), s(F.col("dormant_days") < window_days).alias("moved"))
    percent = F.coalesce(F.try_divide(F.col("moved") * 100.0, F.col("total")), F.lit(0.0))
    return agg.select("*", F.round(percent, 6).alias("drift_percent"), F.round(percent * 365.0 / window_days, 6).alias("drift_per_year"))


def dir_churn(files: DataFrame, directory: str) -> DataFrame:
    out = files.groupBy(directory).agg(F.count("*").alias("files"), F.sum("n90").alias("n90"), F.max("n30").alias("hottest"), F.floor(F.avg("age_days")).cast("bigint").alias("mean_age"))
    return out.withColumn("churn_class", classify.churn_class(F.col("hottest"), F.floor(F.col("n90") / F.col("files"))))


def geology(files: DataFrame) -> DataFrame:
    """One row of counts and an activity: files under stress, ancient and core files, and bursts of change.

    ``files``: ``n30, n90, dormant_days, callables, debt``. Stress: 10 changes in 90 days and
    a debt of 0.2; ancient: nothing for 730 days, core from 5 callables on; a burst: 30
    changes in 30 days. Activity: any burst, more than five under stress, any, none.
    """
    stress, ancient = (F.col("n90") >= 10) & (F.col("debt") >= 0.2), F.col("dormant_days") >= 730
    counts = files.agg(F.count_if(stress).alias("stressed"), F.count_if(ancient).alias("ancient"), F.count_if(ancient & (F.col("callables") >= 5)).alias("ancient_core"), F.count_if(F.col("n30") >= 30).alias("bursts"))
    return counts.withColumn("activity", F.when(F.col("bursts") > 0, "high_volcanic").when(F.col("stressed") > 5, "tectonic_stress").when(F.col("stressed") > 0, "minor_shifts").otherwise("stable"))


def ancient_files(files: DataFrame, days: int = 730, core: int = 5) -> DataFrame:
    """Files without a change for ``days``, those of many callables first."""
    old = files.where(F.col("dormant_days") >= days).withColumn("is_core", F.col("callables") >= core)
    return old.orderBy(F.desc("is_core"), F.desc("callables"), "repo_id", "path")


def dir_drift(files: DataFrame, directory: str) -> DataFrame:
    """Callables of every directory by age of their files, drift a year, and its stage of life.

    ``files``: ``callables, age_days, dormant_days, n90`` of files with callables.
    """
    new = (F.col("age_days") > 0) & (F.col("age_days") <= 90)
    ancient = ~new & (F.col("dormant_days") >= 730)
    active = ~new & ~ancient & (F.col("n90") > 0)
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("callables"))), F.lit(0)).cast("bigint")
    known = F.when(F.col("age_days") > 0, F.col("age_days"))
    out = files.groupBy(directory).agg(s(new).alias("new"), s(ancient).alias("ancient"), s(active).alias("active"), s(~new & ~ancient & ~active).alias("dormant"), F.floor(F.avg(known)).cast("bigint").alias("mean_age"), F.min(known).alias("youngest"), F.max(known).alias("oldest"))
    total = F.col("new") + F.col("ancient") + F.col("active") + F.col("dormant")
    out = out.withColumn("drift_per_year", F.round(F.coalesce(F.try_divide((F.col("new") + F.col("active")) * 200.0, total), F.lit(0.0)), 6))
    is_new = F.coalesce(F.col("youngest") <= 90, F.lit(False))
    is_old = F.coalesce(F.col("oldest") >= 730, F.lit(False)) & (F.col("new") == 0) & (F.col("active") == 0)
    return out.withColumn("stage", classify.life_cycle(is_new, is_old, F.col("new"), F.col("ancient"), F.col("active"))).drop("youngest", "oldest")
