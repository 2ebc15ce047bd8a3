"""Learned utility, windows and history as streams, with batch folds of the same results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA, START = 0.3, 0.5


def step(score: float, utility: float, alpha: float = ALPHA) -> float:
    """Exponential moving average; both sides are kept inside 0..1."""
    u = min(max(utility, 0.0), 1.0)
    return min(max(alpha * u + (1 - alpha) * score, 0.0), 1.0)


def ema_batch(reports: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``path, score, reports`` of ``path, utility, seq``: the moving average in order of ``seq``.

    The fold has a closed form, so no key's reports meet in one array: the n-th of N
    reports weighs ``alpha * (1 - alpha) ** (N - n)`` and the start ``(1 - alpha) ** N``.
    """
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    late = reports.withColumn("k", F.row_number().over(w) - 1)
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("k"))
    return late.groupBy("path").agg((F.sum(F.col("utility") * weight) + START * F.pow(F.lit(1 - alpha), F.count("*"))).alias("score"), F.count("*").alias("reports"))


def ema_stream(reports: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same as a stateful stream over ``path, utility, seq``: one value a path, updated a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score, n = state.get if state.exists else (START, 0)
        for pdf in batches:
            for u in pdf.sort_values("seq")["utility"]:
                score, n = step(score, float(u), alpha), n + 1
        state.update((score, n))
        yield pd.DataFrame({"path": [key[0]], "score": [score], "reports": [n]})

    return reports.groupBy("path").applyInPandasWithState(update, "path string, score double, reports long", "score double, reports long", "update", "NoTimeout")


def windows_stream(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ignored_stream(events: DataFrame) -> DataFrame:
    """Running counts by pattern; a pattern ignored five times is faded."""
    return events.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("faded", F.col("n") >= 5)


def to_end(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and gives its last result, written below ``folder``."""
    spark, name = stream.sparkSession, uuid.uuid4().hex
    target = f"{folder.rstrip('/')}/stream-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/{number:06d}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = max((p["batchId"] for p in run.recentProgress if p["numInputRows"] > 0), default=None)
    return spark.read.parquet(f"{target}/{last:06d}") if last is not None else spark.createDataFrame([], stream.schema)


def undo_redo(actions: DataFrame, key: str, cap: int = 50) -> DataFrame:
    """``key, items, at``: a history per key after its actions in order of ``seq``: ``record``, ``undo`` or ``redo``.

    The fold needs a key's actions in order, so they meet in one task in batches; what is
    kept between batches is one history of at most ``cap`` items.
    """
    kind = actions.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, history = None, None
        for pdf in batches:
            for k, action, item in zip(pdf["k"], pdf["action"], pdf["item"]):
                if history is None or k != now:
                    if history is not None:
                        yield pd.DataFrame({"k": [now], "items": [history.items], "at": [history.at]})
                    now, history = k, History(cap)
                if action == "record":
                    history.record(item)
                elif action == "undo":
                    history.undo()
                elif action == "redo":
                    history.redo()
        if history is not None:
            yield pd.DataFrame({"k": [now], "items": [history.items], "at": [history.at]})

    ordered = actions.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "seq", "action", F.col("item").cast("string").alias("item")).repartition("k").sortWithinPartitions("k", "seq").select("k", "action", "item")
    return ordered.mapInPandas(fold, f"k {kind}, items array<string>, at int").withColumnRenamed("k", key)


def marks(events: DataFrame) -> DataFrame:
    """``path, utility, views``: the last utility a path was marked with, and how often it was seen.

    ``events``: ``path, kind`` (mark or view), ``utility, seq``.
    """
    return events.groupBy("path").agg(F.max_by("utility", F.when(F.col("kind") == "mark", F.col("seq"))).alias("utility"), F.count_if(F.col("kind") == "view").alias("views"))


def sessions(events: DataFrame) -> DataFrame:
    """``session, active, zooms``: sessions that were not deleted, the one activated last, and their zooms in order.

    ``events``: ``session, action`` (create, activate, delete, add_zoom, remove_zoom), ``zoom, seq``. What
    happened before a session's last deletion is forgotten; a zoom removed last is gone.
    """
    w = Window.partitionBy("session")
    alive = events.withColumn("_gone", F.max(F.when(F.col("action") == "delete", F.col("seq"))).over(w)).where("_gone is null or seq > _gone")
    last = alive.where("action in ('add_zoom', 'remove_zoom')").groupBy("session", "zoom").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("at")).where("action = 'add_zoom'")
    zooms = last.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "zoom"))), lambda x: x["zoom"]).alias("zooms"))
    own = alive.groupBy("session").agg(F.max(F.when(F.col("action").isin("create", "activate"), F.col("seq"))).alias("_on")).where("_on is not null")
    top = own.agg(F.max("_on").alias("_top"))
    return own.join(zooms, "session", "left").join(F.broadcast(top)).select("session", (F.col("_on") == F.col("_top")).alias("active"), F.coalesce("zooms", F.array().cast("array<string>")).alias("zooms"))


class History:
    """Undo and redo of positions: recording drops the redo tail and the oldest beyond the cap."""

    def __init__(self, cap: int = 50):
        self.cap, self.items, self.at = cap, [], -1

    def record(self, item) -> None:
        self.items = [*self.items[: self.at + 1], item][-self.cap :]
        self.at = len(self.items) - 1

    def undo(self):
        self.at = max(self.at - 1, -1)
        return self.current()

    def redo(self):
        self.at = min(self.at + 1, len(self.items) - 1)
        return self.current()

    def current(self):
        return self.items[self.at] if self.at >= 0 else None
