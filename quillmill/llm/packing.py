"""Filling fixed-capacity containers with items of varying length.

Method: bounded-space online best fit. A fixed number of bins is open at a time, kept in
a bitset keyed by free space, so the tightest open bin that takes an item is found by a
shift and a lowest-bit search. When no bin fits and all are open, the fullest closes
first. An item larger than the capacity is split over containers of its own.

Items come in the order of their hashes, at any size of a group; a buffer as long as the
number of open bins is filled and emptied longest first. Groups (one capacity each) are
independent. A group is split by hash into chunks of about ``chunk`` items, which are
packed apart; each leaves at most ``bins`` containers partly filled. Rows reach the packer
sorted by chunk and are streamed: a task holds one buffer and the open bins.

Defined results: a null or negative size counts as 0; an item of size 0 still takes a
place; a null or non-positive capacity gives every item a container of its own (and every
item above a non-positive one exceeds it); a group whose rows name several capacities is
packed apart for each; ties go to the hash order; repeated rows are items each; an empty
table packs nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def token_cost(path: Column, content: Column) -> Column:
    """Tokens of a rendered file: bytes of content div 4, and the frame of its path."""
    return F.floor(F.octet_length(content) / 4).cast("bigint") + F.floor((F.lit(70) + 2 * F.octet_length(path)) / 4).cast("bigint")


class FreeSpace:
    """A bitset of numbers in words of 1,024 bits, with a summary level for every 1,024 words.

    The least member at or above a number is found by a shift and a lowest-bit search on
    each level, exactly, whatever the capacity.
    """

    def __init__(self, most: int):
        self.levels: list[dict[int, int]] = [{} for _ in range(max(1, -(-most.bit_length() // 10)))]

    def add(self, x: int) -> None:
        for level in self.levels:
            word = level.get(x >> 10, 0)
            level[x >> 10] = word | 1 << (x & 1023)
            if word:
                return
            x >>= 10

    def remove(self, x: int) -> None:
        for level in self.levels:
            word = level[x >> 10] & ~(1 << (x & 1023))
            if word:
                level[x >> 10] = word
                return
            del level[x >> 10]
            x >>= 10

    def at_least(self, x: int) -> int:
        """The least member that is not below ``x``, or -1."""
        for depth, level in enumerate(self.levels):
            word = level.get(x >> 10, 0) >> (x & 1023)
            if word:
                x += (word & -word).bit_length() - 1
                for lower in reversed(self.levels[:depth]):
                    word = lower[x]
                    x = x << 10 | (word & -word).bit_length() - 1
                return x
            x = (x >> 10) + 1
        return -1


class BestFit:
    """Open bins in a bitset keyed by free space; ``place`` returns the container of an item."""

    def __init__(self, capacity: int, bins: int = BINS):
        self.capacity, self.limit = capacity, bins
        self.free = FreeSpace(capacity)  # holds f while a bin with f free units is open
        self.at: dict[int, list[int]] = {}
        self.open, self.next = 0, 0

    def _put(self, container: int, free: int) -> None:
        same = self.at.setdefault(free, [])
        if not same:
            self.free.add(free)
        same.append(container)
        self.open += 1

    def _take(self, free: int) -> int:
        same = self.at[free]
        container = same.pop()
        if not same:
            del self.at[free]
            self.free.remove(free)
        self.open -= 1
        return container

    def place(self, size: int) -> int:
        free = self.free.at_least(size)
        if free >= 0:
            container = self._take(free)
        else:
            if self.open >= self.limit:  # the fullest closes first
                self._take(self.free.at_least(0))
            container, free = self.next, self.capacity
            self.next += 1
        if free > size:
            self._put(container, free - size)
        return container

    def alone(self) -> int:
        """A container that takes nothing else."""
        self.next += 1
        return self.next - 1


class Packer:
    """Items in the order they come, looked at ``bins`` at a time: of those the longest go first.

    A group of at most ``bins`` items is so packed longest first, a larger one by the same
    rule in steps, with the open bins kept between them.
    """

    def __init__(self, capacity: int | None, bins: int = BINS):
        self.capacity, self.bins = capacity, bins
        self.fit = BestFit(max(capacity or 0, 0), bins)
        self.waiting: list[tuple[object, int]] = []

    def add(self, item: object, size: int) -> list[tuple[object, int, int, int, bool]]:
        self.waiting.append((item, size))
        return self.drain() if len(self.waiting) >= self.bins else []

    def drain(self) -> list[tuple[object, int, int, int, bool]]:
        """(item, part, container, size, over) of the items that wait."""
        out, capacity = [], self.capacity
        self.waiting.sort(key=lambda x: -x[1])
        for item, size in self.waiting:
            if capacity is None or capacity <= 0:
                out.append((item, 0, self.fit.alone(), size, capacity is not None and size > capacity))
                continue
            over, part = size > capacity, 0
            while size > capacity:
                out.append((item, part, self.fit.alone(), capacity, over))
                part, size = part + 1, size - capacity
            if size or not part:
                out.append((item, part, self.fit.place(size), size, over))
        self.waiting = []
        return out


def pack(items: Iterable[tuple[object, int]], capacity: int | None, bins: int = BINS) -> Iterator[tuple[object, int, int, int, bool]]:
    """(item, part, container, size, over) of every item; an item that exceeds the capacity comes in parts."""
    packer = Packer(capacity, bins)
    for item, size in items:
        yield from packer.add(item, size)
    yield from packer.drain()


def _pack_sorted(bins: int, names: list[str]):
    """Packs a partition whose rows come group by group; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, kinds = None, None, None

        def rows(key: tuple, found: list) -> list[tuple]:
            return [(key[0], key[1], key[2], *x) for x in found]

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for b in batches:
            kinds = [b.schema.field("grp").type, pa.int64(), pa.int64(), b.schema.field("item").type, pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            out = []
            for *now, item, size in zip(*(b.column(n).to_pylist() for n in ("grp", "capacity", "chunk", "item", "size"))):
                if packer is None or now != key:
                    if packer is not None:
                        out += rows(key, packer.drain())
                    key, packer = now, Packer(now[1], bins)
                out += rows(key, packer.add(item, size))
            yield batch(out)
        if packer is not None:
            yield batch(rows(key, packer.drain()))

    return run


def pack_items(items: DataFrame, group: str, item: str, size: str, capacity: str, bins: int = BINS, chunk: int = 100_000) -> DataFrame:
    """``grp, item, part, container, size, over``: a container is named ``capacity-chunk-number`` within its group."""
    spark = items.sparkSession
    base = items.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), F.col(capacity).cast("bigint").alias("capacity"))
    # equal rows are counted before they are told apart by a number, so that they may part, too
    same = base.groupBy("grp", "capacity", "item", "size").agg(F.count("*").alias("copies"))
    counts = same.groupBy(F.struct("grp", "capacity").alias("of")).agg(F.sum("copies").alias("n"))
    one = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    one = one.join(counts, F.struct("grp", "capacity").eqNullSafe(F.col("of")))
    order = F.xxhash64("size", "item", "copy")
    keyed = one.select("grp", "capacity", F.pmod(F.xxhash64("item", "size", "copy", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))).cast("bigint").alias("chunk"), "item", "size", order.alias("mixed"))
    # a fixed number of partitions: the packing costs far more than its bytes tell
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = keyed.repartition(tasks, "grp", "capacity", "chunk").sortWithinPartitions("grp", "capacity", "chunk", "mixed", "item", "size").drop("mixed")
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    names = ["grp", "capacity", "chunk", "item", "part", "container", "size", "over"]
    packed = ordered.mapInArrow(_pack_sorted(bins, names), f"grp {kinds['grp']}, capacity bigint, chunk bigint, item {kinds['item']}, part int, container bigint, size bigint, over boolean")
    return packed.select("grp", "item", "part", F.concat_ws("-", F.coalesce(F.col("capacity").cast("string"), F.lit("")), "chunk", "container").alias("container"), "size", "over")


def vector_items(vectors: DataFrame) -> DataFrame:
    """``vector_id, path, cost, capacity``: one row for each input file of a budget vector."""
    files = vectors.select("vector_id", F.col("input_budget").alias("capacity"), F.explode("input_files").alias("path", "content"))
    return files.select("vector_id", "path", token_cost(F.col("path"), F.coalesce("content", F.lit(""))).alias("cost"), "capacity")


def container_report(packed: DataFrame, items: DataFrame) -> DataFrame:
    """``vector_id, containers, used, capacity, fill``: how full the containers of each group are."""
    caps = items.groupBy("vector_id").agg(F.max("capacity").alias("capacity"))
    per = packed.groupBy(F.col("grp").alias("vector_id")).agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("used"))
    return per.join(caps, "vector_id").select("vector_id", "containers", "used", "capacity", F.round(F.try_divide(F.col("used"), F.col("containers") * F.col("capacity")), 6).alias("fill"))


def oversize(packed: DataFrame) -> DataFrame:
    """``vector_id, path`` of items that exceed the capacity by themselves."""
    return packed.where("over").select(F.col("grp").alias("vector_id"), F.col("item").alias("path")).distinct()


def numbered(packed: DataFrame) -> DataFrame:
    """Containers numbered from 1 within each group, in the order of their text."""
    w = Window.partitionBy("grp").orderBy("container")
    return packed.withColumn("container", F.dense_rank().over(w))
