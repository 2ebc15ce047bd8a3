"""Graphs as ``edges(src, dst)``: roots, reach, depth, components, cycles, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored as cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))


def levels(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """``id, level``: breadth-first distance from the start nodes (which are level 0).

    Goes on until nothing new is reached, or to level ``most``. Every round joins only the
    new frontier and writes only that, so a lost executor costs one round; what was seen is
    the union of the frontiers, written anew every 16 rounds to keep plans short.
    """
    links = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(start.select("id").distinct().withColumn("level", F.lit(0)))
    level = 0
    while most is None or level < most:
        level += 1
        step = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 16 == 0:
            seen = cut(seen)
    return seen


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached, the start included."""
    return levels(edges, start).select("id")


def neighbors(edges: DataFrame) -> DataFrame:
    """``id, callers, callees``: sorted neighbours of every node on both sides."""
    pairs = edges.select("src", "dst").distinct()
    sides = pairs.select(F.col("src").alias("id"), F.lit(None).cast(pairs.schema["src"].dataType).alias("caller"), F.col("dst").alias("callee")).unionByName(pairs.select(F.col("dst").alias("id"), F.col("src").alias("caller"), F.lit(None).cast(pairs.schema["dst"].dataType).alias("callee")))
    return sides.groupBy("id").agg(F.array_sort(F.collect_list("caller")).alias("callers"), F.array_sort(F.collect_list("callee")).alias("callees"))


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """``step, id`` along a shortest path, of equal ones that whose nodes are least from the end on; empty where there is none."""
    start_ = edges.sparkSession.createDataFrame([(start,)], edges.select(F.col("src").alias("id")).schema)
    seen = cut(levels(edges, start_))
    last = seen.where(F.col("id") == end).select("level").first()
    rows = [] if last is None else [(last["level"], end)]
    if last is not None:
        # one node a round comes to the driver, as many as the path is long
        for level in range(last["level"] - 1, -1, -1):
            back = edges.where(F.col("dst") == rows[-1][1]).select(F.col("src").alias("id")).join(seen.where(F.col("level") == level), "id").agg(F.min("id")).first()[0]
            rows.append((level, back))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(sorted(rows), f"step int, id {kind}")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the removed nodes."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def call_edges(calls: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a call graph: a callee that nobody defines becomes an external node.

    ``calls``: ``src, callee``; ``definitions``: ``id, name``. A name that several define is
    resolved to the least id. Nodes: ``id, kind``; edges: ``src, dst``, each once.
    """
    first = definitions.groupBy("name").agg(F.min("id").alias("dst"))
    found = calls.join(first, F.col("callee") == F.col("name"), "left")
    edges = found.select("src", F.coalesce("dst", F.concat(F.lit("external:"), "callee")).alias("dst")).distinct()
    ids = definitions.select("id", F.lit("defined").alias("kind")).unionByName(edges.where(F.startswith("dst", F.lit("external:"))).select(F.col("dst").alias("id"), F.lit("external").alias("kind")))
    return ids.distinct(), edges


def metadata(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, depth from the roots, and whether there is a cycle."""
    depth = levels(edges, roots(edges)).agg(F.coalesce(F.max("level"), F.lit(0)).alias("depth"))
    _, rest = peel(edges)
    size = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    return nodes(edges).agg(F.count("*").alias("nodes")).join(size).join(depth).join(rest.agg((F.count("*") > 0).alias("cyclic")))


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: least id of the connected component (min-label propagation with shortcuts)."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes(edges).withColumn("component", F.col("id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("best"))
        moved = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("best", "component")).alias("component"))
        # shortcut: the label of the label halves long chains
        top = moved.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = cut(moved.join(top, "component", "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component")))
        if new.join(label.withColumnRenamed("component", "before"), "id").where("component <> before").isEmpty():
            return new
        label = new


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(order, rest)``: topological level of every node outside cycles, and the edges inside or behind them (Kahn)."""
    left = cut(edges.select("src", "dst").distinct())
    open_ = cut(nodes(edges))
    order, level = None, 0
    while True:
        free = cut(open_.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        order = free if order is None else order.unionByName(free)
        if level % 16 == 15:  # short plans, however long the chain
            order = cut(order)
        open_ = cut(open_.join(free, "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    if order is None:
        order = open_.limit(0).withColumn("level", F.lit(0))
    return order, left


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``id, component``: strongly connected components; nodes outside cycles are their own.

    Colouring: what cannot lie on a cycle is peeled, then every node takes the least id
    that reaches it. A node that keeps its own id is the root of a component, which is all
    that reaches the root backwards within its colour. All components of a round are found
    at once and removed.
    """
    all_nodes = cut(nodes(edges))
    found, core = None, edges.select("src", "dst")
    while True:
        _, rest = peel(core)
        _, back = peel(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        core = cut(back.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if core.isEmpty():
            break
        colour = cut(nodes(core).withColumn("colour", F.col("id")))
        while True:
            near = core.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("best"))
            new = cut(colour.join(near, "id", "left").select("id", F.least("colour", F.coalesce("best", "colour")).alias("colour"), (F.col("best") < F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        # edges inside one colour, walked backwards from the roots
        inside = cut(core.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        own = cut(levels(inside, colour.where("id = colour").select("id")).select("id").join(colour, "id").select("id", F.col("colour").alias("component")))
        found = own if found is None else found.unionByName(own)
        gone = own.select("id")
        core = cut(core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    if found is None:
        return all_nodes.withColumn("component", F.col("id"))
    return all_nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def ancestors(nodes_: DataFrame) -> DataFrame:
    """``id, depth, path`` of a hierarchy ``id, parent_id, name``: names from the root, joined by ``/``.

    What hangs below no root (a cycle of parents) has no path and no row.
    """
    level = nodes_.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out, depth = level, 0
    while True:
        depth += 1
        level = cut(nodes_.join(level.select(F.col("id").alias("parent_id"), F.col("path").alias("up")), "parent_id").select("id", F.lit(depth).alias("depth"), F.concat_ws("/", "up", "name").alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        if depth % 16 == 0:
            out = cut(out)
    return out
