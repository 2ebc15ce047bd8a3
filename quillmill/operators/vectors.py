"""Feature vectors: distances, normalisation, top-k, clusters, silhouettes, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def blocks(queries: DataFrame, key: str, block: int) -> list[DataFrame]:
    """A stated set of queries in blocks of about ``block`` rows, told by their keys' hashes; only their number is counted."""
    n = max(1, -(-queries.count() // block))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def nearest(queries: DataFrame, vectors: DataFrame, measure, k: int, largest: bool, block: int = 500) -> DataFrame:
    """``query, vec_id, score, rank``: exact ``k`` best of all vectors for every query.

    Queries are a stated set; they go in blocks of ``block`` rows (a bound on what a block
    broadcasts), each against all vectors. Every task keeps only its own ``k`` best before
    anything is shuffled.
    """
    order = F.desc("score") if largest else F.asc("score")
    out = None
    for own in blocks(queries, "vec_id", block):
        own = own.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
        pairs = vectors.join(F.broadcast(own), F.col("vec_id") != F.col("query")).select("query", "vec_id", measure(F.col("q"), F.col("embedding")).alias("score"))
        part = pairs.withColumn("part", F.spark_partition_id())
        local = Window.partitionBy("query", "part").orderBy(order, "vec_id")
        best = part.withColumn("r", F.row_number().over(local)).where(F.col("r") <= k).drop("r", "part")
        top = Window.partitionBy("query").orderBy(order, "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def standardized(df: DataFrame, floor: float = 0.001) -> DataFrame:
    """``vec_id, dim, z``: population z-score per dimension, deviation at least ``floor``."""
    long = df.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("dev"))
    return long.join(stats, "dim").select("vec_id", "dim", ((F.col("x") - F.col("mean")) / F.col("dev")).alias("z"))


def min_max(df: DataFrame, least: float = 0.001) -> DataFrame:
    """``vec_id, dim, x``: scaled to 0..1; a range below ``least`` counts as 1."""
    long = df.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.when(F.col("hi") - F.col("lo") < least, 1.0).otherwise(F.col("hi") - F.col("lo"))
    return long.join(stats, "dim").select("vec_id", "dim", ((F.col("x") - F.col("lo")) / span).alias("x"))


def centroids(df: DataFrame, label: str) -> DataFrame:
    """``label, centroid``: mean vector of every label."""
    long = df.select(label, F.posexplode("embedding").alias("dim", "x"))
    means = long.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def cluster_metrics(df: DataFrame, label: str) -> DataFrame:
    """Size, mean and greatest distance to the centroid, cohesion ``1 / (1 + mean)``."""
    d = df.join(centroids(df, label), label).withColumn("d", euclid(F.col("embedding"), F.col("centroid")))
    return d.groupBy(label).agg(F.count("*").alias("size"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance")).withColumn("cohesion", 1 / (1 + F.col("mean_distance")))


def representatives(df: DataFrame, label: str) -> DataFrame:
    """The member nearest to each centroid; the least id on ties."""
    d = df.join(centroids(df, label), label).withColumn("d", F.round(euclid(F.col("embedding"), F.col("centroid")), 9))
    return d.groupBy(label).agg(F.min_by("vec_id", F.struct("d", "vec_id")).alias("vec_id"), F.min("d").alias("distance"))


def estimate_k(n: int) -> int:
    return max(1, min(max(-(-int((n / 2) ** 0.5 * 1e9) // 10**9), 2), 20, n // 2))


def _weight(x: list[float]) -> str:
    return f"array({','.join(f'{float(v)!r}D' for v in x)})"


def _nearest_center(centers: list[list[float]]) -> Column:
    """``d, cluster``: distance and number of the nearest center, the first of equals."""
    ranked = [F.struct(euclid(F.col("embedding"), F.expr(_weight(c))).alias("d"), F.lit(j).alias("cluster")) for j, c in enumerate(centers)]
    return F.least(*ranked) if len(ranked) > 1 else ranked[0]


def kmeans(df: DataFrame, k: int, seed: int = 42, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """``vec_id, cluster``: Lloyd's rounds from k-means++ starts.

    A further start is drawn with a chance in proportion to its squared distance from the
    nearest one: the row of least ``-log(u) / d^2``, with ``u`` from a hash of its id and the
    seed, so nothing is collected but the ``k`` centers. A cluster without members takes the
    point that lies farthest from its center. Points are assigned by built-in expressions and
    averaged with map-side combine; ``k`` is at most the number of rows.
    """
    k = min(k, df.count())
    if k == 0:
        return df.select("vec_id", F.lit(0).alias("cluster"))
    u = lambda i: (F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    pick = lambda rows: [float(x) for x in rows.first()["embedding"]]
    centers = [pick(df.orderBy(u(0), "vec_id").limit(1))]
    while len(centers) < k:
        drawn = df.withColumn("d", _nearest_center(centers)["d"])
        far = drawn.where("d > 0").orderBy(-F.log(u(len(centers))) / (F.col("d") * F.col("d")), "vec_id").limit(1)
        centers.append(pick(far if not far.isEmpty() else df.orderBy(u(len(centers)), "vec_id").limit(1)))
    before = None
    for _ in range(rounds):
        assigned = df.withColumn("best", _nearest_center(centers))
        long = assigned.select(F.col("best.cluster").alias("cluster"), F.col("best.d").alias("d"), F.posexplode("embedding").alias("dim", "x"))
        stats = long.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.sum(F.col("d") * F.col("d")).alias("d2")).collect()
        inertia = sum(r["d2"] for r in stats if r["dim"] == 0)
        for r in stats:
            centers[r["cluster"]][r["dim"]] = r["m"]
        empty = sorted(set(range(k)) - {r["cluster"] for r in stats})
        for j, row in zip(empty, assigned.orderBy(F.desc("best.d"), "vec_id").limit(len(empty)).collect() if empty else []):
            centers[j] = [float(x) for x in row["embedding"]]
        if not empty and before is not None and abs(before - inertia) <= tolerance * max(before, 1e-12):
            break
        before = inertia
    return df.select("vec_id", _nearest_center(centers)["cluster"].alias("cluster"))


def silhouettes(df: DataFrame, label: str, block: int = 500) -> DataFrame:
    """``vec_id, label, a, b, silhouette`` of the vectors whose id is divisible by 50, against all others.

    ``a``: mean distance to the own label's other members (0 where there is none); ``b``: the
    least mean distance to another label; a point without other labels has no silhouette.
    """
    queries, out = df.where(f"vec_id % 50 = 0 and {label} is not null"), None
    for own in blocks(queries, "vec_id", block):
        own = own.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col(label).alias("own"))
        pairs = df.where(f"{label} is not null").join(F.broadcast(own), F.col("vec_id") != F.col("query"))
        part = pairs.groupBy("query", "own", label).agg(F.avg(euclid(F.col("q"), F.col("embedding"))).alias("mean"))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy(F.col("query").alias("vec_id"), F.col("own").alias("label")).agg(F.coalesce(F.max(F.when(F.col(label) == F.col("own"), F.col("mean"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col(label) != F.col("own"), F.col("mean"))).alias("b"))
    return per.withColumn("silhouette", F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite where the sizes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(euclid(a, b))


def vector_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 where the sizes differ."""
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(cosine(a, b))


def fitted(v: Column, dims: int) -> Column:
    """Values inside 0..1, cut or filled with zeros to ``dims`` positions."""
    inside = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))))
    return F.slice(F.concat(inside, F.array_repeat(F.lit(0.0), dims)), 1, dims)


def weighted(df: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Vectors with every position scaled by its key's weight (``key, dim, weight``), 1 where none is given."""
    long = df.select("vec_id", key, F.posexplode("embedding").alias("dim", "x")).join(weights, [key, "dim"], "left")
    return long.select("vec_id", "dim", (F.col("x").cast("double") * F.coalesce("weight", F.lit(1.0))).alias("x"))


def similar_components(df: DataFrame, least: float, cells: int = 6) -> DataFrame:
    """``id, component``: connected components of vectors whose cosine is at least ``least``.

    Unit vectors of that cosine lie within ``sqrt(2 - 2 least)`` of each other, which
    ``neighbours`` finds exactly; every vector is in a component, alone if need be.
    """
    from .graph import components

    unit = df.select("vec_id", F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(F.col("embedding"))), F.lit(0.0))).alias("embedding"))
    near = cut(neighbours(unit, (2 - 2 * least) ** 0.5 + 1e-9, cells))
    pairs = near.toDF("src", "dst").unionByName(df.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst")))
    return components(pairs)


def neighbours(df: DataFrame, eps: float, cells: int = 4) -> DataFrame:
    """``a, b`` of different vectors within ``eps``: candidates share neighbouring cells of a few dimensions.

    A cell is ``eps`` wide, so two vectors within ``eps`` differ by at most one cell in
    each of the first ``cells`` dimensions; nothing is lost and no cross join is needed.
    """
    grid = lambda i: F.floor(F.get("embedding", F.lit(i)) / eps).cast("int")
    base = df.select("vec_id", "embedding", *[grid(i).alias(f"g{i}") for i in range(cells)])
    probe = base
    for i in range(cells):
        probe = probe.withColumn(f"g{i}", F.explode(F.array(F.col(f"g{i}") - 1, F.col(f"g{i}"), F.col(f"g{i}") + 1)))
    other = base.select(F.col("vec_id").alias("b"), F.col("embedding").alias("other"), *[f"g{i}" for i in range(cells)])
    pairs = probe.withColumnRenamed("vec_id", "a").join(other, [f"g{i}" for i in range(cells)]).where("a < b")
    near = pairs.where(euclid(F.col("embedding"), F.col("other")) <= eps).select("a", "b")
    return near.union(near.select("b", "a"))


def _around(df: DataFrame, at: str, width: float, cells: int, probe: bool) -> DataFrame:
    """Adds ``g0..``: the grid cell of vector ``at`` in its first dimensions; a probe goes to the cells beside it too."""
    for i in range(cells):
        g = F.floor(F.coalesce(F.get(at, F.lit(i)), F.lit(0.0)) / width).cast("double")
        df = df.withColumn(f"g{i}", F.explode(F.array_distinct(F.array(g - 1, g, g + 1))) if probe else g)
    return df


def _close(places: DataFrame, others: DataFrame, eps: float, cells: int) -> DataFrame:
    """The columns of ``others`` for every ``place`` (as ``a``) that they lie within ``eps`` of, its own included."""
    own = _around(places.select(F.col("place").alias("a"), F.col("x").alias("p")), "p", eps * 1.001, cells, True)
    return own.join(_around(others, "x", eps * 1.001, cells, False), [f"g{i}" for i in range(cells)]).where(euclid(F.col("p"), F.col("x")) <= eps)


def _boxes(members: DataFrame) -> DataFrame:
    """``grp, lo, hi, places, seed``: what a group's places span, their number and one of them."""
    long = members.select("grp", F.posexplode_outer("x").alias("dim", "v")).groupBy("grp", "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spans = long.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("s")).select("grp", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    return spans.join(members.groupBy("grp").agg(F.count("*").alias("places"), F.min_by("x", "place").alias("seed")), "grp")


def _touching(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of boxes that are not too far apart, and ``touch``: surely within ``eps``, by their spans or by their seeds."""
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    gap = F.zip_with(less("lo_b", "hi_a"), less("lo_a", "hi_b"), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    span = F.zip_with(less("hi_b", "lo_a"), less("hi_a", "lo_b"), lambda x, y: F.greatest(x, y))
    near = pairs.where((F.size("lo_a") == F.size("lo_b")) & (norm(gap) <= eps * (1 + 1e-9)))
    return near.withColumn("touch", (norm(span) <= eps * (1 - 1e-9)) | (euclid(F.col("seed_a"), F.col("seed_b")) <= eps))


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """``grp, component`` after components are connected by edges ``a, b`` of groups; the least name stays.

    Every component takes the least one beside it; what that makes equal is contracted, so
    long chains take few rounds.
    """
    to = lambda c: label.select(F.col("grp").alias(c), F.col("component").alias(f"of_{c}"))
    left = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    while True:
        left = stored(left.where("a <> b").distinct())
        if left.isEmpty():
            return label
        up = left.union(left.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("up"))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        up = stored(up)
        at = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"of_{c}"))
        label = stored(label.join(up, label["component"] == up["id"], "left").select("grp", F.coalesce("up", "component").alias("component")))
        # names that have a lesser one above them go on
        rest = up.select(F.col("up").alias("a")).join(at("a"), "a").select("a", F.col("of_a").alias("b"))
        left = left.join(at("a"), "a").join(at("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).union(rest)


def _joined(core: DataFrame, eps: float, cells: int, direct: int) -> DataFrame:
    """``grp, component`` of groups no wider than ``eps``: those with two places within ``eps`` are connected.

    Spans and seeds decide most pairs, and a pair inside one component needs no decision.
    What is left open is compared place by place up to ``direct`` comparisons, else both
    groups are halved.
    """
    side = lambda df, tag: df.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("grp", "lo", "hi", "places", "seed")])
    groups = stored(_boxes(core))
    width = eps * 2.001  # lower corners differ by eps and a group's width at most
    left, right = _around(side(groups, "a"), "lo_a", width, cells, True), _around(side(groups, "b"), "lo_b", width, cells, False)
    pairs = stored(_touching(left.join(right, [f"g{i}" for i in range(cells)]).where("grp_a < grp_b"), eps).select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"), "grp_a", "grp_b", "touch"))
    label, met = groups.select("grp", F.col("grp").alias("component")), None
    members = core
    while True:
        touched = pairs.where("touch").select("a", "b")
        label = _merged(label, touched if met is None else touched.unionByName(met))
        ends = [label.select(F.col("grp").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
        # a pair inside one component is decided
        left_open = pairs.where("not touch").join(ends[0], "a").join(ends[1], "b").where("of_a <> of_b")
        sized = left_open.select("a", "b", "grp_a", "grp_b").join(side(groups, "a"), "grp_a").join(side(groups, "b"), "grp_b")
        sized = stored(sized.select("a", "b", "grp_a", "grp_b", (F.col("places_a") * F.col("places_b") <= direct).alias("small")))
        if sized.isEmpty():
            return label
        own = [members.select(F.col("grp").alias(f"grp_{c}"), F.col("x").alias(f"x_{c}")) for c in ("a", "b")]
        met = stored(sized.where("small").join(own[0], "grp_a").join(own[1], "grp_b").where(euclid(F.col("x_a"), F.col("x_b")) <= eps).select("a", "b").distinct())
        large = sized.where("not small")
        if large.isEmpty():
            return _merged(label, met)
        wanted = large.select(F.col("grp_a").alias("grp")).union(large.select(F.col("grp_b").alias("grp"))).distinct()
        # halves of the widest dimension; each has a place where there are two
        long = F.array_max(F.zip_with("hi", "lo", lambda x, y: x - y))
        at = F.array_position(F.zip_with("hi", "lo", lambda x, y: x - y), long).cast("int") - 1
        here, low = F.get("x", F.col("at")), F.get("lo", F.col("at"))
        halves = members.join(wanted, "grp").join(groups, "grp").withColumn("at", at)
        lower = (here < low + (F.get("hi", F.col("at")) - low) / 2) | (here == low)
        members = stored(halves.select("place", "x", F.col("grp").alias("up"), F.min("place").over(Window.partitionBy("grp", lower)).alias("grp")))
        groups = stored(_boxes(members))
        up = members.select("up", "grp").distinct()
        tops = [up.select(F.col("up").alias(f"grp_{c}"), F.col("grp").alias(f"new_{c}")) for c in ("a", "b")]
        split = large.join(tops[0], "grp_a").join(tops[1], "grp_b").select("a", "b", F.col("new_a").alias("grp_a"), F.col("new_b").alias("grp_b"))
        pairs = stored(_touching(split.join(side(groups, "a"), "grp_a").join(side(groups, "b"), "grp_b"), eps).select("a", "b", "grp_a", "grp_b", "touch"))


def dbscan(df: DataFrame, eps: float, least: int, cells: int = 4, direct: int = 10_000) -> DataFrame:
    """``vec_id, cluster``: core points have ``least`` neighbours; a border point joins its least cluster; noise is -1.

    Exact, and no neighbours are listed. Equal vectors are one place. Places share a group if
    they fall into a cell so small that all in it are within ``eps``: a group of more than
    ``least`` points is core as a whole, and its core places are one cluster. So only places of
    smaller groups count and look up their neighbours, and clusters are made of groups. Ids
    are unique; a vector with a value that is missing or not finite is noise.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    points = df.select("vec_id", F.when(whole, x).alias("x"))
    width = F.lit(eps * 0.999) / F.sqrt(F.greatest(F.size("x"), F.lit(1)))
    # beyond 2^40 cells from zero a quotient is too coarse: a value is its own cell
    cell = F.transform("x", lambda v: F.when(F.abs(v) < width * float(1 << 40), F.rint(v / width) * width).otherwise(v))
    places = stored(points.where("x is not null").groupBy("x").agg(F.count("*").alias("n"), F.min("vec_id").alias("place")).withColumn("cell", cell))
    sizes = places.groupBy("cell").agg(F.sum("n").alias("points"))
    places = stored(places.join(sizes, "cell").withColumn("many", F.col("points") > least))
    few = places.where("not many")
    counted = _close(few, places.select("x", "n"), eps, cells).groupBy("a").agg(F.sum("n").alias("near")).where(F.col("near") > least).select(F.col("a").alias("place"))
    core = places.where("many").select("place", "x", "cell").unionByName(few.join(counted, "place").select("place", "x", "cell"))
    core = stored(core.join(core.groupBy("cell").agg(F.min("place").alias("grp")), "cell").select("place", "x", "grp"))
    core = stored(core.join(_joined(core, eps, cells, direct), "grp").select("place", "x", "component"))
    rest = few.join(core, "place", "left_anti")
    border = _close(rest, core.select("x", "component"), eps, cells).groupBy(F.col("a").alias("place")).agg(F.min("component").alias("component"))
    labels = core.select("x", "component").unionByName(rest.join(border, "place").select("x", "component"))
    return points.join(labels, "x", "left").select("vec_id", F.coalesce("component", F.lit(-1)).alias("cluster"))
