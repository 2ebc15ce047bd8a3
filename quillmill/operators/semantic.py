"""Concepts across languages: universal types, hybrid similarity, intent scores, groups and what to read next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_similarity, normal_name
from .vectors import cosine

# Universal type of each inferred concept; every other name is its own type.
UNIVERSAL = {"logging": "observability"}
# Similarity of two different universal types, in either order.
TYPE_PAIRS = [
    ("calculation", "transformation", 0.6), ("validation", "error_handling", 0.5), ("service", "endpoint", 0.7), ("data_structure", "database_operation", 0.5),
    ("configuration", "infrastructure", 0.6), ("observability", "error_handling", 0.4), ("testing", "validation", 0.3),
]
# Presets of the hybrid similarity: threshold, weights of embedding, name and type, and from where a name adds.
PRESETS = {"default": (0.65, 0.5, 0.3, 0.2, 0.7), "strict": (0.8, 0.4, 0.4, 0.2, 0.8), "lenient": (0.5, 0.6, 0.25, 0.15, 0.5)}
# Weights of universal types for each intent; any other type weighs 0.1.
INTENT_TYPES = {
    "business_logic": {"calculation": 1.0, "validation": 0.9, "decision": 0.8, "transformation": 0.7, "service": 0.6},
    "debugging": {"error_handling": 1.0, "observability": 0.9, "validation": 0.7, "decision": 0.6, "integration": 0.5},
    "security": {"validation": 1.0, "error_handling": 0.9, "endpoint": 0.8, "database_operation": 0.7, "configuration": 0.6},
    "onboarding": {"service": 1.0, "endpoint": 0.9, "data_structure": 0.8, "configuration": 0.7, "infrastructure": 0.6},
    "migration": {"infrastructure": 1.0, "configuration": 0.9, "database_operation": 0.8, "integration": 0.7, "error_handling": 0.5},
}


def _labels(label: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def universal_type(concept: Column) -> Column:
    for name, other in UNIVERSAL.items():
        concept = F.when(concept == name, other).otherwise(concept)
    return concept


def type_similarity(a: Column, b: Column) -> Column:
    """1 for equal types, the pair's value, 0.1 where one is unknown, else 0.2."""
    out = F.when((a == "unknown") | (b == "unknown"), 0.1).otherwise(0.2)
    for x, y, value in TYPE_PAIRS:
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), value).otherwise(out)
    return F.when(a == b, 1.0).otherwise(out)


def hybrid(embedding: Column, name: Column, kind: Column, preset: str = "default") -> Column:
    """Weighted similarity of two concepts; very similar names add 0.15, to 1 at most."""
    _, e, n, t, boost = PRESETS[preset]
    base = e * embedding + n * name + t * kind
    return F.when(name > boost, F.least(base + 0.15, F.lit(1.0))).otherwise(base)


def equivalents(queries: DataFrame, concepts: DataFrame, preset: str = "default") -> DataFrame:
    """``query, concept_no, similarity`` of concepts of another language that reach the preset's threshold.

    Both sides: ``concept_no, name, language, type, embedding``. Pairs of one type are
    compared; ``queries`` is a stated set, ``concepts`` everything.
    """
    threshold = PRESETS[preset][0]
    side = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("concept_no", "name", "language", "type", "embedding")])
    pairs = side(queries, "a").join(side(concepts, "b"), (F.col("a_type") == F.col("b_type")) & (F.col("a_language") != F.col("b_language")))
    score = hybrid(cosine(F.col("a_embedding"), F.col("b_embedding")), name_similarity(F.col("a_name"), F.col("b_name")), type_similarity(F.col("a_type"), F.col("b_type")), preset)
    return pairs.withColumn("similarity", score).where(F.col("similarity") >= threshold).select(F.col("a_concept_no").alias("query"), F.col("b_concept_no").alias("concept_no"), "similarity")


def intent_score(kind: Column, intent: str, familiarity: Column) -> Column:
    """Weight of the type for the intent, halved where the language is not familiar at all."""
    return _labels(kind, INTENT_TYPES[intent], 0.1) * (0.5 + 0.5 * familiarity)


def canonical_names(members: DataFrame, group: str) -> DataFrame:
    """``group, canonical, members``: the most frequent normal name of a group; the least of equals."""
    counts = members.groupBy(group, normal_name(F.col("name")).alias("canonical")).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by("canonical", F.struct(-F.col("n"), "canonical")).alias("canonical"), F.sum("n").alias("members"))


def class_cohesion(members: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``group, members, cohesion``: mean cosine over all pairs of a group's members, 1 for a single one.

    The mean comes from the sum of unit vectors (its squared length counts every pair twice
    and every member once), so no pair is formed. A zero vector is similar to none.
    """
    unit = members.withColumn("_n", F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    long = unit.select(group, F.posexplode(vector).alias("dim", "x"), "_n").withColumn("u", F.coalesce(F.try_divide(F.col("x").cast("double"), F.col("_n")), F.lit(0.0)))
    sums = long.groupBy(group, "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("own"))
    both = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own")).join(members.groupBy(group).agg(F.count("*").alias("members")), group)
    pairs = F.col("members") * (F.col("members") - 1)
    return both.select(group, "members", F.when(F.col("members") < 2, 1.0).otherwise((F.col("all") - F.col("own")) / pairs).alias("cohesion"))


def brightest(items: DataFrame, group: str, score: str) -> DataFrame:
    """Adds ``is_brightest``: within 0.001 of the group's greatest score."""
    top = items.groupBy(F.col(group).alias("_g")).agg(F.max(score).alias("_top"))
    return items.join(top, F.col(group).eqNullSafe(F.col("_g"))).withColumn("is_brightest", F.abs(F.col(score) - F.col("_top")) < 0.001).drop("_g", "_top")


def group_stats(items: DataFrame, group: str, score: str, kind: str) -> DataFrame:
    """``group, size, mean_score, top_score, dominant``: dominant is the most frequent kind, the least of equals."""
    kinds = items.groupBy(group, kind).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.max(score).alias("m"))
    out = kinds.groupBy(group).agg(F.sum("n").alias("size"), F.sum("s").alias("s"), F.max("m").alias("top_score"), F.min_by(kind, F.struct(-F.col("n"), kind)).alias("dominant"))
    return out.withColumn("mean_score", F.col("s") / F.col("size")).drop("s")


def next_step(brightness: Column, cohesion: Column) -> tuple[Column, Column]:
    """(action, priority) for a group by its brightest member and its cohesion."""
    start, deep, good = brightness >= 0.9, cohesion >= 0.8, brightness >= 0.7
    action = F.when(start, "start_here").when(deep, "deep_dive").otherwise("explore")
    return action, F.when(start, 9).when(deep, 7).when(good, 6).otherwise(4)


def common_pattern(members: DataFrame, group: str) -> DataFrame:
    """``group, prefix, suffix``: what all names of a group begin and end with, when 3 letters or more.

    The common beginning of a set is that of its least and greatest name.
    """
    ends = members.groupBy(group).agg(F.min("name").alias("a"), F.max("name").alias("b"), F.min(F.reverse("name")).alias("c"), F.max(F.reverse("name")).alias("d"))

    def shared(x: Column, y: Column) -> Column:
        size = F.least(F.length(x), F.length(y))
        same = F.filter(F.sequence(F.lit(0), size), lambda n: F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))
        text = F.substring(x, F.lit(1), F.array_max(same))
        return F.when(F.length(text) >= 3, text)

    return ends.select(group, shared(F.col("a"), F.col("b")).alias("prefix"), F.reverse(shared(F.col("c"), F.col("d"))).alias("suffix"))


def best_match(pairs: DataFrame, query: str, other: str, score: str) -> DataFrame:
    """The best partner of every query; the greatest id of equals."""
    return pairs.groupBy(query).agg(F.max_by(F.struct(other, score), F.struct(score, other)).alias("m")).select(query, f"m.{other}", f"m.{score}")


def time_plan(items: DataFrame, minutes: int, order: list, limit: int) -> DataFrame:
    """The plan of at most ``limit`` elements under a budget of minutes: what would exceed it is skimmed.

    ``items``: ``score, minutes``; reading starts above 0.7. Time is spent by what is read
    only. The plan is bounded by ``limit``, so its running sums are one small window.
    """
    top = items.orderBy(*order).limit(limit)
    w = Window.orderBy(*order)
    rows = top.withColumn("rank", F.row_number().over(w)).withColumn("wants", F.col("score") > 0.7)
    steps = rows.groupBy(F.lit(1)).agg(F.array_sort(F.collect_list(F.struct("rank", "wants", F.col("minutes").cast("bigint").alias("minutes")))).alias("steps"))
    # a fold: what is read takes time, what does not fit is skimmed and takes none
    state = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("read"))

    def step(s: Column, x: Column) -> Column:
        fits = x["wants"] & (s["used"] + x["minutes"] <= minutes)
        return F.struct(F.when(fits, s["used"] + x["minutes"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["read"], F.array(x["rank"]))).otherwise(s["read"]).alias("read"))

    read = steps.select(F.aggregate("steps", state, step).alias("s")).select(F.explode("s.read").alias("rank")).withColumn("reads", F.lit(True))
    decided = F.when(F.col("reads"), "read").when(F.col("wants") | (F.col("score") > 0.4), "skim").otherwise("skip")
    return rows.join(read, "rank", "left").withColumn("decision", decided).drop("wants", "reads")
