"""The tool's calls as functions: contexts, zooms, explorations, reports of use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import budget, classify, text
from ..operators.syntax_tree import skeletons
from . import render


def list_lenses() -> list[str]:
    return sorted(classify.LENSES)


def parse_budget(value: str) -> int:
    """``100k`` and ``2M`` as numbers; anything else is an error."""
    m = re.fullmatch(r"\s*(\d+)\s*([kKmM]?)\s*", value)
    if not m:
        raise ValueError(f"no token budget: {value!r}")
    return int(m[1]) * {"": 1, "k": 1000, "m": 1_000_000}[m[2].lower()]


def get_context(files: DataFrame, lens: str = "architecture", token_budget: str = "50k", fmt: str = "plus_minus", skeleton: bool = False, learned: DataFrame | None = None) -> DataFrame:
    """``rank, path, method, cost, value``: rendered files under a budget, best first.

    ``files``: ``file_id, path, content``; ``learned``: ``path, score`` of reported utility.
    With ``skeleton`` a file that does not fit falls back to its signatures, else to its
    declaring lines.
    """
    p = F.col("path")
    base = files.where("content is not null").select("file_id", "path", "content")
    scored = base.join(learned.select("path", "score"), "path", "left") if learned is not None else base.withColumn("score", F.lit(None).cast("double"))
    priority = classify.blend(classify.lens_priority(p, lens), F.col("score")) if learned is not None else classify.lens_priority(p, lens)
    if skeleton:
        small = skeletons(base.withColumn("language", S.language(p))).withColumnRenamed("skeleton", "reduced_text")
        scored = scored.join(small, "file_id")
    else:
        scored = scored.withColumn("reduced_text", text.truncate_structure(F.col("content")))
    ranked = scored.select("file_id", "path", "content", "reduced_text", classify.tier_rank(classify.tier(p)).alias("t"), (-priority).alias("p"), S.file_cost(p, F.col("content")).alias("full"), S.file_cost(p, F.col("reduced_text")).alias("small"))
    kept = budget.greedy(ranked, "file_id", ["t", "p", "path", "file_id"], "full", parse_budget(token_budget), "small")
    body = F.when(F.col("method") == "full", F.col("content")).otherwise(F.col("reduced_text"))
    out = kept.join(ranked, "file_id").select("t", "p", "path", "file_id", "method", "cost", render.FORMATS[fmt](p, body).alias("value"))
    return out.orderBy("t", "p", "path", "file_id").drop("t", "p")


def zoom(files: DataFrame, target: str, context: int = 8) -> DataFrame:
    """``path, first_line, excerpt`` for ``function=x``, ``class=x``, ``module=a.b`` or ``file=path:a-b``."""
    kind, _, value = target.partition("=")
    base = files.where("content is not null").select("file_id", "path", "content")
    if kind == "file":
        m = re.fullmatch(r"(.*?)(?::(\d+)-(\d+))?", value)
        first, last = int(m[2] or 1), int(m[3] or 1 << 30)
        lines = F.slice(S.line_array(F.col("content")), first, last - first + 1)
        return base.where(F.endswith("path", F.lit(m[1]))).select("path", F.lit(first).alias("first_line"), F.array_join(lines, "\n").alias("excerpt"))
    if kind == "module":
        at = value.replace(".", "/").replace("::", "/")
        return base.where(F.contains("path", F.lit(at))).select("path", F.lit(1).alias("first_line"), F.col("content").alias("excerpt"))
    if kind not in ("function", "class"):
        raise ValueError(f"no zoom target: {target!r}")
    kinds = ["fn", "def", "func", "function"] if kind == "function" else ["class", "struct", "enum", "trait", "interface"]
    found = text.symbols(base.where(F.contains("content", F.lit(value))), "file_id", "content").where((F.col("name") == value) & F.col("kind").isin(kinds))
    lines = F.slice(S.line_array(F.col("content")), F.greatest(F.col("line_no") - context, F.lit(1)), 2 * context + 1)
    return found.join(base, "file_id").orderBy("path", "line_no").select("path", F.col("line_no").alias("first_line"), F.array_join(lines, "\n").alias("excerpt"))


def explore(concepts: DataFrame, least: float = 0.4, most: int = 50) -> DataFrame:
    """``concept_no, name, concept, score, decision`` of what is worth reading, best first."""
    c = concepts.withColumn("concept", classify.concept(F.col("name"), F.lit("function"), F.col("documentation"), F.col("visibility"))).withColumn("lines", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    c = c.withColumn("score", F.round(classify.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name")), 6))
    return c.where(F.col("score") >= least).orderBy(F.desc("score"), "concept_no").limit(most).select("concept_no", "name", "concept", "score", classify.reading_decision(F.col("score")).alias("decision"))


def report_utility(spark: SparkSession, folder: str, path: str, utility: float, seq: int) -> None:
    """Appends one report; ``streaming.state`` folds them into learned scores."""
    if not 0 <= utility <= 1:
        raise ValueError("utility lies between 0 and 1")
    spark.createDataFrame([(path, float(utility), seq)], "path string, utility double, seq bigint").coalesce(1).write.mode("append").parquet(folder)
