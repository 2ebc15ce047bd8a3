"""Queries of the operators for training data: each runs over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import docpairs, leakage, mixing, packing, provenance, secrets, spans, splitting, syntax, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "file_entries"), table(spark, d, "file_descriptors")).select("file_id")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = provenance.provenance(table(spark, d, "file_entries"), table(spark, d, "file_descriptors"))
    return found.groupBy("kind").count().withColumnRenamed("count", "files")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.totals(table(spark, d, "documents"))


def p2_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return tokens.accuracy(table(spark, d, "documents"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return tokens.file_totals(table(spark, d, "file_entries"), table(spark, d, "repos"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = packing.vector_items(table(spark, d, "budget_vectors"))
    return items, packing.pack_items(items, "vector_id", "path", "cost", "capacity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversize(_packed(spark, d)[1])


def p3_containers(spark: SparkSession, d: str) -> DataFrame:
    items, packed = _packed(spark, d)
    return packing.container_report(packed, items)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "file_entries")).select("file_id", "start_line")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "file_entries"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "file_entries"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "file_entries"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_items(table(spark, d, "processed_files"), table(spark, d, "encoder_configs"), with_text=False)
    return pieces.where("piece_no = 1").select("proc_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "processed_files"), table(spark, d, "encoder_configs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_credentials(table(spark, d, "file_entries"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "file_entries"))


def p7_issuers(spark: SparkSession, d: str) -> DataFrame:
    return secrets.issuers(table(spark, d, "file_entries"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), items), items)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_runs(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
