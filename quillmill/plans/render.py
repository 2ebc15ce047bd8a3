"""Serialised entries as columns, and sinks that write whole contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FENCE_BY_EXTENSION, by_map, cdata, escape_xml, extension, language


def plus_minus(path: Column, content: Column) -> Column:
    """Header, body and a footer with the md5 of the body."""
    body = F.when(F.endswith(content, F.lit("\n")), content).otherwise(F.concat(content, F.lit("\n")))
    return F.concat(F.lit("++++++++++ "), path, F.lit(" ++++++++++\n"), body, F.lit("---------- "), path, F.lit(" "), F.md5(content), F.lit(" "), path, F.lit(" ----------\n"))


def xml_entry(path: Column, content: Column) -> Column:
    return F.concat(F.lit('<file path="'), escape_xml(path), F.lit('" md5="'), F.md5(content), F.lit('"><![CDATA[\n'), cdata(content), F.lit("\n]]></file>\n"))


def markdown_entry(path: Column, content: Column) -> Column:
    return F.concat(F.lit("## "), path, F.lit("\n\n```"), language(path), F.lit("\n"), content, F.lit("\n```\n"))


def _skeleton(head: Column, level: Column, original: Column) -> Column:
    tokens = F.when(original.isNotNull(), F.concat(F.lit(" (original: "), original.cast("string"), F.lit(" tokens)"))).otherwise("")
    return F.concat(head, F.when(F.lower(level) == "skeleton", F.concat(F.lit(" [SKELETON]"), tokens)).otherwise(""))


def core_plus_minus(path: Column, content: Column, md5: Column, level: Column, original: Column) -> Column:
    """The core's layout: every line behind a plus, the md5 in the footer, skeletons marked."""
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n"))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+ "), x, F.lit("\n"))), "")
    return F.concat(_skeleton(F.concat(F.lit("+++ "), path), level, original), F.lit("\n"), body, F.lit("--- "), path, F.lit(" [md5:"), F.coalesce(md5, F.lit("")), F.lit("]\n\n"))


def core_xml(path: Column, content: Column, md5: Column, label: Column, level: Column, original: Column, utility: Column) -> Column:
    """The core's element: utility and skeleton as attributes, the content escaped."""
    bright = F.when(utility.isNotNull(), F.concat(F.format_string(' utility="%.2f"', F.bround(utility, 2)), F.lit(' bright="'), (utility >= 0.8).cast("string"), F.lit('"'))).otherwise("")
    tokens = F.when(original.isNotNull(), F.concat(F.lit(' original_tokens="'), original.cast("string"), F.lit('"'))).otherwise("")
    small = F.when(F.lower(level) == "skeleton", F.concat(F.lit(' skeleton="true"'), tokens)).otherwise("")
    head = F.concat(F.lit('<file path="'), escape_xml(path), F.lit('" md5="'), F.coalesce(md5, F.lit("")), F.lit('" language="'), F.coalesce(label, F.lit("")), F.lit('"'), bright, small, F.lit(">\n"))
    return F.concat(head, escape_xml(content), F.lit("\n</file>\n"))


def core_markdown(path: Column, content: Column, level: Column, original: Column) -> Column:
    end = F.when(F.endswith(content, F.lit("\n")), "").otherwise("\n")
    return F.concat(_skeleton(F.concat(F.lit("## "), path), level, original), F.lit("\n\n```"), by_map(extension(path), FENCE_BY_EXTENSION, ""), F.lit("\n"), content, end, F.lit("```\n\n"))


FORMATS = {"plus_minus": plus_minus, "xml": xml_entry, "markdown": markdown_entry}


def write_context(files: DataFrame, folder: str, fmt: str = "plus_minus", order: str = "path") -> None:
    """Entries in global order as text files; ranges of the order are written in parallel."""
    files.orderBy(order).select(FORMATS[fmt](F.col("path"), F.col("content")).alias("value")).write.mode("overwrite").text(folder)
