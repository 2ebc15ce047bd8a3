"""Splitting oversized items at natural boundaries, with overlap.

Method: dynamic programming over the line boundaries of an item. A cut costs a penalty
that is low where a reader would pause (blank line, end of a block, start of a definition
or section) and high inside indentation, brackets, strings or a sentence; unequal piece
lengths cost their squared deviation. The sum is minimised subject to the greatest piece
length, while ``overlap`` lines are repeated between neighbours.

An item has ``newline characters + 1`` lines. A piece is a run of lines: the first holds
at most ``limit`` lines, and every later one starts ``overlap`` lines before its
neighbour's end; a line is never cut.

Defined results: null content or config, and a limit of 0 or less, give no pieces; an item
within the limit gives none either (it needs no cut); an overlap of the limit or more is
lowered to ``limit - 1``; a negative or null overlap is 0; repeated rows are split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEFINES = re.compile(r"(?:export |pub(?:\([^)]*\))? |async |static |public |private |default )*(?:def|class|func|function|fn|impl|struct|enum|trait|mod|interface|type|module|namespace)\b|#{1,6} |\[\[?[\w.\"-]+\]?\]$|@\w|#\[")
_ENDS = re.compile(r"(?:[})\]]+[;,]?|end|fi|done|esac|-{3,}|={3,}|\*{3,}|[.!?][\"')]?)$")


def penalties(lines: list[str]) -> np.ndarray:
    """Cost of a cut before each line (0 to 10); index 0 and the end are free."""
    n = len(lines)
    cost = np.zeros(n + 1)
    fence = False
    for i in range(1, n):
        before, here = lines[i - 1].strip(), lines[i]
        text = here.strip()
        if before.startswith("```"):
            fence = not fence
        indent = len(here) - len(here.lstrip())
        c = 4.0 + min(indent, 12) / 4
        if not before:
            c -= 3
        elif _ENDS.search(before):
            c -= 1.5
        elif before[-1:] in ",([{\\=+|&" or text[:1] in ")]}.+|&":
            c += 3
        if text and before and indent > len(lines[i - 1]) - len(lines[i - 1].lstrip()):
            c += 4  # a block belongs to its head
        if text and _DEFINES.match(text):
            c -= 2 if indent == 0 else 1
        if not text:
            c -= 0.5
        if before.startswith(("//", "#", "/*", "*", "@")) and text and not text.startswith("#"):
            c += 2  # a comment or decorator belongs to what follows
        if fence:
            c += 2
        cost[i] = max(c, 0.0)
    return cost


def cuts(cost: np.ndarray, limit: int, overlap: int, balance: float = 8.0) -> list[int]:
    """Piece ends (exclusive line numbers) of least total cost; the last is the end."""
    n = len(cost) - 1
    overlap = max(0, min(overlap, limit - 1))
    step = limit - overlap  # new lines of every piece but the first
    pieces = 1 if n <= limit else 1 + -(-(n - limit) // step)
    if pieces == 1:
        return [n]
    # ends shifted by the overlap make all pieces alike: of the first, `overlap` lines are free
    size = (n - overlap) / pieces
    best = np.full(n + 1, np.inf)
    back = np.zeros(n + 1, np.int64)
    lengths = np.arange(1, step + 1)
    away = balance * ((lengths - size) / step) ** 2 + 1.0  # every piece costs, so there are few
    first = np.arange(overlap + 1, limit + 1)
    first = first[first <= n]
    best[first] = cost[first] + balance * ((first - overlap - size) / step) ** 2 + 1.0
    for e in range(overlap + 2, n + 1):
        lo = max(overlap + 1, e - step)
        found = best[lo:e] + away[: e - lo][::-1]
        at = int(found.argmin())
        if found[at] + cost[e] < best[e]:
            best[e], back[e] = found[at] + cost[e], lo + at
    out = [n]
    while back[out[-1]]:
        out.append(int(back[out[-1]]))
    return out[::-1]


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of every piece, lines counted from 1."""
    lines = text.split("\n")
    if limit <= 0 or len(lines) <= limit:
        return []
    overlap = max(0, min(overlap, limit - 1))
    out, start = [], 0
    for end in cuts(penalties(lines), limit, overlap):
        out.append((start + 1, end, "\n".join(lines[start:end])))
        start = end - overlap
    return out


def joined(pieces: list[tuple[int, int, str]]) -> str:
    """The text again: what a piece repeats of its neighbour is dropped."""
    lines: list[str] = []
    for first, _, text in pieces:
        lines[first - 1 :] = text.split("\n")
    return "\n".join(lines)


def _split(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, limit, overlap in zip(pdf["key"], pdf["content"], pdf["lines"], pdf["overlap"]):
                for no, (first, last, piece) in enumerate(split(text, int(limit), int(overlap)), 1):
                    rows.append((key, no, first, last, piece) if with_text else (key, no, first, last))
            yield pd.DataFrame(rows, columns=["key", "piece_no", "start_line", "end_line", *["content"] * with_text]).astype({"piece_no": "int32", "start_line": "int32", "end_line": "int32"})

    return run


def split_items(items: DataFrame, configs: DataFrame, id_col: str = "proc_id", with_text: bool = True) -> DataFrame:
    """``proc_id, piece_no, start_line, end_line[, content]`` of all items with more lines than their config allows."""
    limits = configs.select("config_id", F.col("truncate_lines").alias("lines"), F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)).alias("overlap")).where("lines > 0").dropDuplicates(["config_id"])
    long = items.select(F.col(id_col).alias("key"), "config_id", "content").join(limits, "config_id").where(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1 > F.col("lines"))
    kind = items.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, piece_no int, start_line int, end_line int" + ", content string" * with_text
    return long.select("key", "content", "lines", "overlap").mapInPandas(_split(with_text), schema).withColumnRenamed("key", id_col)
