"""Declarations of Python files, and skeletons: signatures without bodies."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECLARATIONS = "file_id bigint, decl_id string, parent_id string, depth int, kind string, name string, start_line int, end_line int, doc_lines int, n_params int, is_async boolean, error string"
_BODY = {"rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\b", "javascript": r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b|^\s+(?:static\s+|async\s+|get\s+|set\s+|\*)*[\w$#]+\s*\([^)]*\)\s*\{", "go": r"^func\b"}
_KEEP = {"rust": r"^\s*(?:use|mod|const|static|type|struct|enum|trait|impl|pub|#\[|///)", "javascript": r"^\s*(?:import|export|class|const|let|var)\b", "go": r"^(?:package|import|type|const|var)\b"}


def _visit(node: ast.AST, parent: str | None, depth: int) -> Iterator[tuple]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
            own = f"{kind}:{child.name}:{child.lineno}"
            doc = ast.get_docstring(child, clean=False)
            args = 0 if kind == "class" else len(child.args.posonlyargs) + len(child.args.args) + len(child.args.kwonlyargs)
            yield own, parent, depth, kind, child.name, child.lineno, child.end_lineno, doc.count("\n") + 1 if doc else 0, args, isinstance(child, ast.AsyncFunctionDef), None
            yield from _visit(child, own, depth + 1)
        else:
            yield from _visit(child, parent, depth)


def _declare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in DECLARATIONS.split(", ")]
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["file_id"], pdf["content"]):
            try:
                rows += [(key, *r) for r in _visit(ast.parse(text), None, 0)]
            except (SyntaxError, ValueError, RecursionError) as e:
                rows.append((key, None, None, None, "error", None, getattr(e, "lineno", None), None, None, None, None, str(e)[:200]))
        out = pd.DataFrame(rows, columns=names)
        for c in ("depth", "start_line", "end_line", "doc_lines", "n_params"):
            out[c] = out[c].astype("Int32")
        yield out


def declarations(files: DataFrame) -> DataFrame:
    """Declarations of Python files with parent and depth; a file that does not parse gives one ``error`` row."""
    python = files.where(F.rlike("path", F.lit(r"(?i)\.py$")) & F.col("content").isNotNull()).select("file_id", "content")
    return python.mapInPandas(_declare, DECLARATIONS)


def skeleton_python(text: str) -> str:
    """Imports, class lines and definitions with ``...`` for their bodies; nested functions go with the body."""
    out, skip = [], None
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        indent = len(line) - len(line.lstrip())
        if skip is not None and (not line.strip() or indent > skip):
            i += 1
            continue
        skip = None
        if re.match(r"\s*(?:async\s+)?def\b", line):
            depth = 0
            while True:  # a signature may span lines
                out.append(lines[i])
                depth += sum(lines[i].count(c) for c in "([{") - sum(lines[i].count(c) for c in ")]}")
                if depth <= 0 or i + 1 >= len(lines):
                    break
                i += 1
            out.append(" " * (indent + 4) + "...")
            skip = indent
        elif re.match(r"\s*(?:class|import|from)\b", line):
            out.append(line)
        i += 1
    return "\n".join(out)


def skeleton_braces(text: str, lang: str, fallback: int = 20) -> str:
    """Signatures and declarations of a language with braces; bodies of functions are left out."""
    out, depth, hide = [], 0, None
    lines = text.split("\n")
    for line in lines:
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|//.*$", "", line)
        opened, closed = bare.count("{"), bare.count("}")
        if hide is None:
            if re.match(_BODY[lang], line):
                out.append(re.sub(r"\s*\{\s*$", " { ... }", line) if opened > closed else line)
                if opened > closed:
                    hide = depth
            elif re.match(_KEEP[lang], line) or (0 < depth and line.strip() not in ("",)) or line.strip() == "}":
                out.append(line)
        depth += opened - closed
        if depth < 0:
            return "\n".join(lines[:fallback])
        if hide is not None and depth <= hide:
            hide = None
    return "\n".join(out)


def skeleton(text: str, lang: str) -> str:
    return skeleton_python(text) if lang == "python" else skeleton_braces(text, lang) if lang in _BODY else "\n".join(text.split("\n")[:20])


def _skeletons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"file_id": pdf["file_id"], "skeleton": [skeleton(t, a) for t, a in zip(pdf["content"], pdf["language"])]})


def skeletons(files: DataFrame) -> DataFrame:
    """``file_id, skeleton`` of files with ``content`` and ``language``."""
    return files.where("content is not null").select("file_id", "content", "language").mapInPandas(_skeletons, "file_id bigint, skeleton string")


def compression(files: DataFrame) -> DataFrame:
    """``language, files, full_tokens, skeleton_tokens``: what skeletons save."""
    s = skeletons(files).select("file_id", F.floor(F.octet_length("skeleton") / 4).alias("small"))
    return files.select("file_id", "language", F.floor(F.octet_length("content") / 4).alias("full")).join(s, "file_id").groupBy("language").agg(F.count("*").alias("files"), F.sum("full").alias("full_tokens"), F.sum("small").alias("skeleton_tokens"))
