"""Source files that do not parse in the language their path claims.

Method: a chunk of a file is a map from the lexer states it may begin in to the state it
ends in and a bracket summary: class letters in which every group closed inside the chunk
has been parsed by its local grammar (``grammars``) into one letter, and brackets without
partner stand for themselves. Such maps compose associatively, so the chunks of a long
file (JavaScript, Rust, Go, JSON) are lexed and parsed in parallel and reduced in any
grouping; the letters left at the outermost level are judged at the end. The verdict does
not depend on the size of the chunks. Where a chunk cannot be read without what precedes
it (a slash that begins it, a template's brace taken for a block's), the file is parsed
whole. Python has no brackets around its blocks and is parsed whole by the standard
library, as is JSON of one chunk.

Defined results: null content and other extensions are not judged (no row); empty
content is valid except in JSON; a byte-order mark and any line ends are no fault;
repeated rows are judged each; extra columns are ignored. A Python file nested too deeply
for the parser is not flagged.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .grammars import GoGrammar, Grammar, JsGrammar, JsonGrammar, RustGrammar
from .lexing import Tokens

#: Extension to language, of the languages that are judged.
LANGUAGES = {"py": "python", "js": "javascript", "rs": "rust", "go": "go", "json": "json"}


def language(path: Column) -> Column:
    """The language that the extension of a path claims, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


@cache
def grammar(lang: str) -> Grammar:
    return {"javascript": JsGrammar, "rust": RustGrammar, "go": GoGrammar, "json": JsonGrammar}[lang]()


def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text, "text", "exec", dont_inherit=True, optimize=0)
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError, OverflowError):
            return True
    return True


def _constant(word: str):
    raise ValueError(word)


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_constant, parse_int=len, parse_float=len)
    except RecursionError:
        return grammar("json").valid(text)
    except ValueError:
        return False
    return True


def valid(lang: str, text: str, tokens: Tokens | None = None) -> bool:
    """Is the text a file of the language: names need not resolve, but every statement must parse."""
    text = text.removeprefix("﻿")
    if lang == "python":
        return _python(text)
    if lang == "json":
        return _json(text)
    return grammar(lang).valid(text, tokens)


#: Languages whose files are read in chunks.
CHUNKED = ["javascript", "rust", "go", "json"]
#: Comment depths and raw-string fences of Rust that a chunk answers for; a file that needs more is parsed whole.
DEPTHS = 16
_NEST = re.compile(r"/\*|\*/")
_FENCE = re.compile(r'"(\#+)')

#: A chunk's map: start state to (end state, verdict, letters).
ChunkMap = dict[str, tuple[str, str, str]]


def _read(lang: str, chunk: str, state: str, head: bool) -> tuple[str, str, str]:
    g = grammar(lang)
    tokens = g.lex(chunk, state, head)
    if tokens.unsure:
        return "", "?", ""
    if tokens.bad >= 0 and not tokens.open:
        return "", "!", ""
    return (tokens.open, *g.reduce(tokens.kinds))


def chunk_map(lang: str, chunk: str, head: bool = False) -> ChunkMap:
    """For every state in which a chunk may begin: the state it ends in, a verdict, and its reduced letters.

    States are "" (code), the quote of an open string or template, "/*" in a comment; in
    Rust "/*n" at comment depth n and "r#.." in a raw string. States of Rust without an
    entry are those that do not end within the chunk: "+" tells by how much comments
    deepen, "deep" and "fence" up to where a state would end without having an entry.
    """
    if head:
        return {"": _read(lang, chunk, "", True)}
    states = {"javascript": ["", "/*", "`", '"', "'"], "go": ["", "/*", "`"], "json": [""], "rust": ["", '"']}[lang]
    out: ChunkMap = {}
    if lang == "rust":
        depth = low = 0
        for m in _NEST.finditer(chunk):
            depth += 1 if m[0] == "/*" else -1
            low = min(low, depth)
        fence = max(map(len, _FENCE.findall(chunk)), default=0) if '"' in chunk else -1
        states = states + [f"/*{d}" for d in range(1, min(-low, DEPTHS) + 1)] + ["r" + "#" * n for n in range(min(fence, DEPTHS) + 1)]
        out = {"+": (str(depth), "", ""), "deep": (str(-low), "", ""), "fence": (str(fence), "", "")}
    return out | {s: _read(lang, chunk, s, False) for s in states}


def entry(m: ChunkMap, state: str) -> tuple[str, str, str]:
    """What a chunk does when it begins in ``state``."""
    if state in m:
        return m[state]
    if state.startswith("/*") and state[2:]:
        return ("", "?", "") if int(state[2:]) <= int(m["deep"][0]) else (f"/*{int(state[2:]) + int(m['+'][0])}", "", "")
    if state.startswith("r"):
        return ("", "?", "") if len(state) - 1 <= int(m["fence"][0]) else (state, "", "")
    return "", "?", ""


def compose(lang: str, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two neighbouring chunks; composition is associative."""
    out: ChunkMap = {}
    for start, (mid, verdict, letters) in a.items():
        if start in ("+", "deep", "fence"):
            continue
        end, more, added = ("", "", "") if verdict else entry(b, mid)
        if not verdict and not more:
            more, letters = grammar(lang).reduce(letters + added)
        out[start] = (end, verdict or more, letters if not (verdict or more) else "")
    if "+" in a:
        rise, low = int(a["+"][0]), int(a["deep"][0])
        out["+"], out["deep"] = (str(rise + int(b["+"][0])), "", ""), (str(max(low, int(b["deep"][0]) - rise)), "", "")
        out["fence"] = (str(max(int(a["fence"][0]), int(b["fence"][0]))), "", "")
        # states that the first chunk leaves as they are begin the second
        for d in range(low + 1, DEPTHS + 1):
            out.setdefault(f"/*{d}", entry(b, f"/*{d + rise}"))
        for n in range(int(a["fence"][0]) + 1, DEPTHS + 1):
            out.setdefault("r" + "#" * n, entry(b, "r" + "#" * n))
    return out


def in_chunks(lang: str, text: str, size: int) -> bool | None:
    """The verdict of a text read in chunks, or None where it must be parsed whole."""
    parts = list(cut_lines(text.removeprefix("\ufeff"), size)) or [""]
    whole = chunk_map(lang, parts[0], True)
    for p in parts[1:]:
        whole = compose(lang, whole, chunk_map(lang, p))
    return _judge(lang, whole[""])


def _judge(lang: str, result: tuple[str, str, str]) -> bool | None:
    end, verdict, letters = result
    if verdict:
        return None if verdict == "?" else False
    return not end and grammar(lang).whole(letters)


def cut_lines(text: str, size: int) -> Iterator[str]:
    """Chunks of at least ``size`` characters that end behind a line end."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else (text.find("\n", at + size) + 1 or len(text))
        yield text[at:end]
        at = end


def _chunks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, digest, text in zip(pdf["lang"], pdf["digest"], pdf["content"]):
                for seq, chunk in enumerate(cut_lines(text.removeprefix("\ufeff"), size)):
                    yield pd.DataFrame({"lang": [lang], "digest": [digest], "seq": [seq], "chunk": [chunk]})

    return run


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"lang": pdf["lang"], "digest": pdf["digest"], "seq": pdf["seq"], "map": [json.dumps(chunk_map(a, c, n == 0)) for a, c, n in zip(pdf["lang"], pdf["chunk"], pdf["seq"])]})


def _reduce(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One file's maps, a fraction of its text, composed in order."""
    whole = None
    for m in pdf.sort_values("seq")["map"]:
        part = {k: tuple(v) for k, v in json.loads(m).items()}
        whole = part if whole is None else compose(key[0], whole, part)
    return pd.DataFrame({"lang": [key[0]], "digest": [key[1]], "valid": pd.Series([_judge(key[0], whole[""])], dtype="boolean")})


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "valid": [valid(a, t) for a, t in zip(pdf["lang"], pdf["content"])]})


def judged(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", chunk: int = 1 << 20) -> DataFrame:
    """``key, valid`` for every row with content and a judged extension."""
    base = files.select(F.col(id_col).alias("key"), language(F.col(path_col)).alias("lang"), F.col(content_col).alias("content")).where("lang is not null and content is not null")
    size = F.char_length("content")
    split = F.col("lang").isin(CHUNKED)
    kind = base.schema["key"].dataType.simpleString()
    whole = spread(base.where((size <= chunk) | ~split)).mapInPandas(_verdicts, f"key {kind}, valid boolean")
    long = base.where((size > chunk) & split).withColumn("digest", F.sha2("content", 256))
    texts = long.select("lang", "digest", "content").dropDuplicates(["lang", "digest"])
    maps = texts.mapInPandas(_chunks(chunk), "lang string, digest string, seq int, chunk string").repartition("digest", "seq").mapInPandas(_maps, "lang string, digest string, seq int, map string")
    judged_ = maps.groupBy("lang", "digest").applyInPandas(_reduce, "lang string, digest string, valid boolean")
    verdict = long.join(judged_, ["lang", "digest"])
    again = verdict.where("valid is null").select("key", "lang", "content").mapInPandas(_verdicts, f"key {kind}, valid boolean")
    return whole.unionByName(verdict.where("valid is not null").select("key", "valid")).unionByName(again)


def invalid_files(files: DataFrame, **options) -> DataFrame:
    return judged(files, **options).where("not valid").select(F.col("key").alias("file_id"))


def rates(files: DataFrame) -> DataFrame:
    """``repo_id, language, files, invalid, rate``: share of files that do not parse."""
    verdict = judged(files).select(F.col("key").alias("file_id"), "valid")
    return files.select("file_id", "repo_id", language(F.col("path")).alias("language")).join(verdict, "file_id").groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("rate"))
