"""Functions paired with their own documentation.

Method: a packrat parsing expression grammar per language over tokens with source
offsets (``packrat``); semantic actions turn each parsed definition into a pair of code
and documentation, and a filter drops documentation that says nothing. Pairs of files
that do not parse (``syntax``) are dropped; only files that yield a pair are parsed whole.

Defined results: null or empty content, other extensions and unparsable files give no
pairs; repeated files give their pairs each; nested functions are functions of their own.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import lexing
from .packrat import Peg
from .syntax import language, valid

_GRAMMARS = {
    "python": (
        lexing.PYTHON,
        """
        function <- signature ':' line
        signature <- 'async'? 'def' name 'squares'? group returns?
        name <- 'name'
        returns <- '->' ( group / !':' !'newline' any )+
        line <- 'newline'* doc ( 'newline' / ';' )
        doc <- 'string'+
        """.replace(" 'squares'?", " ( &'[' group )?"),
    ),
    "javascript": (
        lexing.JS,
        """
        function <- ( 'export' 'default'? )? signature
        signature <- 'async'? 'function' '*'? name group block / 'const' name '=' ( 'async'? 'function' '*'? ident? group block / 'async'? ( ident / group ) '=>' )
        method <- methodhead group block
        methodhead <- ( modifier !'(' !'=' )* '*'? name
        modifier <- 'static' / 'async' / 'get' / 'set'
        classhead <- 'class' ident? ( 'extends' ( !'{' ( group / any ) )+ )? body
        body <- &'{' group
        block <- &'{' group
        name <- ident / 'private' / word
        ident <- 'name' / 'of' / 'get' / 'set' / 'from' / 'as' / 'async'
        word <- 'delete' / 'import' / 'export' / 'default' / 'new' / 'in' / 'static' / 'catch' / 'let' / 'return' / 'await' / 'yield' / 'typeof' / 'void' / 'with' / 'case' / 'break' / 'continue' / 'do' / 'for' / 'this' / 'throw' / 'null' / 'true' / 'false' / 'try' / 'finally' / 'var' / 'const' / 'class' / 'debugger' / 'else' / 'enum'
        """.replace(" / 'enum'", ""),
    ),
    "rust": (
        lexing.RUST,
        """
        function <- attribute* signature
        attribute <- '#' group
        signature <- ( 'pub' ( &'(' group )? )? ( 'const' / 'async' / 'unsafe' / 'extern' 'string'? )* 'fn' name angles? params rest
        name <- 'name' / 'union' / 'macro_rules'
        angles <- '<' ( angles / group / !'>' !'{' !';' any )* '>'
        params <- &'(' group
        rest <- ( group_not_block / !'{' !';' any )* ( block / ';' )
        group_not_block <- !'{' group
        block <- &'{' group
        """,
    ),
    "go": (
        lexing.GO,
        """
        function <- signature
        signature <- 'func' receiver? name ( &'[' group )? params
        receiver <- &'(' group
        params <- &'(' group
        name <- 'name'
        """,
    ),
}
_LEX = {"python": lexing.lex_python, "javascript": lexing.lex_js, "rust": lexing.lex_rust, "go": lexing.lex_go}


@cache
def peg(lang: str) -> Peg:
    return Peg(*_GRAMMARS[lang])


def _block_text(comment: str) -> str:
    body = re.sub(r"^/\*+!?|\*+/$", "", comment)
    return "\n".join(re.sub(r"^\s*\*+ ?", "", x).rstrip() for x in body.splitlines()).strip()


def _string(token: str) -> str:
    try:
        with_value = ast.literal_eval(token)
    except (ValueError, SyntaxError):
        return ""
    return with_value if isinstance(with_value, str) else ""


def _rust_string(token: str) -> str:
    m = re.fullmatch(r'r?(#*)"(.*)"\1', token, re.S)
    return m[2].replace('\\"', '"').replace("\\n", "\n") if m else ""


class _Source:
    """A file's tokens without line ends, its comments, and the line of an offset."""

    def __init__(self, lang: str, text: str):
        tokens = _LEX[lang](text)
        self.text, self.ok, self.tokens = text, tokens.bad < 0, tokens
        keep = range(len(tokens.kinds))
        if lang == "javascript":
            newline = lexing.JS["newline"]
            keep = [i for i in keep if tokens.kinds[i] != newline]
        self.kinds = [tokens.kinds[i] for i in keep]
        self.starts = [tokens.starts[i] for i in keep]
        self.ends = [tokens.ends[i] for i in keep]
        self.comments = tokens.comments
        self.comment_starts = [s for s, _ in tokens.comments]
        self.lines = [m.start() for m in re.finditer("\n", text)]

    def line(self, offset: int) -> int:
        return bisect_left(self.lines, offset) + 1

    def above(self, token: int, first: int | None = None) -> list[tuple[int, int]]:
        """Comments between the token before ``first`` (else ``token``) and ``token``."""
        first = token if first is None else first
        begin = self.ends[first - 1] if first else 0
        lo, hi = bisect_left(self.comment_starts, begin), bisect_right(self.comment_starts, self.starts[token])
        return self.comments[lo:hi]


def _pairs(src: _Source, lang: str) -> Iterator[tuple[str, int, int, int, str]]:
    """(name, offset of the signature, end offset, start line, documentation) of every documented function."""
    text = src.text
    if not src.ok:
        return
    g = peg(lang)
    parse = g.parser(src.kinds)
    a = g.alphabet
    n, at = len(src.kinds), 0

    def named(b: dict[str, int]) -> str:
        i = b["name"]
        return text[src.starts[i] : src.ends[i]]

    if lang == "python":
        first = {a["def"], a["async"]}
        for i, k in enumerate(src.kinds):
            if k in first and (i == 0 or src.kinds[i - 1] != a["async"]):
                found = parse.match("function", i)
                if found:
                    end, b = found
                    parts = []
                    d = b["doc"]
                    while src.kinds[d] == a["string"]:
                        parts.append(_string(text[src.starts[d] : src.ends[d]]))
                        d += 1
                    yield named(b), src.starts[i], src.ends[end - 1], src.line(src.starts[i]), "".join(parts)
    elif lang == "javascript":
        first = {a[x] for x in ("export", "async", "function", "const")}

        def documented(i: int, begin: int) -> str | None:
            blocks = [text[s:e] for s, e in src.above(i) if text.startswith("/**", s) and e - s > 4]
            return _block_text(blocks[-1]) if blocks else None

        while at < n:
            k = src.kinds[at]
            if k in first and (found := parse.match("function", at)):
                end, b = found
                doc = documented(at, at)
                if doc is not None:
                    yield named(b), src.starts[at], src.ends[end - 1], src.line(src.starts[at]), doc
                at = b["name"]
            elif k == a["class"] and (found := parse.match("classhead", at)):
                i, stop = found[1]["body"] + 1, parse.jump[found[1]["body"]] - 1
                while i < stop:
                    m = parse.match("method", i)
                    if m:
                        doc = documented(i, i)
                        if doc is not None:
                            yield named(m[1]), src.starts[i], src.ends[m[0] - 1], src.line(src.starts[i]), doc
                        i = m[0]
                    else:
                        i = parse.jump.get(i, i + 1)
            at += 1
    elif lang == "rust":
        first = {a[x] for x in ("#", "pub", "const", "async", "unsafe", "extern", "fn")}
        while at < n:
            if src.kinds[at] in first and (found := parse.match("function", at)):
                end, b = found
                sig = b["signature"]
                docs = []
                for s, e in src.above(sig, at):
                    c = text[s:e]
                    if c.startswith("///") and not c.startswith("////"):
                        docs.append((s, c[3:].strip()))
                    elif c.startswith("/**") and not c.startswith("/***") and len(c) > 4:
                        docs.append((s, _block_text(c)))
                i = at
                while i < sig:  # #[doc = "text"]
                    end_a = parse.jump[i + 1]
                    inner = text[src.starts[i + 2] : src.ends[i + 2]] if end_a - i > 4 else ""
                    if inner == "doc" and src.kinds[i + 3] == a["="] and src.kinds[i + 4] == a["string"]:
                        docs.append((src.starts[i], _rust_string(text[src.starts[i + 4] : src.ends[i + 4]])))
                    i = end_a
                if "block" in b and b["block"] + 1 < n:
                    for s, e in src.above(b["block"] + 1):
                        if text.startswith(("//!", "/*!"), s):
                            docs.append((s, _block_text(text[s:e]) if text[s + 1] == "*" else text[s + 3 : e].strip()))
                if docs:
                    yield named(b), src.starts[sig], src.ends[end - 1], src.line(src.starts[sig]), "\n".join(x for _, x in sorted(docs))
                at = b["name"]
            at += 1
    else:
        depth = 0
        for i, k in enumerate(src.kinds):
            if k in g.brackets:
                depth += 1
            elif k in g.brackets.values():
                depth -= 1
            elif k == a["func"] and not depth and (found := parse.match("function", i)):
                group, line = [], src.line(src.starts[i])
                for s, e in reversed(src.above(i)):
                    # a comment behind code on its line is not a comment above
                    own = not text[text.rfind("\n", 0, s) + 1 : s].strip("﻿ \t\r")
                    if not own or src.line(e) != line - 1 + (src.line(e) == line):
                        break
                    line = src.line(s)
                    c = text[s:e]
                    if not re.match(r"//[a-z0-9]+:[a-z0-9]|//(?:nolint|export |extern |line )", c):
                        group.append(c[2:].strip() if c.startswith("//") else _block_text(c))
                if group:
                    end = found[0]
                    body = next((j for j in range(end, n) if src.kinds[j] in (a["{"], a[";"])), end - 1)
                    stop = parse.jump.get(body, body + 1) - 1
                    yield named(found[1]), src.starts[i], src.ends[stop], src.line(src.starts[i]), "\n".join(reversed(group))


# Words that placeholder documentation consists of.
PLACEHOLDERS = """todo fixme xxx tbd tba wip hack n na none null nil nothing missing empty placeholder docstring doc docs documentation comment description summary
 document documented write add fill me here later this in to be the a an no not yet method function desc undocumented stub pending needs need needed soon coming describe insert your text some
 lorem ipsum foo bar baz please update untitled temp tmp dummy go goes for now see code self explanatory""".split()
_NOTE = re.compile(r"\s*(?:[#*/-]\s*)*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?!desc|description|summary|brief|remarks)\w+|:\w+[^:\n]*:|#\s*(?:Arguments|Returns|Errors|Examples|Panics|Safety)\s*$).*$", re.M)
_SECTION = re.compile(r"^([ \t]*)(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Attributes|Notes?|Examples?):[ \t]*\n(?:(?:\1[ \t]+[^\n]*|[ \t]*)(?:\n|\Z))*", re.M)
_HTML = re.compile(r"</?\w[^<>]*>|\{@\w+[^{}]*\}")


def _parts(name: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+", name)]


def informative(doc: str, name: str) -> bool:
    """Does documentation say anything beyond tags, placeholders and the function's own name?"""
    text = _HTML.sub(" ", _TAG.sub(" ", _SECTION.sub(" ", doc + "\n")))
    text = re.sub(r"@(?:desc|description|summary|brief|remarks)\b|\\brief\b", " ", text)
    if _NOTE.match(text):
        return False
    words = [w.lower() for w in re.findall(r"[^\W_]+", text)]
    if not words or set(words) <= set(PLACEHOLDERS):
        return False
    return [p for w in re.findall(r"[^\W]+", text) for p in _parts(w)] != _parts(name)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["key", "start_line", "name", "language", "code", "documentation"]
    for pdf in batches:
        rows = []
        for key, lang, text in zip(pdf["key"], pdf["lang"], pdf["content"]):
            src = _Source(lang, text)
            pairs = [(key, line, name, lang, text[s:e], doc.strip()) for name, s, e, line, doc in _pairs(src, lang) if informative(doc, name)]
            if pairs and valid(lang, text, src.tokens):
                rows += pairs
        yield pd.DataFrame(rows, columns=columns).astype({"start_line": "int32"})


def documented_functions(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``file_id, start_line, name, language, code, documentation`` of functions with informative documentation."""
    base = files.select(F.col(id_col).alias("key"), language(F.col(path_col)).alias("lang"), F.col(content_col).alias("content")).where("lang is not null and lang <> 'json' and content is not null")
    kind = base.schema["key"].dataType.simpleString()
    return spread(base).mapInPandas(_extract, f"key {kind}, start_line int, name string, language string, code string, documentation string").withColumnRenamed("key", "file_id")
