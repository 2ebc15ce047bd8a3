"""Lexers that turn source text into one class letter for each token, with offsets.

Every token is a single character in the class string, so that local grammars are plain
regular expressions over class strings (see ``grammars``). Offsets of tokens and the
comments between them are kept for operators that need the source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tokens:
    kinds: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    bad: int = -1  # offset of the first character no token begins with
    open: str = ""  # the state that a chunk ends in, where it ends inside a token
    unsure: bool = False  # what a slash means depends on what stands before the chunk


class Alphabet:
    """Class letters of a language: one for every keyword and operator, and some for kinds."""

    def __init__(self, kinds: str, keywords: str, operators: str):
        self.letter: dict[str, str] = {}
        for n, word in enumerate([*kinds.split(), *keywords.split(), *operators.split()]):
            self.letter.setdefault(word, chr(0x4E00 + n))
        self.keywords = {w: self.letter[w] for w in keywords.split()}
        self.operators = {w: self.letter[w] for w in operators.split()}

    def __getitem__(self, word: str) -> str:
        return self.letter[word]

    def any(self, words: str) -> str:
        return "[" + "".join(self.letter[w] for w in words.split()) + "]"


def _ops(operators: str) -> str:
    return "|".join(re.escape(o) for o in sorted(operators.split(), key=len, reverse=True))


# The keywords and operators of ECMAScript, Rust and Go.
JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield await null true false let static async of get set from as"
JS_OPS = "{ } ( ) [ ] ; , . ... ? ?. ?? ??= : => = + - * / % ** += -= *= /= %= **= ++ -- < > <= >= == != === !== & | ^ ~ ! && || &&= ||= &= |= ^= << >> >>> <<= >>= >>>= ${ }$ #"
RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules"
RUST_OPS = "{ } ( ) [ ] ; , . .. ... ..= : :: -> => = == != < <= > + - * / % ^ ! & | && || += -= *= /= %= ^= &= |= << <<= @ # $ ? ~ _"
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_OPS = "{ } ( ) [ ] ; , . ... : := = + - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == != < <= > >= ! ~"

JS = Alphabet("name number string template regex private newline", JS_WORDS, JS_OPS)
RUST = Alphabet("name number string char lifetime generics", RUST_WORDS, RUST_OPS)
GO = Alphabet("name number string char", GO_WORDS, GO_OPS)

_ID = r"[^\W\d]\w*+"
_DIGITS = r"0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:[0-9][0-9_]*+(?:\.[0-9_]++)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9][0-9_]*+)?"
_JS = re.compile(
    r"[ \t\r\f\v  -​　﻿]*+(?:(\n[\s﻿]*+)|((?:[^\W\d]|\$)[\w$]*+)|((?:0[xX][0-9a-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?:[0-9][0-9_]*+\.?[0-9_]*+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?)n?(?![\w$]))"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+')|(//[^\n]*+|/\*(?s:.*?)\*/|\A\#![^\n]*+)|(\#(?:[^\W\d]|\$)[\w$]*+)|(`)|(/(?!\*)=?)|(" + _ops(JS_OPS.replace(" ${ }$ #", "").replace(" / ", " ").replace(" /= ", " ")) + r")|(\S))"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[A-Za-z]*+")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")
_JS_CONTINUED = re.compile(r"[\"'](?:[^\\\n\r]|\\(?:\r\n|[\s\S]))*+\Z")
#: How a token ends that began in an earlier chunk.
_ENDS = {"/*": re.compile(r"\*/"), '"': re.compile(r'(?:[^"\\]|\\[\s\S])*+"'), "`": re.compile("`")}
_JS_STRING_END = {c: re.compile(rf"(?:[^{c}\\\n\r]|\\(?:\r\n|[\s\S]))*+({c}|\Z)") for c in "\"'"}


def _resumed(out: Tokens, text: str, pos: int, state: str, letter: str) -> int:
    """Behind the token that was open at ``pos``, whose letter is added; -1 where it does not end."""
    end = _ENDS[state]
    m = end.match(text, pos) if state == '"' else end.search(text, pos)
    if not m:
        return -1
    if letter:
        out.kinds.append(letter)
        out.starts.append(pos)
        out.ends.append(m.end())
    return m.end()
_VALUE_END = {JS["name"], JS["number"], JS["string"], JS["template"], JS["regex"], JS["private"], JS[")"], JS["]"], JS["}"], JS["this"], JS["super"], JS["null"], JS["true"], JS["false"], JS["++"], JS["--"], *(JS[w] for w in "of get set from as static async let".split())}


def lex_js(text: str, state: str = "", head: bool = True) -> Tokens:
    """Tokens of a text, or of a chunk that begins in ``state``; ``head``: the text begins a file."""
    out = Tokens()
    kinds, starts, ends, comments = out.kinds, out.starts, out.ends, out.comments
    words, ops = JS.keywords, JS.operators
    kname, knum, kstr, ktpl, kre, kpriv, knl = (JS[x] for x in "name number string template regex private newline".split())
    openers: list[bool] = []  # for each open brace: does it belong to a template
    if not head:  # a blank before it, as only a file's first line may be a command line
        text = " " + text
    pos, n = 0 if head else 1, len(text)

    def template(at: int, start: int) -> int:
        m = _JS_TEMPLATE.match(text, at)
        if not m:
            return -1
        kinds.append(ktpl if m[1] == "`" else JS["${"])
        starts.append(start)
        ends.append(m.end())
        if m[1] != "`":
            openers.append(True)
        return m.end()

    if state == "`":
        pos = template(pos, pos)
    elif state == "/*":
        pos = _resumed(out, text, pos, state, knl)
    elif state:
        m = _JS_STRING_END[state].match(text, pos)
        if m and m[1]:
            pos = m.end()
            kinds.append(kstr)
            starts.append(0)
            ends.append(pos)
        else:
            out.bad, out.open = 0, state if m and text.endswith(("\\\n", "\\\r\n")) else ""
            return out
    if pos < 0:
        out.bad, out.open = 0, state
        return out
    while pos < n:
        for m in _JS.finditer(text, pos):
            g = m.lastindex
            s, e = m.span(g)
            if g == 2:
                w = m[2]
                kinds.append(words.get(w, kname))
            elif g == 9:
                w = m[9]
                if w == "{":
                    openers.append(False)
                elif w == "}" and openers and openers.pop():
                    kinds.append(JS["}$"])
                    starts.append(s)
                    ends.append(e)
                    pos = template(e, s)
                    if pos < 0:
                        out.bad, out.open = s, "`"
                        return out
                    break
                kinds.append(ops[w])
            elif g == 1:
                kinds.append(knl)
            elif g == 3:
                kinds.append(knum)
            elif g == 4:
                kinds.append(kstr)
            elif g == 5:
                comments.append((s, e))
                if "\n" in m[5]:
                    kinds.append(knl)
                    starts.append(s)
                    ends.append(e)
                continue
            elif g == 6:
                kinds.append(kpriv)
            elif g == 7:
                pos = template(e, s)
                if pos < 0:
                    out.bad, out.open = s, "`"
                    return out
                break
            elif g == 8:
                last = next((k for k in reversed(kinds) if k != knl), "")
                out.unsure |= not last and not head
                if last not in _VALUE_END:
                    r = _JS_REGEX.match(text, s)
                    if r:
                        kinds.append(kre)
                        starts.append(s)
                        ends.append(r.end())
                        pos = r.end()
                        break
                kinds.append(ops[m[8]])
            else:
                out.bad = s
                if text.startswith("/*", s):
                    out.open = "/*"
                elif text[s] in "\"'" and text.endswith(("\\\n", "\\\r\n")) and _JS_CONTINUED.match(text, s):
                    out.open = text[s]
                return out
            starts.append(s)
            ends.append(e)
        else:
            break
    return out


_RUST = re.compile(
    r"\s*+(?:(r\#[^\W\d]\w*+|[^\W\d]\w*+(?![\"'\#])|[^\W\d]\w*+(?=\#\[)|(?!b?r?\#*\"|b'|c\")[^\W\d]\w*+)|((?:" + _DIGITS.replace(r"(?:[0-9][0-9_]*+(?:\.[0-9_]++)?|\.[0-9][0-9_]*+)", r"[0-9][0-9_]*+(?:\.[0-9][0-9_]*+|\.(?![.\w]))?") + r")(?:[iu](?:8|16|32|64|128|size)|f32|f64|_)?(?!\w))"
    r"|([bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|[bc]?r(\#*+)\"(?s:.*?)\"\4)|(b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[^\n]))')|('[^\W\d]\w*+)|(//[^\n]*+|\A\#!(?!\[)[^\n]*+)|(/\*)|(" + _ops(RUST_OPS.replace(" _", "")) + r")|(\S))"
)
_RUST_COMMENT = re.compile(r"/\*|\*/")
_RUST_OPEN = re.compile(r"[bc]?(r\#*+)?\"")


def lex_rust(text: str, state: str = "", head: bool = True) -> Tokens:
    """As ``lex_js``; states are ``"``, ``r#..`` in a raw string, and ``/*n`` at depth n of comments."""
    out = Tokens()
    kinds, starts, ends, comments = out.kinds, out.starts, out.ends, out.comments
    words, ops = RUST.keywords, RUST.operators
    kname, knum, kstr, kchar, klife, under = (RUST[x] for x in "name number string char lifetime _".split())
    if not head:
        text = " " + text
    pos, n = 1 if text[:1] == "﻿" or not head else 0, len(text)
    if state.startswith("/*"):
        depth = int(state[2:])
        for c in _RUST_COMMENT.finditer(text, pos):
            depth += 1 if c[0] == "/*" else -1
            if not depth:
                pos = c.end()
                break
        if depth:
            out.bad, out.open = 0, f"/*{depth}"
            return out
    elif state.startswith("r"):
        end = text.find('"' + state[1:], pos)
        if end < 0:
            out.bad, out.open = 0, state
            return out
        pos = end + len(state)
        kinds.append(kstr)
        starts.append(end)
        ends.append(pos)
    elif state:
        pos = _resumed(out, text, pos, state, kstr)
        if pos < 0:
            out.bad, out.open = 0, state
            return out
    while pos < n:
        for m in _RUST.finditer(text, pos):
            g = m.lastindex
            s, e = m.span(g)
            if g == 1:
                w = m[1]
                kinds.append(under if w == "_" else words.get(w, kname))
            elif g == 9:
                kinds.append(ops[m[9]])
            elif g == 2:
                kinds.append(knum)
            elif g == 3 or g == 4:
                s, e = m.span(3)
                kinds.append(kstr)
            elif g == 5:
                kinds.append(kchar)
            elif g == 6:
                kinds.append(klife)
            elif g == 7:
                comments.append((s, e))
                continue
            elif g == 8:  # block comments nest
                depth = 0
                for c in _RUST_COMMENT.finditer(text, s):
                    depth += 1 if c[0] == "/*" else -1
                    if not depth:
                        break
                if depth:
                    out.bad, out.open = s, f"/*{depth}"
                    return out
                comments.append((s, c.end()))
                pos = c.end()
                break
            else:
                out.bad = s
                m = _RUST_OPEN.match(text, s)
                if m:
                    out.open = m[1] if m[1] else '"'
                return out
            starts.append(s)
            ends.append(e)
        else:
            break
    return out


_GO = re.compile(
    r"[ \t\r\f﻿]*+(?:(\n\s*+)|(" + _ID + r")|((?:" + _DIGITS.replace(r"\.[0-9_]++", r"\.[0-9_]*+") + r")i?(?!\w))|(\"(?:[^\"\\\n]|\\[^\n])*+\"|`[^`]*+`)|('(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[^\n]))')|(//[^\n]*+|/\*(?s:.*?)\*/)|(?!/\*)(" + _ops(GO_OPS) + r")|(\S))"
)
_GO_END = {GO[w] for w in "name number string char ) ] } ++ -- return break continue fallthrough".split()}


def lex_go(text: str, state: str = "", head: bool = True) -> Tokens:
    """Go tokens with the semicolons that line ends stand for; as ``lex_js``."""
    out = Tokens()
    kinds, starts, ends, comments = out.kinds, out.starts, out.ends, out.comments
    words, ops = GO.keywords, GO.operators
    kname, knum, kstr, kchar, semi = (GO[x] for x in "name number string char ;".split())
    pos = _resumed(out, text, 0, state, kstr if state == "`" else "") if state else 0
    if pos < 0:
        out.bad, out.open = 0, state
        return out
    for m in _GO.finditer(text, pos):
        g = m.lastindex
        s, e = m.span(g)
        if g == 2:
            kinds.append(words.get(m[2], kname))
        elif g == 7:
            kinds.append(ops[m[7]])
        elif g == 1:
            if not kinds or kinds[-1] not in _GO_END:
                continue
            kinds.append(semi)
        elif g == 4:
            kinds.append(kstr)
        elif g == 3:
            kinds.append(knum)
        elif g == 5:
            kinds.append(kchar)
        elif g == 6:
            comments.append((s, e))
            if not ("\n" in m[6] and kinds and kinds[-1] in _GO_END):
                continue
            kinds.append(semi)
        else:
            out.bad = s
            out.open = "`" if text[s] == "`" else "/*" if text.startswith("/*", s) else ""
            if out.open == "/*" and "\n" in text[s:] and kinds and kinds[-1] in _GO_END:
                kinds.append(semi)
                starts.append(s)
                ends.append(s)
            return out
        starts.append(s)
        ends.append(e)
    if kinds and kinds[-1] in _GO_END:
        kinds.append(semi)
        starts.append(len(text))
        ends.append(len(text))
    return out


JSON = Alphabet("name number string literal", "", "{ } ( ) [ ] , :")
_JSON = re.compile(r"[ \t\r\n]*+(?:(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*+\")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([\[\]{},:])|([^ \t\r\n]))")


def lex_json(text: str, state: str = "", head: bool = True) -> Tokens:
    """Tokens of JSON; none goes over a line end."""
    out = Tokens()
    letters = {1: JSON["string"], 2: JSON["number"], 3: JSON["literal"]}
    for m in _JSON.finditer(text):
        g = m.lastindex
        if g == 5:
            out.bad = m.start(5)
            return out
        out.kinds.append(JSON.operators[m[4]] if g == 4 else letters[g])
        out.starts.append(m.start(g))
        out.ends.append(m.end(g))
    return out


# The keywords and operators of Python that definitions are made of.
PYTHON = Alphabet("name number string bytes newline", "def async class lambda", "{ } ( ) [ ] : , . ; -> = @ * / + - other")
_PYTHON = re.compile(
    r"(?:[ \t\f﻿]|\\\r?\n)*+(?:(\r?\n|\r)|(\#[^\n\r]*+)|([rRuUbBfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'))|([^\W\d]\w*+)|(\d[\w.]*+)|(->|[\[\]{}():,.;=@*/+-])|(\S))"
)


def lex_python(text: str) -> Tokens:
    """Tokens of Python; line ends inside brackets are dropped, indentation is not needed here."""
    out = Tokens()
    kinds, starts, ends, comments = out.kinds, out.starts, out.ends, out.comments
    words, ops = PYTHON.keywords, PYTHON.operators
    kname, knum, kstr, kbytes, knl, other = (PYTHON[x] for x in "name number string bytes newline other".split())
    depth = 0
    for m in _PYTHON.finditer(text):
        g = m.lastindex
        if g == 4:
            kinds.append(words.get(m[4], kname))
        elif g == 6:
            w = m[6]
            if w in "([{":
                depth += 1
            elif w in ")]}":
                depth -= 1
            kinds.append(ops[w])
        elif g == 1:
            if depth > 0:
                continue
            kinds.append(knl)
        elif g == 2:
            comments.append(m.span(2))
            continue
        elif g == 3:
            # byte strings and formatted strings document nothing
            kinds.append(kbytes if set(m[3][: min(m[3].find(q) for q in "'\"" if q in m[3])].lower()) & set("bft") else kstr)
        else:
            kinds.append(knum if g == 5 else other)
        starts.append(m.start(g))
        ends.append(m.end(g))
    return out
