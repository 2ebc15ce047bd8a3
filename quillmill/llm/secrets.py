"""Credentials embedded in source code and configuration, found and redacted.

Method: an Aho-Corasick automaton of keywords selects the lines worth a look; issuer
formats, connection strings, URLs, authorization headers, key blocks and assignments to
sensitive names are matched there by regular expressions; structure is validated (a web
token must decode, a basic credential must hold a password, a key block needs a body) and
placeholders, references, samples and names are ruled out. String literals in pieces are
joined before they meet the automaton. A second automaton holds what base64 and
hexadecimal make of the keywords; a literal on a line that either selects is decoded and
searched like a file, ``NESTING`` decodings deep (one encoded twice is so found where its
line holds a keyword). A match is replaced by a placeholder of the same length
and alphabet, so quoting, escapes, layout and length of the file stay as they are.

Checksums of issuers that have one are computed (``checksum``, ``issuers``), but a token
that fails it is reported all the same: it may be damaged by an edit and is then as
telling, and self-made servers issue tokens of the format without one.

Defined results: null or empty content holds nothing and stays as it is; repeated files
are searched each; a line holds a credential once; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# What makes a line worth a look, in lower case.
KEYWORDS = """pass pwd secret token key auth cred bearer basic signature sig= kennwort passwort geheim schlüssel schluessel motdepasse mot_de_passe clave contrase senha chave parola wachtwoord
 :// -----begin akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxr- xoxs- sk_live_ sk_test_ rk_live_ rk_test_ npm_ pypi- sg. aiza eyj whsec_ shpat_ dop_v1_ hf_ sk-""".split()
# Formats of issuers.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}"
    r"|pypi-[A-Za-z0-9_-]{40,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{35}|whsec_[A-Za-z0-9+/=]{24,}|shpat_[a-f0-9]{32}|dop_v1_[a-f0-9]{64}|hf_[A-Za-z0-9]{30,}|sk-(?:proj-)?[A-Za-z0-9_-]{32,})(?![A-Za-z0-9])"
)
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})")
URL_USER = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/?#\"'`<>@]*):([^\s\"'`@/]+|[^\s\"'`@]+(?=@[\w.-]+[:/\"'`\s]))@[\w.\[-]")
URL_QUERY = re.compile(r"[?&;](?:[\w.-]*(?:token|api_?key|apikey|secret|signature|passw(?:or)?d|pwd|credential)|sig|key|auth|code|x-amz-signature|x-goog-signature)=([^\s&\"'`<>#]+)", re.I)
CONNECTION = re.compile(r"(?:\b|_)(?:password|pwd|accountkey|sharedaccesskey|sharedsecret)\s*=\s*([^;\"'`\s]+);?", re.I)
HEADER = re.compile(r"\b(basic|bearer|token)\s+([A-Za-z0-9+/_.~=-]{8,})", re.I)
USER_PASS = re.compile(r"(?:\bcurl\b.*?\s(?:-u|--user)[ =]?['\"]?)([^\s:'\"]+):([^\s'\"]+)")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_WORDS = "passwords?|passwd|pwd|passphrase|passcode|pass|secrets?|secret_?key|api_?key|access_?key|private_?key|signing_?key|encryption_?key|deploy_?key|master_?key|service_?key|account_?key|auth_?key|ssh_?key|storage_?key|session_?key|hmac_?key|license_?key|token|credentials?|kennwort|passwort|geheimnis|schl(?:ü|ue)ssel|mot_?de_?passe|clave|contrase(?:ñ|n)a|senha|chave|parola|wachtwoord"
NAME = re.compile(
    rf"(?i)(?<![A-Za-z0-9])([\w.-]*?(?:{_WORDS})(?:_?(?:\d+|_[a-z]|b64|base64|hex|enc|encoded|value|old|new|prod|dev|live))?)(?![A-Za-z0-9_-])[\"'`\])]*"
    r"\s*(?::\s*&(?:'\w+\s+)?(?:str|String)\s*=|:\s*[Ss]tr(?:ing)?\s*=|:=|=>|==?|:|,|\bis\b|\s)\s*(?:(?:[\w.:!]+)?\(\s*)?(?:[bru]{0,2}(?=[\"'`])|&)?"
    r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s\"'`,;(){}\[\]<>]+))"
)
# Values that stand for a credential without being one.
PLACEHOLDER = re.compile(
    r"(?i)^(?:change_?me|change_?it|dummy|todo|tbd|none|null|nil|undefined|true|false|test|testing|fake|mock|sample|example|foo|bar|foobar|placeholder|redacted|hidden|masked|removed|secret|password|passw0rd|passwd|pass|token|my_?secret|my_?password|replace_?me|insert.*|your.*|enter.*|xxx+.*|\*+|\.{2,}|-+|_+|x+|0+|1234\d*|abc123|n/?a|unset|empty|unknown)[!.]*$"
    r"|example|placeholder|replace[_-]?(?:me|this|with)|change[_-]?me|your[_-]|[_-]here$|redacted|not[_-]?a[_-]?(?:real|secret)|(?<![a-z])(?:dummy|fake|sample)(?![a-z])|<[^>]*>|\.\.\.|x{4,}|\*{3,}"
)
REFERENCE = re.compile(r"\$\{|\{\{|\$\(|%\(|^\$[A-Za-z_]|^%[A-Z_]+%$|^@|^(?:vault|env|file|ssm|kms|arn|secretsmanager|op|ref|aws|gcp|sops|keyring|config):|^(?:os\.|process\.|env\.|std::env|System\.|config\.|settings\.|secrets\.|getenv|viper\.|self\.|this\.)|^!(?:Ref|Sub|GetAtt|Join|secret|vault|env)|getenv|environ|^/(?:run|etc|var|mnt)/|^\{.*\}$")
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{2,}|[_\W])+")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_ENCODED = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{24,}={0,2}|[A-Za-z0-9_-]{24,})(?![A-Za-z0-9+/=_-])")
_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_CHAIN = re.compile(rf"[bru]?(?:{_LITERAL})(?:[ \t]*(?:\+|\.\.?|\\)?[ \t]*\r?\n[ \t]*(?:\+[ \t]*|//[^\n]*\n[ \t]*)?[bru]?(?:{_LITERAL}))+|(?:{_LITERAL})(?:[ \t]*\+[ \t]*(?:{_LITERAL}))+")
_CONCAT = re.compile(rf"(?<=concat!\()\s*(?:{_LITERAL})(?:\s*,\s*(?:{_LITERAL}))+")
_ONE = re.compile(_LITERAL)
# read backwards from where a literal begins, so that nothing is looked at twice
_BEFORE = regex.compile(r"(?ri)([\w.-]+)[\"'`\]]?\s*(?::\s*&(?:'\w+\s+)?(?:str|String)\s*=|:=|=>|=|:)\s*(?:\(|concat!\s*\(|\[|\\)?\s*(?:(?://|\#)[^\n]*\n\s*)?")
_KEY_BODY = re.compile(r"(?:[A-Za-z0-9+/=]{20,}|\\[nr]|[\s\"'`+,;\#*\\]|(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*|[A-Za-z0-9+/=]{1,19}(?=[\"'`\s\\]*(?:\n|\Z)))*+")
_PASSPHRASE = re.compile(r"(?i)pass_?phrase")
# Words that tell a sentence from a phrase of random words.
_PROSE = set("the a an is are of for to in on with your you enter this that must be not or and please".split())
#: How many encodings inside one another are undone.
NESTING = 3
_SENSITIVE = re.compile(rf"(?i)(?:{_WORDS})(?:_?\d{{1,2}}|_[a-z])?$")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


@cache
def _encoded_automaton():
    """What base64 (at the three places a word can have in it) and hexadecimal make of the keywords."""
    import ahocorasick

    forms = set()
    for w in [*KEYWORDS, "AIza", "eyJ", "SG."]:
        for v in {w, w.upper(), w.title()}:
            raw = v.encode()
            if len(raw) >= 3:
                forms |= {raw.hex(), raw.hex().upper()}
            for lead in range(3):
                form = base64.b64encode(b"\0" * lead + raw).decode()[-(-lead * 8 // 6) : (lead + len(raw)) * 8 // 6]
                if len(form) >= 3:
                    forms |= {form, form.replace("+", "-").replace("/", "_")}
    a = ahocorasick.Automaton()
    for f in forms:
        a.add_word(f, len(f))
    a.make_automaton()
    return a


def _hit(text: str) -> bool:
    """Does an automaton find a keyword, plain or encoded."""
    return any(True for _ in _automaton().iter(_lowered(text))) or any(True for _ in _encoded_automaton().iter(text))


def _lowered(text: str) -> str:
    lower = text.lower()
    # some capitals lower to two characters
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def usable(value: str, name: str = "", least: int = 8) -> bool:
    """Could somebody log in with this value: no placeholder, reference, name, word, number or prose."""
    v = value.strip()
    if len(v) < least or any(c.isspace() for c in v) or PLACEHOLDER.search(v) or REFERENCE.search(v):
        return False
    if UUID.match(v) or len(set(v)) < 5 or len({c for c in v.lower() if c.isalnum()}) < 4:
        return False
    plain = re.sub(r"[\W_]", "", v).lower()
    if not plain or plain == re.sub(r"[\W_]", "", name).lower() or _SENSITIVE.fullmatch(v):
        return False
    letters, digits = any(c.isalpha() for c in v), any(c.isdigit() for c in v)
    if digits and letters:
        # a call, an attribute or a path with a number is code, not a value
        return not re.fullmatch(r"[\w.]+\.[a-z_]\w*", v) or entropy(v) > 3.6
    if digits:
        return False
    if least < 8:  # a place that holds passwords only
        return not v.islower()
    # letters only: random strings change case where no word of an identifier begins
    random_case = len(v) >= 10 and min(sum(c.isupper() for c in v), sum(c.islower() for c in v)) >= 3 and entropy(v) >= 2.8 and not _IDENTIFIER.fullmatch(v)
    return random_case or bool(re.search(r"[!?#$%&*+=~^]", v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and "(" not in v)


def _json_part(part: str):
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error):
        return None


def _decoded(v: str) -> str | None:
    """Readable text behind a base64 or hexadecimal literal."""
    for decode in (lambda x: bytes.fromhex(x), lambda x: base64.b64decode(x + "=" * (-len(x) % 4), altchars=b"-_" if set(x) & set("-_") else None, validate=True)):
        try:
            raw = decode(v)
        except (ValueError, binascii.Error):
            continue
        if len(raw) >= 8 and not raw.translate(None, _PRINTABLE):
            return raw.decode("ascii")
    return None


_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])


def _in_text(line: str, depth: int = NESTING) -> Iterator[tuple[int, int]]:
    """Spans of credentials in a line (or in a joined or decoded literal)."""
    for m in ISSUERS.finditer(line):
        if not PLACEHOLDER.search(m[0]) and entropy(m[0]) > 2.8:
            yield m.span()
    if "eyJ" in line:
        for m in WEB_TOKEN.finditer(line):
            head = _json_part(m[1])
            if isinstance(head, dict) and "alg" in head and isinstance(_json_part(m[2]), dict):
                yield m.span()
    if "://" in line:
        for m in URL_USER.finditer(line):
            if usable(m[2], "password", 6):
                yield m.span(2)
    if "=" in line:
        for m in URL_QUERY.finditer(line):
            if "://" in line[: m.start()] and usable(m[1], "token", 12):
                yield m.span(1)
        for m in CONNECTION.finditer(line):
            if ";" in line and usable(m[1], "password", 6):
                yield m.span(1)
    for m in HEADER.finditer(line):
        kind, v = m[1].lower(), m[2]
        if kind == "basic":
            plain = _decoded(v)
            if plain and ":" in plain and usable(plain.partition(":")[2], "password", 6):
                yield m.span(2)
        elif len(v) >= 16 and usable(v, "token", 16) and entropy(v) > 3:
            yield m.span(2)
    for m in USER_PASS.finditer(line):
        if usable(m[2], "password", 6):
            yield m.span(2)
    for m in NAME.finditer(line):
        g = next((i for i in (2, 3, 4, 5) if m[i] is not None), 0)
        if g and _assigned(m[1], m[g]):
            yield m.span(g)
    if depth:
        for m in _ENCODED.finditer(line):
            plain = _decoded(m[0])
            if plain and _hit(plain) and credentials(plain, depth - 1):
                yield m.span()


def _assigned(name: str, value: str) -> bool:
    """Is a value assigned to a sensitive name a credential, as it stands or decoded."""
    if usable(value, name):
        return True
    if " " in value and _PASSPHRASE.search(name):
        words = value.split(" ")
        return len(words) >= 4 and all(w.isalnum() for w in words) and not _PROSE & set(value.lower().split()) and not PLACEHOLDER.search(value)
    plain = _decoded(value) if len(value) >= 12 else None
    return bool(plain) and usable(plain, name)


def _blocks(text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int] | None]]:
    """Key blocks: what they cover, and the span of the key where it is one."""
    for m in KEY_BLOCK.finditer(text):
        stop = text.find("-----", m.end())
        if stop < 0:  # cut off before its end
            stop = _KEY_BODY.match(text, m.end()).end()
        core = re.sub(r"\\n|\\r|[\s\"'`+,#/*]|(?:Proc-Type|DEK-Info):[^\n]*", "", text[m.end() : stop])
        real = len(re.findall(r"[A-Za-z0-9+/=]", core)) >= 64 and not PLACEHOLDER.search(core[:64]) and entropy(core) > 4
        yield (m.start(), stop), (m.end(), stop) if real else None


def _chains(text: str) -> Iterator[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Literals in pieces that make up a credential: what they cover, and the pieces, the first with a value before all."""
    for m in (*_CHAIN.finditer(text), *(_CONCAT.finditer(text) if "concat!" in text else ())):
        pieces = list(_ONE.finditer(text, m.start(), m.end()))
        before = _BEFORE.match(text, 0, m.start())
        if not before:
            continue
        joined = "".join(p[0][1:-1] for p in pieces)
        if not _hit(f"{before[1]}={joined}"):
            continue
        if (_SENSITIVE.search(before[1]) and _assigned(before[1], joined)) or any(True for _ in _in_text(joined)):
            # a leading empty literal only opens the chain
            begin = next((p for p in pieces if len(p[0]) > 2), pieces[0])
            yield m.span(), [begin.span(), *(p.span() for p in pieces if p is not begin)]


def credentials(text: str, depth: int = NESTING) -> list[tuple[int, int, int]]:
    """(line, start, end) of every credential; a credential in pieces counts where it begins.

    The line is given once, with the first credential on it; further spans have line 0.
    """
    lines = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect_right(lines, at - 1) if at else 0
    bounds = lambda n: (lines[n - 1] + 1 if n else 0, lines[n] if n < len(lines) else len(text))
    wanted: set[int] = set()
    for hits in (_automaton().iter(_lowered(text)), _encoded_automaton().iter(text) if depth else ()):
        end_of_line = -1
        for end, _ in hits:
            if end > end_of_line:
                n = line_of(end)
                end_of_line = bounds(n)[1]
                wanted.add(n)
    first: list[tuple[int, int]] = []  # where a credential begins
    more: list[tuple[int, int]] = []  # further pieces
    covered: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for span, key in _blocks(text):
            covered.append(span)
            if key:
                first.append(key)
    block_lines = {n for s, e in covered for n in range(line_of(s), line_of(e) + 1)}
    for span, pieces in _chains(text):
        if line_of(span[0]) not in block_lines:
            covered.append(span)
            first.append(pieces[0])
            more += pieces[1:]
    covered.sort()
    starts, reach, most = [s for s, _ in covered], [], 0
    for _, e in covered:
        most = max(most, e)
        reach.append(most)
    # a span is free unless a block or chain reaches into it
    free = lambda a, b: not (k := bisect_right(starts, b - 1)) or reach[k - 1] <= a
    for n in sorted(wanted):
        s, e = bounds(n)
        first += [(s + a, s + b) for a, b in _in_text(text[s:e], depth) if not covered or free(s + a, s + b)]
    out, seen = [], set()
    # of a key block the line of its head counts
    head = {(m.end()): m.start() for m in KEY_BLOCK.finditer(text)} if "-----BEGIN" in text else {}
    for a, b in sorted(set(first)):
        n = line_of(head.get(a, a))
        out.append((0 if n in seen else n + 1, a, b))
        seen.add(n)
    return out + [(0, a, b) for a, b in more]


# Digits of the base that issuers write checksums in.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(token: str) -> bool | None:
    """Does a token's own checksum hold (its last six characters, a CRC of the rest); None where its issuer has none."""
    if not re.fullmatch(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}", token):
        return None
    n, out = zlib.crc32(token[4:-6].encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return token[-6:] == out.rjust(6, "0")


_ESCAPE = re.compile(r"(\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}|\\.)")


def placeholder(value: str) -> str:
    """A value of the same length and alphabet: hexadecimal stays hexadecimal, base32 stays base32.

    Punctuation is kept, escapes stay escapes of the same length.
    """
    plain = _ESCAPE.sub("", value)
    letters, digits = {c for c in plain if c.isalpha()}, {c for c in plain if c.isdigit()}
    if letters <= set("abcdefABCDEF") and (digits or len(plain) >= 16):
        lower, upper, digit = "a", "A", "0"
    elif not any(c.islower() for c in letters) and digits <= set("234567"):
        lower, upper, digit = "a", "A", "2"
    else:
        lower, upper, digit = "x", "X", "0"

    def mask(piece: str) -> str:
        return "".join(digit if c.isdigit() else (upper if c.isupper() else lower) if c.isalpha() else c for c in piece)

    def escape(piece: str) -> str:
        if piece[0] == "%" or piece[1] in "ux" and len(piece) > 2:
            # the code of x, in as many digits
            return re.sub(r"[0-9a-fA-F]{2,}", lambda m: "78".rjust(len(m[0]), "0"), piece) if len(re.sub(r"[^0-9a-fA-F]", "", piece)) > 1 else piece
        return piece

    return "".join(escape(p) if i % 2 else mask(p) for i, p in enumerate(_ESCAPE.split(value)))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its placeholder."""
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        a = max(a, at)
        if a < b:
            out += [text[at:a], placeholder(text[a:b])]
            at = b
    return "".join([*out, text[at:]])


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(key, n) for key, text in zip(pdf["key"], pdf["content"]) for n, _, _ in credentials(text) if n]
        yield pd.DataFrame(rows, columns=["key", "line_no"]).astype({"line_no": "int32"})


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [credentials(t) if t else [] for t in pdf["content"]]
        yield pd.DataFrame({"key": pdf["key"], "content": [redact(t, f) if f else t for t, f in zip(pdf["content"], found)], "credentials": pd.Series([sum(1 for x in f if x[0]) for f in found], dtype="int32")})


def find_credentials(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """``file_id, line_no``: lines on which a usable credential begins."""
    base = files.select(F.col(id_col).alias("key"), F.col(content_col).alias("content")).where("content is not null")
    kind = base.schema["key"].dataType.simpleString()
    return spread(base).mapInPandas(_search, f"key {kind}, line_no int").withColumnRenamed("key", "file_id")


def redacted(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """``file_id, content, credentials``: every file with its credentials masked and their number."""
    base = files.select(F.col(id_col).alias("key"), F.col(content_col).alias("content"))
    kind = base.schema["key"].dataType.simpleString()
    return spread(base).mapInPandas(_clean, f"key {kind}, content string, credentials int").withColumnRenamed("key", "file_id")


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(re.match(r"[A-Za-z]+", m[0])[0], checksum(m[0])) for text in pdf["content"] for m in ISSUERS.finditer(text)]
        yield pd.DataFrame({"issuer": [i for i, _ in rows], "checksum": ["none" if c is None else "holds" if c else "fails" for _, c in rows]})


def issuers(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``issuer, checksum, tokens``: tokens in issuers' formats by whether their own checksum holds."""
    base = files.select(F.col(content_col).alias("content")).where("content is not null")
    return spread(base).mapInPandas(_tokens, "issuer string, checksum string").groupBy("issuer", "checksum").agg(F.count("*").alias("tokens"))
