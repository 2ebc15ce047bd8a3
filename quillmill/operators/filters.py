"""Row predicates: globs, inclusion, hygiene, binary content, lens patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never scanned.
HYGIENE = [".git", ".hg", ".svn", "node_modules", ".npm", ".yarn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".eggs", "target", "dist", "build", "out", "_build", ".build", ".idea", ".vscode", ".DS_Store", "Thumbs.db"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def glob_regex(pattern: str, cross: bool = True) -> str | None:
    """A glob as an anchored regular expression; a star crosses directories, as ``**`` does.

    Without ``cross`` it is the expression of what the glob matches inside one path component,
    or None where it cannot match one.
    """
    any_, one = (".*", ".") if cross else ("[^/]*", "[^/]")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and i == 0:
            out, i = out + ("(?:.*/)?" if cross else ""), i + 3
        elif pattern.startswith("/**/", i):
            out, i = out + "(?:/|/.*/)", i + 4
        elif c == "*":
            out, i = out + any_, i + (2 if pattern.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + one, i + 1
        elif c in "[{" and (end := pattern.find("]" if c == "[" else "}", i + 1)) > 0:
            inside = pattern[i + 1 : end]
            out += f"[{'^' if inside[:1] in '!^' else ''}{re.escape(inside.lstrip('!^')).replace(chr(92) + '-', '-')}]" if c == "[" else "(?:" + "|".join(glob_regex(x, cross)[1:-1] for x in inside.split(",")) + ")"
            i = end + 1
        else:
            out, i = out + re.escape(c), i + 1
    if not cross and "/" in out.replace("[^/]", ""):
        return None
    return f"^{out}$"


def glob(path: Column, pattern: str) -> Column:
    """The pattern hits the whole path, a leading part of it, or one component."""
    hit = F.rlike(path, F.lit(glob_regex(pattern)[:-1] + "(?:/|$)"))
    part = glob_regex(pattern, cross=False)
    return hit if part is None else hit | F.rlike(path, F.lit("(?:^|/)" + part[1:-1] + "(?:/|$)"))


def whitelisted(path: Column, include: list[str]) -> Column:
    """The strict rule: with patterns, a path must match one, whatever else is ignored."""
    return _any([glob(path, p) for p in include]) if include else F.lit(True)


def included(path: Column, ignore: list[str], include: list[str]) -> Column:
    """Ignore wins; include is a whitelist only while nothing is ignored."""
    keep = ~_any([glob(path, p) for p in ignore])
    return keep & _any([glob(path, p) for p in include]) if include and not ignore else keep


def hygienic(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda c: c.isin(HYGIENE) | c.endswith(".egg-info") | c.endswith(".swp") | c.endswith(".swo") | c.endswith(".pyc"))


# Extensions of source files, and parts of the paths of tests.
SOURCES = "rs py js ts tsx jsx go java c cpp h hpp rb php swift kt scala cs fs vb lua pl pm".split()
TESTS = ["test", "spec"]
# For each intent the parts of names and the concepts that are noise, and the least relevance.
NOISE: dict[str, tuple[list[str], list[str], float]] = {
    "business_logic": (["test_", "_test", "log_", "debug_", "mock_"], ["testing", "logging", "configuration"], 0.2),
    "debugging": (["test_", "_test"], ["testing"], 0.1),
    "onboarding": (["mock_", "_mock", "stub_", "fake_", "internal_", "__"], ["testing", "logging"], 0.25),
    "security_review": (["test_", "_test", "mock_"], ["testing"], 0.1),
    "migration": (["test_"], ["testing"], 0.2),
}


def is_source(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(SOURCES)


def is_test(path: Column) -> Column:
    return _any([F.contains(F.lower(path), F.lit(t)) for t in TESTS])


def explorable(path: Column, depth: int = 10, tests: bool = False) -> Column:
    """What an exploration reads: source files down to a depth, tests on demand."""
    near = F.size(F.split(path, "/")) <= depth
    return is_source(path) & near & hygienic(path) & (F.lit(tests) | ~is_test(path))


def quiet(name: Column, concept: Column, intent: str) -> Column:
    """No noise for the intent: neither its name nor its concept is filtered."""
    names, concepts, _ = NOISE[intent]
    return ~_any([F.contains(F.lower(name), F.lit(n)) for n in names]) & ~concept.isin(concepts)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8,192 characters."""
    return F.contains(F.substring(content, 1, 8192), F.lit("\0"))


def _simple(text: Column, pattern: str) -> Column:
    stars = pattern.count("*")
    if stars == 0:
        return text == pattern
    if pattern.startswith("*."):  # an ending as it stands, further stars included
        return F.endswith(text, F.lit(pattern[1:]))
    if pattern.startswith("*") and pattern.endswith("*") and stars == 2:
        return F.contains(text, F.lit(pattern[1:-1]))
    if stars == 1:
        head, tail = pattern.split("*")
        return F.startswith(text, F.lit(head)) & F.endswith(text, F.lit(tail))
    return text == pattern


def lens_glob(path: Column, pattern: str) -> Column:
    """The lens grammar: ``**/d/**``, ``p/**``, ``**/s``, ``p/**/s``, else a simple match."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    if pattern.startswith("**/") and pattern.endswith("/**"):
        d = pattern[3:-3]
        return F.contains(path, F.lit(f"/{d}/")) | F.startswith(path, F.lit(f"{d}/"))
    if pattern.endswith("/**"):
        return F.startswith(path, F.lit(pattern[:-2])) | (path == pattern[:-3])
    if pattern.startswith("**/"):
        return _simple(name, pattern[3:])
    if "/**/" in pattern:
        head, tail = pattern.split("/**/", 1)
        return F.startswith(path, F.lit(head + "/")) & _simple(name, tail)
    return _simple(path, pattern) | (_simple(name, pattern) if not pattern.startswith("*") else F.lit(False))
