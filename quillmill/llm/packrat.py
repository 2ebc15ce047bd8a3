"""Packrat parsing expression grammars over token sequences.

A grammar is text: one rule a line, ``name <- expression``, with quoted tokens, rule
names, sequence, ordered choice ``/``, ``? * +``, ``& !`` and parentheses. Two rules are
built in: ``group`` is a balanced bracket group, taken whole, and ``any`` is any token.
Every rule is tried at most once at a position. A parse returns the end of the match and
where each rule in it began, so that semantic actions have the tokens' source offsets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from .lexing import Alphabet

_TOKEN = re.compile(r"\s*(?:'([^']+)'|([a-z_]+)|([()/?*+&!]))")


class Peg:
    def __init__(self, alphabet: Alphabet, text: str):
        self.alphabet = alphabet
        self.rules: dict[str, tuple] = {}
        for line in text.strip().splitlines():
            name, _, body = line.partition("<-")
            parts = _TOKEN.findall(body)
            node, rest = self._choice(parts, 0)
            assert rest == len(parts), line
            self.rules[name.strip()] = node
        self.brackets = {alphabet[a]: alphabet[b] for a, b in ("()", "[]", "{}")}

    def _choice(self, parts, i):
        options = []
        while True:
            items = []
            while i < len(parts) and parts[i][2] not in (")", "/"):
                node, i = self._item(parts, i)
                items.append(node)
            options.append(("seq", items))
            if i < len(parts) and parts[i][2] == "/":
                i += 1
                continue
            return (options[0] if len(options) == 1 else ("alt", options)), i

    def _item(self, parts, i):
        literal, name, sign = parts[i]
        if sign in ("&", "!"):
            node, i = self._item(parts, i + 1)
            return (sign, node), i
        if sign == "(":
            node, i = self._choice(parts, i + 1)
            i += 1
        else:
            node, i = ("tok", self.alphabet[literal]) if literal else ("rule", name), i + 1
        while i < len(parts) and parts[i][2] in ("?", "*", "+"):
            node, i = (parts[i][2], node), i + 1
        return node, i

    def jumps(self, kinds: Sequence[str]) -> dict[int, int]:
        """Index behind the closing bracket of every opening bracket that has one."""
        out, stack = {}, []
        closing = {b: a for a, b in self.brackets.items()}
        for i, k in enumerate(kinds):
            if k in self.brackets:
                stack.append(i)
            elif k in closing:
                if stack and kinds[stack[-1]] == closing[k]:
                    out[stack.pop()] = i + 1
                else:
                    stack.clear()
        return out

    def parser(self, kinds: Sequence[str]) -> Parse:
        return Parse(self, kinds)


class Parse:
    def __init__(self, peg: Peg, kinds: Sequence[str]):
        self.rules, self.kinds, self.jump = peg.rules, kinds, peg.jumps(kinds)
        self.memo: dict[tuple[str, int], tuple[int, tuple] | None] = {}

    def match(self, rule: str, at: int) -> tuple[int, dict[str, int]] | None:
        """(end, first begin of each rule within) of ``rule`` at a position, or None."""
        found = self._rule(rule, at)
        if found is None:
            return None
        begins: dict[str, int] = {}
        stack = list(reversed(found[1]))
        while stack:
            name, begin, inner = stack.pop()
            begins.setdefault(name, begin)
            stack.extend(reversed(inner))
        return found[0], begins

    def _rule(self, name: str, at: int):
        key = (name, at)
        if key not in self.memo:
            if name == "group":
                end = self.jump.get(at)
                self.memo[key] = None if end is None else (end, ())
            elif name == "any":
                self.memo[key] = (at + 1, ()) if at < len(self.kinds) else None
            else:
                self.memo[key] = self._eval(self.rules[name], at)
        return self.memo[key]

    def _eval(self, node, at: int):
        kind, arg = node
        if kind == "tok":
            return (at + 1, ()) if at < len(self.kinds) and self.kinds[at] == arg else None
        if kind == "rule":
            found = self._rule(arg, at)
            return None if found is None else (found[0], ((arg, at, found[1]),))
        if kind == "seq":
            marks: tuple = ()
            for x in arg:
                found = self._eval(x, at)
                if found is None:
                    return None
                at, marks = found[0], marks + found[1]
            return at, marks
        if kind == "alt":
            for x in arg:
                found = self._eval(x, at)
                if found is not None:
                    return found
            return None
        if kind == "?":
            return self._eval(arg, at) or (at, ())
        if kind in "*+":
            marks, n = (), 0
            while (found := self._eval(arg, at)) is not None and found[0] > at:
                at, marks, n = found[0], marks + found[1], n + 1
            return (at, marks) if n or kind == "*" else None
        found = self._eval(arg, at)
        return (at, ()) if (found is None) == (kind == "!") else None
