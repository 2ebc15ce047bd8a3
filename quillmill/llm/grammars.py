"""Local grammars: bracket groups are parsed bottom-up, each as a flat regular language.

A file is one pass over its tokens. When a bracket closes, the class letters inside it
(in which inner groups are already single letters) are matched against the flat grammars
of all roles such a group can play, for instance argument list, parameter list, block or
object. The group becomes one letter that stands for its set of roles. Contents repeat
heavily once names and literals are masked, so each worker remembers the role sets it has
seen (a bounded memory that only saves time).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import regex

from .lexing import GO, JS, JS_WORDS, JSON, RUST, Alphabet, Tokens, lex_go, lex_js, lex_json, lex_rust

_PIECE = re.compile(r"'([^']+)'|<([\w ]+)>|\s+")
MEMORY = 1 << 17


class Grammar:
    """Roles of bracket groups, and rules over class letters.

    In a rule ``'x'`` is the token x, ``<x>`` the rule, token kind or role x; white space
    does not count and the rest is regular expression syntax.
    """

    BASE = {"(": 0xE000, "{": 0xE400, "[": 0xE800}
    CLOSER = {")": "(", "}": "{", "]": "["}

    def __init__(self, alphabet: Alphabet, lex, roles: dict[str, str], line: str = ""):
        self.alphabet, self.lex, self.line = alphabet, lex, line
        self.rules: dict[str, str] = {k: v for k, v in alphabet.letter.items() if re.fullmatch(r"[a-z]+", k)}
        self.roles = {b: names.split() for b, names in roles.items()}
        self.opens = {alphabet[b]: b for b in self.BASE}
        self.closes = {alphabet[c]: b for c, b in self.CLOSER.items()}
        for b, names in self.roles.items():
            for bit, role in enumerate(names):
                self.rules[role] = "[" + "".join(chr(self.BASE[b] + mask) for mask in range(1 << len(names)) if mask >> bit & 1) + "]"
            self.rules[{"(": "anyparen", "{": "anybrace", "[": "anybracket"}[b]] = f"[{chr(self.BASE[b])}-{chr(self.BASE[b] + (1 << len(names)) - 1)}]"
        self.tests: dict[str, list] = {}
        self.known: dict[tuple[str, str], str] = {}

    def text(self, rule: str) -> str:
        def piece(m: re.Match) -> str:
            if m[1] is not None:
                return self.alphabet[m[1]]
            if m[2] is None:
                return ""
            r = self.rules[m[2]]
            # letters and classes of letters are spelled out, other rules are called
            return r if len(r) == 1 or re.fullmatch(r"\[[^\[\]]*\]", r) else f"(?&{m[2]})"

        return _PIECE.sub(piece, rule)

    def compiled(self, rule: str) -> regex.Pattern:
        body = self.text(rule)
        needed: dict[str, str] = {}
        todo = re.findall(r"\(\?&(\w+)\)", body)
        while todo:
            name = todo.pop()
            if name not in needed:
                needed[name] = self.rules[name]
                todo += re.findall(r"\(\?&(\w+)\)", self.rules[name])
        return regex.compile("".join(f"(?(DEFINE)(?P<{k}>{v}))" for k, v in needed.items()) + f"(?:{body})", regex.V0)

    def rule(self, name: str, body: str) -> None:
        self.rules[name] = self.text(body)

    def role(self, bracket: str, name: str, body: str, flat: bool = True) -> None:
        self.tests.setdefault(bracket, []).append((self.roles[bracket].index(name), self.compiled(body).fullmatch, flat))

    def series(self, cut: str, mid: str, last: str):
        """A test of a series of elements: each is matched by itself, so what is remembered stays small.

        ``cut`` is a piece up to where an element may end; an element is one piece or more.
        The shortest element is tried first, and longer ones where what follows fails; an
        element grows as long as it is the beginning of a match.
        """
        pieces, one, end = re.compile(self.text(cut)), self.compiled(mid).fullmatch, self.compiled(last).fullmatch
        known: dict[tuple[bool, str], tuple[bool, bool]] = {}

        def judge(key: tuple[bool, str]) -> tuple[bool, bool]:
            """Whether it is an element, and whether it may become one with more pieces."""
            if key[0]:
                return bool(end(key[1])), False
            m = one(key[1], partial=True)
            return bool(m) and not m.partial, bool(m or end(key[1], partial=True))

        def test(content: str) -> bool:
            parts = pieces.findall(content)
            n = len(parts)
            if not n:
                return True
            seen, ways = {0}, [(0, "")]  # places tried, elements begun
            while ways:
                j, element = ways.pop()
                while j < n:
                    element += parts[j]
                    j += 1
                    key = (j == n, element)
                    verdict = known.get(key)
                    if verdict is None:
                        if len(known) > MEMORY:
                            known.clear()
                        verdict = known[key] = judge(key)
                    ok, more = verdict
                    if ok and j == n:
                        return True
                    if ok and j not in seen:
                        seen.add(j)
                        ways += [(j, element), (j, "")]
                        break
                    if not more:
                        break
            return False

        return test

    def serial(self, bracket: str, name: str, cut: str, mid: str, last: str, flat: bool = True) -> None:
        self.tests.setdefault(bracket, []).append((self.roles[bracket].index(name), self.series(cut, mid, last), flat))

    def prepare(self, content: str, flat: bool) -> str:
        return content

    def group(self, bracket: str, content: str) -> str:
        key = (bracket, content)
        if key not in self.known:
            if len(self.known) > MEMORY:
                self.known.clear()
            mask, ready = 0, {f: self.prepare(content, f) for f in {t[2] for t in self.tests[bracket]}}
            for bit, test, flat in self.tests[bracket]:
                if test(ready[flat]):
                    mask |= 1 << bit
            self.known[key] = chr(self.BASE[bracket] + mask)
        return self.known[key]

    def reduce(self, letters: Iterable[str]) -> tuple[str, str]:
        """``(verdict, letters)``: every closed group as one letter, brackets without partner as they are.

        The verdict is "!" where brackets do not match and "?" where letters of two chunks
        contradict each other. Reducing joined reductions equals reducing all at once.
        """
        stack: list[tuple[str, list[str]]] = []
        now: list[str] = []
        opens, closes = self.opens, self.closes
        for k in letters:
            if k in opens:
                stack.append((k, now))
                now = []
            elif k in closes:
                if not stack:  # it belongs to a chunk before
                    now.append(k)
                    continue
                opener, outer = stack.pop()
                if opens[opener] != closes[k]:
                    return ("?" if self.crossed(opener, k) else "!"), ""
                letter = self.letter_of(opens[opener], "".join(now))
                if letter is None:
                    return "!", ""
                if letter:
                    outer.append(letter)
                now = outer
            else:
                now.append(k)
        while stack:
            opener, outer = stack.pop()
            now = [*outer, opener, *now]
        return "", "".join(now)

    def crossed(self, opener: str, closer: str) -> bool:
        return False

    def letter_of(self, bracket: str, inner: str) -> str | None:
        """The letter a group leaves behind, or None where it cannot be one."""
        return self.group(bracket, inner)

    def whole(self, letters: str) -> bool:
        """Are reduced letters those of a valid file."""
        return not any(k in self.opens or k in self.closes for k in letters) and bool(self.top(self.prepare(letters, False)))

    def valid(self, text: str, tokens: Tokens | None = None) -> bool:
        tokens = tokens or self.lex(text)
        if tokens.bad >= 0:
            return False
        verdict, letters = self.reduce(tokens.kinds)
        return not verdict and self.whole(letters)


class JsGrammar(Grammar):
    def __init__(self) -> None:
        super().__init__(JS, lex_js, {"(": "cond args params head", "{": "block object klass cases names", "[": "array index"})
        self.opens[JS["${"]], self.closes[JS["}$"]] = "${", "${"
        w = self.alphabet
        newline = w["newline"]
        self.rules["word"] = "[" + "".join(w[x] for x in ("name", *JS_WORDS.split())) + "]"
        self.rules["id"] = w.any("name of get set from as async")
        before = w.any(". ?. ? ?? ??= : => = * / % ** += -= *= /= %= **= < > <= >= == != === !== & | ^ && || &&= ||= &= |= ^= << >> >>> <<= >>= >>>= instanceof in catch finally , ) ]")
        after = w.any(". ?. ? ?? ??= => = + - * / % ** += -= *= /= %= **= < > <= >= == != === !== & | ^ ~ ! && || &&= ||= &= |= ^= << >> >>> <<= >>= >>>= instanceof in else extends new typeof void delete , ( [ ... do try case")
        self.idle = re.compile(f"(?<={after}){newline}+|{newline}+(?={before})|{newline}+(?={self.rules['object']}{w['from']})")
        self.newline = newline
        r = self.rule
        r("assign", w.any("= += -= *= /= %= **= ??= &&= ||= &= |= ^= <<= >>= >>>="))
        r("infix", w.any("+ - * / % ** < > <= >= == != === !== & | ^ && || ?? << >> >>> in instanceof"))
        r("prefix", "[" + w.any("+ - ! ~ ++ -- typeof void delete await yield")[1:])
        # a template is its pieces: text ${ expression }$ text; substitutions are folded before this
        r("function", "'async'? 'function' '*'? <id>? <params> <block>")
        r("tail", "(?: (?:'.'|'?.') (?:<word>|<private>) | '?.'? <args> | '?.'? <index> | <template> )")
        r("newed", "'new' (?: '.' <name> | (?:<id>|'this'|<cond>|<function>|'import' '.' <name>) (?: '.' (?:<word>|<private>) | <index> )*+ )")
        r("class", "'class' (?:<id>)? (?: 'extends' (?:<id>|<cond>|'this'|'null'|<function>) <tail>*+ )? <klass>")
        r("primary", "<function> | <class> | <newed> | 'import' (?:'.' <name>|<args>) | <id> | <number> | <string> | <template> | <regex> | <private> | 'this' | 'super' | 'null' | 'true' | 'false' | <cond> | <array> | <object>")
        r("arrowhead", "'async'? (?:<id>|<params>) '=>'")
        r("unit", "(?: <prefix> '*'? | <arrowhead> )*+ (?: (?:<primary>) <tail>*+ (?:'++'|'--')? | (?<=<arrow>) <block> )".replace("<arrow>", "'=>'"))
        r("flat", "<unit> (?: (?:<infix>|<assign>) <unit> )*+")
        r("expr", "<flat> (?: '?' <flat> (?:'?' <flat> ':' <flat>)? ':' <flat> (?:<assign> <flat>)* )* | 'yield'")
        r("list", "<expr> (?:',' <expr>)*+")
        r("target", "<id> | <object> | <array>")
        r("bind", "(?:<target>) (?:'=' <expr>)?")
        r("end", "(?: ';' | <newline>++ )")
        r("lastend", "(?: ';' | <newline>++ | \\Z )")
        r("declare", "(?:'const'|'let'|'var') <bind> (?:',' <bind>)*+")
        r("heads", "(?: 'if' <cond> | 'for' 'await'? <head> | 'while' <cond> | 'with' <cond> | 'do' | <id> ':' | <newline> )*+")
        r("conditional", "(?: 'for' 'await'? <head> | 'while' <cond> | 'with' <cond> | 'do' | <id> ':' | <newline> )*+ 'if' <cond>")
        r("functiondecl", "'async'? 'function' '*'? <id> <params> <block>")
        r("classdecl", "'class' <id> (?: 'extends' (?:<id>|<cond>|<function>) <tail>*+ )? <klass>")
        r("import_", "'import' (?: <string> | (?: <id> (?:',' (?:<names>|'*' 'as' <id>))? | <names> | '*' 'as' <id> ) 'from' <string> ) (?:'with' <object>)? <end>")
        r("export_", "'export' (?: 'default' (?: <function> | <class> | <expr> <end> ) | <functiondecl> | <classdecl> | <declare> <end> | <names> (?:'from' <string>)? <end> | '*' (?:'as' <word>)? 'from' <string> <end> )")
        r("plain", "';' | <block> | <functiondecl> | <classdecl> | <declare> <end> | 'switch' <cond> <cases> | 'try' <block> (?: 'catch' <params>? <block> 'finally' <block> | 'catch' <params>? <block> | 'finally' <block> ) | ('return'|'throw') <list>? <end> | ('break'|'continue') <id>? <end> | 'debugger' <end> | <list> <end>".replace("(", "(?:").replace("(?:?:", "(?:"))
        # an else needs a condition before it
        r("statement", "(?= <conditional> ) <heads> (?:<plain>) (?: (?: <newline>*+ 'while' <cond> <end> )? <newline>*+ 'else' <heads> (?:<plain>) )* | <heads> (?:<plain>)")
        for role, body in {
            "cond": "<list>", "params": "(?: '...'? <bind> (?:',' '...'? <bind>)*+ ','? )?",
            "head": "(?:'const'|'let'|'var')? (?:<target>|<unit>) (?:'of'|'in') <list> | (?: <declare> | <list> )? ';' <list>? ';' <list>?",
        }.items():
            self.role("(", role, body)
        self.serial("(", "args", f"[^{w[',']}]*{w[',']}|[^{w[',']}]+", "'...'? <expr> ','", "(?: '...'? <expr> ','? )?")
        r("key", "<word> | <string> | <number> | <private> | <index>")
        r("method", "(?:'async'|'get'|'set'|'*')*+ (?:<key>) <params> <block> | (?:'get'|'set'|'async') <params> <block>")
        r("member", "<key> ':' <expr> | <id> (?:'=' <expr>)? | '...' <expr> | <method>")
        comma = "[^,]*,|[^,]+"
        self.serial("{", "object", comma.replace(",", w[","]), "(?:<member>) ','", "(?: (?:<member>) ','? )?")
        self.role("{", "names", "(?: (?:<word>|<string>) (?:'as' (?:<word>|<string>))? (?: ',' (?:<word>|<string>) (?:'as' (?:<word>|<string>))? )*+ ','? )?")
        stop = f"[^{w[';']}{newline}{chr(0xE400)}-{chr(0xE7FF)}]*(?:[{w[';']}{chr(0xE400)}-{chr(0xE7FF)}]|{newline}+)|[^{w[';']}{newline}{chr(0xE400)}-{chr(0xE7FF)}]+"
        def twice(body: str) -> tuple[str, str]:
            """The rule within a series, and at its end, where the last terminator may be missing."""
            return body, body.replace("<statement>", "<laststatement>").replace("<end>", "<lastend>").replace("<export_>", "<lastexport>").replace("<import_>", "<lastimport>")

        for name in ("import_", "export_", "plain", "statement"):
            self.rules["last" + name.strip("_")] = self.rules[name].replace("(?&end)", "(?&lastend)").replace("(?&plain)", "(?&lastplain)")
        self.serial("{", "block", stop, *twice("<newline>++ | <statement>"), False)
        self.serial("{", "cases", stop, *twice("<newline>*+ (?: (?: 'case' <list> | 'default' ) ':' <newline>*+ )*+ (?: <statement> )?"), False)
        self.serial("{", "klass", stop, *twice("';' | <newline>++ | 'static' <block> | 'static'? (?:<method>) | 'static'? (?:<key>) (?:'=' <expr>)? <end>"), False)
        self.serial("[", "array", comma.replace(",", w[","]), "(?: '...'? <expr> )? ','", "(?: '...'? <expr> )? ','?")
        self.role("[", "index", "<list>")
        self.top = self.series(stop, *twice("<newline>++ | <import_> | <export_> | <statement>"))

    def prepare(self, content: str, flat: bool) -> str:
        if self.newline not in content:
            return content
        return content.replace(self.newline, "") if flat else self.idle.sub("", content)

    def crossed(self, opener: str, closer: str) -> bool:
        """A brace was taken for a block's end before the chunk with the template's opening was seen."""
        return opener == self.alphabet["${"] and closer == self.alphabet["}"]

    def letter_of(self, bracket: str, inner: str) -> str | None:
        """What stands in a template's ``${ }`` must be an expression; its text is the letter that follows."""
        if bracket != "${":
            return self.group(bracket, inner)
        return "" if self.group("[", inner) in self.rules["index"][1:-1] else None


class RustGrammar(Grammar):
    def __init__(self) -> None:
        super().__init__(RUST, lex_rust, {"(": "tuple exprs params pats types", "{": "block fields literal arms tree variants items fieldpats", "[": "values atype list"})
        w = self.alphabet
        r = self.rule
        self.rules["id"] = w.any("name self Self super crate union macro_rules")
        r("attr", "'#' '!'? <anybracket>")
        r("attrs", "(?: <attr> )*+")
        r("path", "(?: (?:'::')? (?:<id>) (?: '::' (?:<id>) | '::'? <generics> )*+ | <generics> (?: '::' <id> <generics>? )*+ )")
        r("mac", "<path> '!' <name>? (?:<anyparen>|<anybrace>|<anybracket>)")
        r("t0", "(?: '&' <lifetime>? 'mut'? | '&&' <lifetime>? 'mut'? | '*' ('const'|'mut') | 'dyn' | 'impl' | '?' | 'for' <generics> )*+ (?: <mac> | <path> (?:<types>)? | (?:'unsafe'? ('extern' <string>?)?) 'fn' <types> | <types> | <atype> | '!' | '_' | <lifetime> )".replace("('", "(?:'"))
        r("type", "<t0> (?: (?:'->'|'+') <t0> )*+")
        r("bounds", "(?: <type> (?:'+' <type>)*+ '+'? )?")
        r("lit", "'-'? <number> | <string> | <char> | 'true' | 'false'")
        r("p0", "(?: '&' | '&&' | 'ref' | 'mut' | 'box' )*+".replace("| 'box' ", "") + "(?: <mac> | <id> '@' )*+ (?: '_' | '..' | <lit> | <path> (?:<pats>|<fieldpats>)? | <pats> | <list> )")
        r("p1", "<p0> (?: (?:'..='|'..'|'...') (?:<p0>)? )? | '..=' <p0>")
        r("pat", "'|'? (?:<p1>) (?: '|' (?:<p1>) )*+")
        r("opens", "(?: '-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | 'move'? ('||'| '|' (?: '&' | '&&' | 'mut' | 'ref' | <path> (?:<pats>|<fieldpats>)? | <pats> | '_' | ':' <type> | ',' )*+ '|') ('->' <type>)? | 'return' | 'break' <lifetime>? | '..' | '..=' )".replace("('", "(?:'"))
        r("infix", "'+'|'-'|'*'|'/'|'%'|'^'|'&'|'|'|'&&'|'||'|'=='|'!='|'<='|'<'|'<<'|'>' '>'? '='?|'>' '='|'..='|'..'|'='|'+='|'-='|'*='|'/='|'%='|'^='|'&='|'|='|'<<='")
        r("tailx", "(?: '?' | '.' (?:<id>|'await'|<number>) ('::' <generics>)? | <exprs> | <values> | <generics> | 'as' <t0> )".replace("('", "(?:'"))
        r("bare", "<mac> | <path> | <lit> | <exprs> | <values>")
        r("headunit", "(?:<opens>)*+ (?: (?:<bare>) (?:<tailx>)*+ )")
        r("head", "(?: 'let' <pat> '=' )? <headunit> (?: (?:<infix>) (?: 'let' <pat> '=' )? <headunit> )*? (?: '..' )?")
        # an expression that ends in a block needs no semicolon
        r("blocky", "(?: <lifetime> ':' )? (?: 'if' <head> <block> (?: 'else' 'if' <head> <block> )*+ (?: 'else' <block> )? | 'match' <head> <arms> | 'loop' <block> | 'while' <head> <block> | 'for' <pat> 'in' <head> <block> | 'unsafe' <block> | 'async' 'move'? <block> | 'const' <block> | <block> )")
        r("primary", "<blocky> | <path> <literal> | <bare>")
        r("unit", "<attrs> (?:<opens>)*+ (?: (?:<primary>) (?:<tailx>)* | (?<='return') | (?<='break') | (?<='..') ) | (?:<opens>)* (?: 'return' | 'break' <lifetime>? | 'continue' <lifetime>? | '..' )".replace("(?<='return') | (?<='break') | (?<='..')", "(?!)"))
        r("expr", "<unit> (?: (?:<infix>) <unit> )* (?: '..' )?")
        r("vis", "(?: 'pub' (?:<anyparen>)? )?+")
        r("where_", "(?: 'where' (?: (?:<type>) ':' <bounds> ','? | <lifetime> ':' <bounds> ','? )*+ )?+")
        r("fn_", "(?: 'const' | 'async' | 'unsafe' | 'extern' <string>? )*+ 'fn' <id> <generics>? <params> (?: '->' <type> )? <where_> (?: <block> | ';' )")
        r("item", "<attrs> <vis> (?: <fn_> | 'struct' <name> <generics>? (?: <where_> <fields> | <types> <where_> ';' | <where_> ';' ) | ('enum') <name> <generics>? <where_> <variants> | 'union' <name> <generics>? <where_> <fields> | 'unsafe'? 'impl' <generics>? '!'? <type> (?: 'for' <type> )? <where_> <items> | 'unsafe'? 'trait' <name> <generics>? (?: ':' <bounds> )? <where_> <items> | 'mod' <name> (?: ';' | <items> ) | 'use' '::'? (?: <id> '::' )* (?: '*' | <tree> | <id> (?: 'as' (?:<id>|'_') )? ) ';' | 'extern' 'crate' <id> (?: 'as' <id> )? ';' | 'extern' <string>? <items> | ('const'|'static') 'mut'? (?:<name>|'_') ':' <type> (?: '=' <expr> )? ';' | 'type' <name> <generics>? (?: ':' <bounds> )? <where_> (?: '=' <type> )? <where_> ';' | 'macro_rules' '!' <name> (?: <anybrace> | (?:<anyparen>|<anybracket>) ';' ) | <path> '!' (?: <anybrace> | (?:<anyparen>|<anybracket>) ';' ) )".replace("('", "(?:'"))
        r("stmt", "';' | <item> | <attrs> 'let' <pat> (?: ':' <type> )? (?: '=' <expr> (?: 'else' <block> )? )? ';' | <attrs> <expr> ';' | <attrs> <blocky> | <path> '!' <anybrace>")
        r("inner", "(?: '#' '!' <anybracket> )*+")
        brace, semi, comma = f"{chr(0xE400)}-{chr(0xE7FF)}", w[";"], w[","]
        stop = f"[^{semi}{brace}]*[{semi}{brace}]|[^{semi}{brace}]+"
        commas = f"[^{comma}]*{comma}|[^{comma}]+"
        self.serial("{", "block", stop, "<inner> <stmt>", "<inner> (?: <stmt> )? (?: <attrs> <expr> )?")
        self.role("{", "fields", "(?: <attrs> <vis> <name> ':' <type> (?:','|\\Z) )*+")
        self.serial("{", "literal", commas, "<attrs> (?:<name>|<number>) (?: ':' <expr> )? ','", "(?: <attrs> (?: (?:<name>|<number>) (?: ':' <expr> )? | '..' <expr> ) ','? )?")
        arm = "<inner> (?: <attrs> <pat> (?: 'if' <expr> )? '=>' (?: <blocky> ','? | <expr> END ) )"
        self.serial("{", "arms", f"[^{comma}{brace}]*(?:{comma}|[{brace}]{comma}?)|[^{comma}{brace}]+", arm.replace("END", "','"), arm.replace("END", "(?:','|\\Z)") + "?")
        r("leaf", "(?: <id> '::' )* (?: '*' | <tree> | <id> (?: 'as' (?:<id>|'_') )? )")
        self.role("{", "tree", "(?: <leaf> (?: ',' <leaf> )*+ ','? )?")
        self.role("{", "variants", "(?: <attrs> <vis> <name> (?: <types> | <fields> )? (?: '=' <expr> )? (?:','|\\Z) )*+")
        self.serial("{", "items", stop, "<inner> <item>", "<inner> (?: <item> )?")
        self.role("{", "fieldpats", "(?: <attrs> (?: '..' | (?:<name>|<number>) ':' <pat> | ('ref'|'mut')*+ <name> ) (?:','|\\Z) )*+".replace("('", "(?:'"))
        self.serial("(", "exprs", commas, "<expr> ','", "(?: <expr> ','? )?")
        self.role("(", "tuple", "<expr>")
        self.role("(", "params", "(?: <attrs> (?: (?: '&' <lifetime>? )? 'mut'? 'self' (?: ':' <type> )? | <pat> ':' <type> | '...' ) (?:','|\\Z) )*+")
        self.role("(", "pats", "(?: <pat> (?:','|\\Z) )*+")
        self.role("(", "types", "(?: <attrs> <vis> (?: <name> ':' )? <type> (?: (?:','|\\Z) | '->' <type> ) )*+")
        self.serial("[", "values", commas, "<expr> ','", "(?: <expr> ','? | <expr> ';' <expr> )?")
        self.role("[", "atype", "<type> (?: ';' <expr> )?")
        self.role("[", "list", "(?: <pat> (?:','|\\Z) )*+")
        argument = "(?: <lifetime> (?: ':' <bounds> )? | 'const' <name> ':' <type> (?: '=' (?:<lit>|<block>) )? | <name> <generics>? (?: '=' <type> | ':' <bounds> ) (?: '=' <type> )? | <type> | <lit> | <block> )"
        self.angle = self.compiled(f"'<' (?: {argument} (?: ',' {argument} )*+ ','? )? '>'")
        self.top = self.series(stop, "<inner> <item>", "<inner> (?: <item> )?")

    def prepare(self, content: str, flat: bool) -> str:
        if self.alphabet["<"] not in content:
            return content
        n = 1
        while n:
            content, n = self.angle.subn(self.alphabet["generics"], content)
        return content


class GoGrammar(Grammar):
    def __init__(self) -> None:
        super().__init__(GO, lex_go, {"(": "exprs params group imports", "{": "block fields methods literal cases comms", "[": "length targs index tparams"})
        r, w = self.rule, self.alphabet
        r("tname", "<name> (?: '.' <name> )? <targs>?")
        r("wrap", "(?: '*' | <anybracket> | 'map' <targs> | '<-'? 'chan' '<-'? )*+".replace("<anybracket>", "<length>"))
        r("base", "'struct' <fields> | 'interface' <methods> | <tname> | 'func' <params> (?: <wrap> (?: <tname> | 'struct' <fields> | 'interface' <methods> ) | <params> )? | <group>")
        r("type", "<wrap> (?:<base>)")
        r("result", "(?: <params> | <type> )?")
        r("unary", w.any("+ - ! ^ * & <- ~"))
        r("binary", w.any("+ - * / % & | ^ << >> &^ && || == != < <= > >="))
        r("func", "'func' <params> <result> <block>")
        r("littype", "<wrap> (?: 'struct' <fields> | <tname> ) | '[' ".replace("| '[' ", ""))
        r("operand", "<func> | <littype> <literal> | <type> <exprs> | <name> | <number> | <string> | <char> | <exprs> | <type>")
        r("after", "(?: '.' (?: <name> | <group> ) | <index> | <exprs> | <targs> | '.' '(' )".replace(" | '.' '('", "") )
        r("afters", "(?: <after> | <literal> )*+")
        r("unit", "<unary>*+ (?:<operand>) <afters>")
        r("expr", "<unit> (?: <binary> <unit> )*+")
        r("list", "<expr> (?: ',' <expr> )*+")
        # heads of if, for and switch hold no composite literal outside brackets
        r("hoperand", "<func> | <type> <exprs> | <name> | <number> | <string> | <char> | <exprs> | <type>")
        r("hunit", "<unary>*+ (?:<hoperand>) (?:<after>)*+")
        r("hexpr", "<hunit> (?: <binary> <hunit> )*+")
        r("hlist", "<hexpr> (?: ',' <hexpr> )*+")
        r("assign", w.any(":= = += -= *= /= %= &= |= ^= <<= >>= &^="))
        r("simple", "<list> (?: (?:'++'|'--') | <assign> 'range'? <list> | '<-' <expr> )?")
        r("hsimple", "<hlist> (?: (?:'++'|'--') | <assign> <hlist> | '<-' <hexpr> )?")
        r("ifone", "'if' (?: (?:<hsimple>)? ';' )? <hexpr> <block>")
        r("if_", "<ifone> (?: 'else' <ifone> )*+ (?: 'else' <block> )?")
        r("for_", "'for' (?: (?: <hlist> (?:':='|'=') )? 'range' <hexpr> | (?:<hsimple>)? ';' (?:<hexpr>)? ';' (?:<hsimple>)? | <hexpr> )? <block>")
        r("switch_", "'switch' (?: (?:<hsimple>)? ';' )? (?:<hsimple>)? <cases>")
        r("names", "<name> (?: ',' <name> )*+")
        r("spec", "<names> (?: <type> )? (?: '=' <list> )?")
        r("typespec", "<name> <tparams>? '='? <type>")
        r("decl", "(?:'var'|'const') (?: <spec> | <group> ) | 'type' (?: <typespec> | <group> )")
        r("stmt0", "<decl> | <if_> | <for_> | <switch_> | 'select' <comms> | 'return' (?:<list>)? | ('go'|'defer') <expr> | ('break'|'continue') <name>? | 'goto' <name> | 'fallthrough' | <block> | <simple>".replace("('", "(?:'"))
        r("stmt", "(?: <name> ':' ';'? )*+ (?: (?:<stmt0>) )? ")
        stop, commas = f"[^{w[';']}]*{w[';']}|[^{w[';']}]+", f"[^{w[',']}]*{w[',']}|[^{w[',']}]+"
        case, comm = "(?: (?: 'case' (?:<list>|<type> (?:',' <type>)*+) | 'default' ) ':' )*+ <stmt>", "(?: (?: 'case' <simple> | 'default' ) ':' )*+ <stmt>"
        self.serial("{", "block", stop, "<stmt> ';'", "<stmt> ';'?")
        self.serial("{", "cases", stop, case + " ';'", case + " ';'?")
        self.serial("{", "comms", stop, comm + " ';'", comm + " ';'?")
        self.role("{", "fields", "(?: (?: <names> <type> | '*'? <tname> ) <string>? (?:';'|\\Z) )*+")
        self.role("{", "methods", "(?: (?: <name> <params> <result> | '~'? <type> (?: '|' '~'? <type> )*+ ) (?:';'|\\Z) )*+")
        r("element", "(?: (?:<expr>|<literal>) ':' )? (?: <expr> | <literal> )")
        self.serial("{", "literal", commas, "<element> ','", "(?: <element> ','? )?")
        self.role("(", "exprs", "(?: <list> '...'? ','? )?")
        r("param", "<name> '...'? <type> | '...'? <type>")
        self.role("(", "params", "(?: (?:<param>) (?: ',' (?:<param>) )*+ ','? )?")
        self.role("(", "group", "(?: (?: <spec> | <typespec> ) (?:';'|\\Z) )*+ | <type> | 'type'")
        self.role("(", "imports", "(?: (?:<name>|'.')? <string> (?:';'|\\Z) )*+")
        self.role("[", "length", "(?: <expr> | '...' )?")
        self.role("[", "targs", "<type> (?: ',' <type> )*+ ','?")
        self.role("[", "index", "<expr> | <expr>? ':' <expr>? (?: ':' <expr> )?")
        self.role("[", "tparams", "(?: <names> '~'? <type> (?: '|' '~'? <type> )*+ (?:','|\\Z) )++")
        one = "(?: 'package' <name> | 'import' (?: (?:<name>|'.')? <string> | <imports> ) | <decl> | 'func' <params>? <name> <tparams>? <params> <result> <block>? )?"
        whole = self.series(stop, one + " ';'", one + " ';'?")
        # the package clause comes first, imports before declarations
        order = re.compile(self.text(f"'package'(?:(?!{w['import']}|{w['package']}).)*+(?:'import'(?:(?!{w['import']}|{w['package']}|{w['func']}|{w['type']}|{w['var']}|{w['const']}).)*+)*+(?:(?!{w['import']}|{w['package']}).)*+"), re.S)
        self.top = lambda content: bool(order.fullmatch(content)) and whole(content)


class JsonGrammar(Grammar):
    def __init__(self) -> None:
        super().__init__(JSON, lex_json, {"(": "none", "{": "object", "[": "array"})
        comma = self.alphabet[","]
        self.rule("value", "<string> | <number> | <literal> | <object> | <array>")
        commas, pair = f"[^{comma}]*{comma}|[^{comma}]+", "<string> ':' (?:<value>)"
        self.serial("{", "object", commas, pair + " ','", pair)
        self.serial("[", "array", commas, "(?:<value>) ','", "<value>")
        self.tests["("] = []
        self.top = self.compiled("<value>").fullmatch
