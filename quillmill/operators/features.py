"""Feature vector of a symbol: 8 structural, 16 semantic, 12 behavioural and 8 textual positions, padded to 64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64
# Code of each kind of symbol.
KINDS = {"function": 0.1, "method": 0.2, "class": 0.3, "struct": 0.4, "enum": 0.5, "trait": 0.6, "interface": 0.7, "constant": 0.8, "variable": 0.9, "module": 1.0}
# Fixed values: (what is looked at, pattern, value); text is name, signature and documentation in lower case.
SEMANTIC = [
    ("text", "error|exception|result|try", 0.9), ("text", "valid|check|assert|verify", 0.9), ("text", "process|transform|convert|parse", 0.9), ("text", "read|write|file|stream", 0.9),
    ("text", "calc|compute|sum|count", 0.9), ("text", "init|new|create|build", 0.9), ("text", "clean|close|drop|free", 0.9), ("text", "config|setting|option|param", 0.9),
    ("text", "async|await|thread|spawn", 0.9), ("lower_name", "^(?:get|is_|has_)", 0.9), ("lower_name", "^(?:set|update|modify)", 0.9), ("text", "add|remove|push|pop|insert|delete", 0.9),
    ("text", "find|search|lookup|query", 0.9), ("text", "format|display|render|to_string", 0.9), ("text", "test|mock|expect|assert", 0.9), ("text", "helper|util|misc", 0.9),
]
BEHAVIOURAL = [
    ("not text", "mut|write|set|modify", 0.7), ("text", "mut", 0.9), ("signature", "Result|Option", 0.9), ("signature", r"Fn|fn\(|callback", 0.9), ("signature", "<.*>|>.*<", 0.9), ("signature", "^pub ", 0.9),
    ("not signature", "self", 0.9), ("name", "^(?:new$|default$|from_|with_)", 0.9), ("name", "^(?:drop|close|cleanup)$", 0.9), ("iterator", "", 0.9), ("name", "^(?:fmt|clone$|default$|eq$|cmp$)", 0.9), ("name", "^(?:to_|into_|as_|from_)", 0.9),
]


def vector(name: Column, kind: Column, signature: Column, documentation: Column, params: Column, lines: Column, children: Column) -> Column:
    """``ARRAY<DOUBLE>`` of 64; ``lines`` is last line less first line."""
    n, sig = F.coalesce(name, F.lit("")), F.coalesce(signature, F.lit(""))
    doc = F.coalesce(documentation, F.lit(""))
    seen = {"name": n, "lower_name": F.lower(n), "signature": sig, "text": F.lower(F.concat(n, F.lit(" "), sig, F.lit(" "), doc))}
    flag = lambda test, value=1.0: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    code = F.lit(0.0)
    for k, v in KINDS.items():
        code = F.when(kind == k, F.lit(v)).otherwise(code)
    share = lambda x, top: F.least(x / float(top), F.lit(1.0))
    out = [code, share(params, 10), share(lines, 100), share(children, 20), flag(kind.isin("function", "method")), flag(kind.isin("class", "struct", "enum", "interface")), flag(lines < 10), flag((lines > 50) | (params > 5))]
    for what, pattern, value in SEMANTIC + BEHAVIOURAL:
        if what == "iterator":
            out.append(flag(n.isin("iter", "next") | F.contains(sig, F.lit("Iterator")), value))
        elif what.startswith("not "):
            out.append(flag(~F.rlike(seen[what[4:]], F.lit(pattern)), value))
        else:
            out.append(flag(F.rlike(seen[what], F.lit(pattern)), value))
    snake = F.contains(n, F.lit("_"))
    out += [share(F.octet_length(n), 50), flag(snake), flag(F.rlike(n, F.lit("[A-Z]")) & F.rlike(n, F.lit("[a-z]")) & ~snake), flag(F.rlike(n, F.lit("^[A-Z_]*$"))), flag(documentation.isNotNull()), share(F.octet_length(doc), 500), flag(F.rlike(n, F.lit("[0-9]$"))), flag(F.rlike(n, F.lit("^(?:get|set|is|has|on|do)_")))]
    return F.concat(F.array(*out), F.array_repeat(F.lit(0.0), DIMS - len(out)))
