"""Line operators: truncation, counting, symbols, calls, usages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import line_array

# Comment leaders, and the words that are no calls.
LINE_COMMENT = r"^\s*(?://|#(?:[^\[]|$)|--|;)"
NO_CALLS = ["if", "for", "while", "switch", "match", "return", "catch", "fn", "def", "function", "func", "class", "super", "sizeof", "typeof", "print", "println", "len", "range", "str", "int", "isinstance", "assert", "vec", "format"]
DEFINITION = r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+|async\s+|static\s+|unsafe\s+|const\s+)*(fn|def|func|function|class|struct|enum|trait|impl|interface|type)\b"
STRUCTURE = r"^\s*(?:import\b|from\b|use\b|package\b|mod\b|class\b|def\b|async def\b|fn\b|pub\b|func\b|function\b|export\b|struct\b|enum\b|trait\b|impl\b|interface\b|type\b|@|#\[)"


def truncate_simple(content: Column, n: int) -> Column:
    """First ``n`` lines and a marker with the share that was cut."""
    lines = line_array(content)
    total = F.size(lines)
    marker = F.concat(F.lit(f"\n... truncated after {n} of "), total.cast("string"), F.lit(" lines ("), F.floor((total - n) * 100 / total).cast("string"), F.lit("% cut)"))
    return F.when(total <= n, content).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), marker))


def truncate_gap(content: Column, n: int) -> Column:
    """First 40 % of ``n`` lines, a gap, last 10 %."""
    lines = line_array(content)
    total, head, tail = F.size(lines), int(0.4 * n), int(0.1 * n)
    gap = F.concat(F.lit("\n... gap of "), (total - head - tail).cast("string"), F.lit(" lines\n"))
    return F.when(total <= n, content).otherwise(F.concat(F.array_join(F.slice(lines, 1, head), "\n"), gap, F.array_join(F.slice(lines, total - tail + 1, tail), "\n") if tail else F.lit("")))


def truncate_structure(content: Column, fallback: int = 20) -> Column:
    """Only lines that declare or import something; the first lines where there is none."""
    lines = line_array(content)
    kept = F.filter(lines, lambda x: F.rlike(x, F.lit(STRUCTURE)))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.slice(lines, 1, fallback)), "\n")


def truncate_markdown(content: Column, n: int, path: Column) -> Column:
    """First ``n`` lines and a marker that lists up to eight of the first ten link targets of the text."""
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n")
    total = F.size(lines)
    links = F.slice(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"\[[^\]]+\]\(([^\)]+)\)"), F.lit(1)))), 1, 10)
    rule = "=" * 70
    named = F.when(F.size(links) > 8, F.concat(F.array_join(F.slice(links, 1, 8), ", "), F.lit(", ..."))).otherwise(F.array_join(links, ", "))
    head = F.concat(F.lit(f"\n\n{rule}\nTRUNCATED at line {n}/"), total.cast("string"), F.lit(" ("), F.floor((total - n) * 100 / total).cast("string"), F.lit("% reduction)\nLanguage: Markdown\nCategory: documentation"))
    imports = F.when(F.size(links) > 0, F.concat(F.lit("\nKey imports: "), named)).otherwise("")
    tail = F.concat(F.lit('\n\nTo get full content: --include "'), path, F.lit(f'" --truncate 0\n{rule}\n'))
    return F.when(total <= n, content).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), head, imports, tail))


def truncate_smart(content: Column, n: int) -> Column:
    """The important lines with markers of the gaps between them; where these are more than ``n`` or fewer than 50, as ``truncate_gap``."""
    lines = line_array(content)
    total = F.size(lines)
    numbered = F.transform(F.arrays_zip(lines.alias("line"), important_lines(content).alias("keep")), lambda x, i: F.struct((i + 1).alias("no"), x["line"].alias("line"), x["keep"].alias("keep")))
    kept = F.filter(numbered, lambda x: x["keep"])
    count = F.size(kept)

    def piece(x: Column, before: Column) -> Column:
        gap = F.when(x["no"] > before + 1, F.concat(F.lit("\n... ["), (x["no"] - before - 1).cast("string"), F.lit(" lines omitted] ...\n\n"))).otherwise("")
        return F.concat(gap, x["line"], F.lit("\n"))

    # every kept line beside the number of the one before it; what is left over at the end is null and not joined
    text = F.array_join(F.zip_with(kept, F.concat(F.array(F.lit(0)), F.transform(kept, lambda x: x["no"])), piece), "")
    return F.when(total <= n, content).when((count > n) | (count < 50), truncate_gap(content, n)).otherwise(text)


def important_lines(content: Column) -> Column:
    """Flags of the smart mode: the first ten lines, definitions with five following, critical markers."""
    # a lambda that looked into the line array would split the text again for every line, so
    # the flags of definitions are shifted and joined instead
    lines = line_array(content)
    defines = F.transform(lines, lambda x: F.rlike(x, F.lit(DEFINITION)))
    near = defines
    for k in range(1, 6):
        shifted = F.slice(F.concat(F.array_repeat(F.lit(False), k), defines), F.lit(1), F.size(lines))
        near = F.zip_with(near, shifted, lambda a, b: a | b)
    marked = F.transform(lines, lambda x, i: (i < 10) | F.rlike(x, F.lit(r"TODO|FIXME|XXX|HACK|__main__|\bmain\(")))
    return F.zip_with(near, marked, lambda a, b: a | b)


def line_counts(df: DataFrame, key: str, content: str, language: str) -> DataFrame:
    """``key, language, total, code, comment, blank`` with line comments only (the stateless rules)."""
    lines = F.split(F.regexp_replace(F.col(content), r"\n\z", ""), "\n")
    total = F.when(F.col(content) == "", 0).otherwise(F.size(lines))
    blank = F.when(F.col(content) == "", 0).otherwise(F.size(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", "")) == "")))
    comment = F.when(F.col(content) == "", 0).otherwise(F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(LINE_COMMENT)))))
    return df.select(key, F.col(language).alias("language"), total.cast("bigint").alias("total"), (total - blank - comment).cast("bigint").alias("code"), comment.cast("bigint").alias("comment"), blank.cast("bigint").alias("blank"))


# How comments of a language begin, and how long ones begin and end; as plain text, in lines without space
# around them. Where a language's own table holds a regular expression instead, no line contains it.
SIGNATURES: dict[str, tuple[str, str, str]] = {
    "rs": ("//", "", ""), "py": ("#", "", ""), "js": ("//", "", ""), "ts": ("//", "", ""), "go": ("//", "", ""), "java": ("//", "", ""), "c": ("//", "", ""), "cpp": ("//", "", ""),
    "rb": ("#", "=begin", "=end"), "html": ("", "<!--", "-->"), "htm": ("", "<!--", "-->"), "xml": ("", "<!--", "-->"), "vue": ("//", "<!--", "-->"), "svelte": ("//", "<!--", "-->"), "css": ("", "", ""),
    "json": ("", "", ""), "yaml": ("#", "", ""), "yml": ("#", "", ""), "toml": ("#", "", ""), "sh": ("#", "", ""), "bash": ("#", "", ""), "md": ("", "", ""),
}


def signature_counts(df: DataFrame, key: str, content: str, ext: Column) -> DataFrame:
    """``key, extension, total, code, comment, blank`` with the state of long comments carried over lines.

    Files of extensions without a signature give no row. A line inside a long comment, or one
    that begins or holds its beginning, is comment as a whole.
    """
    at = lambda i: F.element_at(F.create_map(*[x for e, v in SIGNATURES.items() for x in (F.lit(e), F.lit(v[i]))]), ext)
    named = df.select(key, F.col(content).alias("_t"), ext.alias("extension"), at(0).alias("_one"), at(1).alias("_from"), at(2).alias("_to")).where("_one is not null")
    lines = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("_t", r"\r?\n\z", ""), r"\r?\n"))
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"))

    def step(s: Column, line: Column) -> Column:
        x = F.regexp_replace(line, r"^\s+|\s+$", "")
        blank = x == ""
        opens = (F.col("_from") != "") & F.contains(x, F.col("_from"))
        ends = (F.col("_to") != "") & F.contains(x, F.col("_to"))
        single = (F.col("_one") != "") & F.startswith(x, F.col("_one"))
        comment = ~blank & (s["inside"] | opens | single)
        inside = F.when(blank, s["inside"]).when(s["inside"] | opens, ~ends).otherwise(False)
        return F.struct(inside.alias("inside"), (s["code"] + (~blank & ~comment).cast("int")).alias("code"), (s["comment"] + comment.cast("int")).alias("comment"), (s["blank"] + blank.cast("int")).alias("blank"))

    out = named.select(key, "extension", F.size(lines).cast("bigint").alias("total"), F.aggregate(lines, zero, step).alias("s"))
    return out.select(key, "extension", "total", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("code", "comment", "blank")])


def language_statistics(counts: DataFrame) -> DataFrame:
    """Totals by language and, as language ``all``, over everything."""
    out = counts.rollup("language").agg(F.count("*").alias("files"), F.sum("total").alias("total"), F.sum("code").alias("code"), F.sum("comment").alias("comment"), F.sum("blank").alias("blank"), F.grouping("language").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("language")).alias("language"), "files", "total", "code", "comment", "blank")


def exploded_lines(df: DataFrame, keep: list[str], content: str) -> DataFrame:
    return df.select(*keep, F.posexplode(line_array(F.col(content))).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def symbols(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, line_no, kind, name``: definitions found line by line."""
    pattern = DEFINITION + r"\s+([A-Za-z_]\w*)"
    rows = exploded_lines(df, [key], content).where(F.rlike("line", F.lit(pattern)))
    return rows.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("name"))


def calls(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, callee``: distinct names called outside comment lines, without language words."""
    rows = exploded_lines(df, [key], content).where(~F.rlike("line", F.lit(LINE_COMMENT)) & ~F.rlike("line", F.lit(DEFINITION)))
    found = rows.select(key, F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)).alias("callee"))
    return found.where(~F.col("callee").isin(NO_CALLS)).distinct()


def usages(df: DataFrame, key: str, content: str, name: str, limit: int) -> DataFrame:
    """First ``limit`` lines that mention a name outside its definitions."""
    rows = exploded_lines(df, [key], content).where(F.rlike("line", F.lit(rf"\b{name}\b")) & ~F.rlike("line", F.lit(DEFINITION)))
    return rows.orderBy(key, "line_no").limit(limit).select(key, "line_no", "line")


def imports(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, module``: imported modules of Python, JavaScript, Rust and Go files."""
    pattern = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:\{[^}]*\}\s+from\s+)?[\"']?([\w./-]+)[\"']?|use\s+([\w:]+))"
    found = F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0))
    return df.select(key, F.explode(found).alias("x")).select(key, F.coalesce(*[F.when(F.regexp_extract("x", pattern, i) != "", F.regexp_extract("x", pattern, i)) for i in (1, 2, 3)]).alias("module")).distinct()


def doc_before(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, line_no, doc_lines``: how many comment lines stand directly above each definition."""
    lines = line_array(F.col(content))
    found = df.select(key, lines.alias("lines"), F.posexplode(lines).alias("pos", "line")).where(F.rlike("line", F.lit(DEFINITION)))
    # lines above, nearest first; the comment ends at the first that is none
    above = F.reverse(F.slice("lines", F.lit(1), F.col("pos")))
    first_other = F.array_position(F.transform(above, lambda x: F.rlike(x, F.lit(r"^\s*(?:///|//!|//|#(?!\[)|\*|/\*)"))), False)
    count = F.when(F.col("pos") == 0, 0).when(first_other == 0, F.col("pos")).otherwise(first_other - 1)
    return found.select(key, (F.col("pos") + 1).alias("line_no"), count.cast("bigint").alias("doc_lines"))


def parameters(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, line_no, name, n_params``: parameters of definitions whose list closes on their line, receivers not counted."""
    pattern = r"\b(?:fn|def|func|function)\s+([A-Za-z_]\w*)(?:<[^>]*>)?\(([^()]*)\)"
    rows = exploded_lines(df, [key], content).where(F.rlike("line", F.lit(DEFINITION)) & F.rlike("line", F.lit(pattern)))
    listed = F.transform(F.split(F.regexp_extract("line", pattern, 2), ","), lambda x: F.trim(x))
    own = F.filter(listed, lambda x: (x != "") & ~F.rlike(x, F.lit(r"^(?:&?(?:mut )?self|cls|this|\*|/)$")))
    return rows.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.size(own).cast("bigint").alias("n_params"))


# What a Python decorator's name, in lower case, tells about its function; the first that holds wins.
DECORATORS: list[tuple[str, str]] = [
    ("testing", r"pytest|fixture|unittest|mock|patch|^test"), ("configuration", r"dataclass|attr|pydantic|config|settings"), ("validation", r"validator|validates|validate|^classmethod$"),
    ("infrastructure", r"^abstractmethod$|^staticmethod$|^property$|override|singleton"), ("caching", r"cache|memoize"), ("logging", r"log|trace|timer|profile"), ("api_routing", r"route|api|endpoint|^(?:get|post|put|delete)$"),
]


def decorators(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, line_no, decorator, category`` of Python decorators."""
    pattern = r"^\s*@([A-Za-z_][\w.]*)"
    rows = exploded_lines(df, [key], content).where(F.rlike("line", F.lit(pattern)))
    name = F.lower(F.col("decorator"))
    category = F.lit("unknown")
    for label, words in reversed(DECORATORS):
        category = F.when(F.rlike(name, F.lit(words)), label).otherwise(category)
    return rows.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("decorator")).withColumn("category", category)


def markers(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, line_no, marker``: task markers in comment lines, the first of a line."""
    pattern = r"\b(TODO|FIXME|XXX|HACK|BUG|NOTE)\b"
    rows = exploded_lines(df, [key], content).where(F.rlike("line", F.lit(LINE_COMMENT)) & F.rlike("line", F.lit(pattern)))
    return rows.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("marker"))
