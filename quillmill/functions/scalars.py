"""Column functions: tokens, paths, names, sizes, ages, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of a file extension (labels of the context tool; anything else is text).
LANGUAGE_BY_EXTENSION = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css", "sql": "sql",
}
# Labels by extension of the rendering entry point, which differ from the above; anything else has none.
FENCE_BY_EXTENSION = {
    "py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "html": "html", "css": "css", "sh": "bash", "bash": "bash",
    "go": "go", "java": "java", "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "sql": "sql", "xml": "xml",
}
# Grammars by extension of the parser.
GRAMMAR_BY_EXTENSION = {
    "rs": "rust", "py": "python", "pyw": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "p": "abl", "i": "abl", "w": "abl", "cls": "abl",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "java": "java", "go": "go", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php", "phtml": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala",
    "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "markdown": "markdown", "sh": "bash", "bash": "bash", "zsh": "bash", "ksh": "bash", "sql": "sql",
}
# Fragments deleted from names before they are compared, in order.
NAME_FRAGMENTS = ["calculate_", "calc_", "_calc", "validate_", "check_", "_validate", "get_", "fetch_", "_get", "process_", "handle_", "_process", "is_", "has_", "can_"]


def tokens(content: Column) -> Column:
    """Bytes div 4."""
    return F.floor(F.octet_length(content) / 4).cast("bigint")


def file_cost(path: Column, content: Column) -> Column:
    """Tokens of a rendered file: its content and a header of 70 bytes and twice its path."""
    return tokens(content) + F.floor((F.lit(70) + 2 * F.octet_length(path)) / 4).cast("bigint")


def clean_path(path: Column) -> Column:
    """Forward slashes, and no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def top_dir(path: Column) -> Column:
    """First path component without a dot, else ``root``."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda c: ~F.contains(c, F.lit("."))), F.lit(0)), F.lit("root"))


def by_map(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def language(path: Column) -> Column:
    return by_map(extension(path), LANGUAGE_BY_EXTENSION, "text")


def whole_days(start: Column, end: Column) -> Column:
    """Whole days between two instants, never negative."""
    return F.greatest(F.timestamp_diff("DAY", start, end), F.lit(0)).cast("bigint")


def human_bytes(n: Column) -> Column:
    """Steps of 1,024, one decimal above bytes."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024**2, step(1, "K")).when(n < 1024**3, step(2, "M")).otherwise(step(3, "G"))


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def cdata(x: Column) -> Column:
    return F.replace(x, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def normal_name(name: Column) -> Column:
    """Snake case without the fragments that say nothing about the subject."""
    x = F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))
    for fragment in NAME_FRAGMENTS:
        x = F.replace(x, F.lit(fragment), F.lit(""))
    return F.regexp_replace(F.regexp_replace(x, "__+", "_"), r"^_+|_+$", "")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longest length of the normal names; two empty names are equal."""
    x, y = normal_name(a), normal_name(b)
    longest = F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def budget_tokens(text: Column) -> Column:
    """``100k`` and ``2M`` as numbers; null for anything else."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)[km]?$", 1)
    unit = F.when(t.endswith("k"), 1000).when(t.endswith("m"), 1000000).otherwise(1)
    return F.when(n != "", n.cast("bigint") * unit)


def line_array(content: Column) -> Column:
    return F.split(content, "\n")


def thousands(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n.cast("bigint"), 0)


def path_from(path: Column, base: str) -> Column:
    """The path relative to a folder above it, else as it is."""
    head = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def qualified_name(parent: Column, name: Column, separator: str = "::") -> Column:
    return F.concat_ws(separator, F.when(parent != "", parent), name)


def compact_age(seconds: Column) -> Column:
    """``59s``, ``59m``, ``23h``, ``29d``; null from 30 days on, where a date says more."""
    whole = lambda unit, letter: F.concat(F.floor(seconds / unit).cast("string"), F.lit(letter))
    return F.when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).when(seconds < 30 * 86400, whole(86400, "d"))


def compact_time(at: Column, now: Column) -> Column:
    """Age of an instant while it is young, then year and month."""
    return F.coalesce(compact_age(now.cast("bigint") - at.cast("bigint")), F.date_format(at, "yyyy-MM"))


def safe_path(path: Column) -> Column:
    """A path for an attribute: forward slashes, no control characters, escaped."""
    return escape_xml(F.regexp_replace(clean_path(path), r"[\x00-\x1f\x7f]", ""))


def contained(path: Column) -> Column:
    """Does a relative path stay below its root: no step leads above it."""
    parts = F.filter(F.split(clean_path(path), "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return ~F.startswith(path, F.lit("/")) & (depth["low"] >= 0)
