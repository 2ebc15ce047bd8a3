"""Row labels: tiers, lens priorities, age, churn and health classes, concepts, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .filters import included, lens_glob

# Patterns and priorities of the built-in lenses; the greatest matching priority counts.
LENSES: dict[str, tuple[list[tuple[str, int]], int]] = {
    "architecture": ([("*.py", 100), ("rust/src/**/*.rs", 100), ("**/*.rs", 95), ("Cargo.toml", 90), ("pyproject.toml", 90), ("*.toml", 85), ("*.json", 80), ("*.yaml", 80), ("*.yml", 80), ("Makefile", 75), ("Dockerfile", 70), ("README.md", 65), ("*.ts", 60), ("*.tsx", 60), ("*.js", 55), ("*.jsx", 55)], 50),
    "debug": ([("*.py", 100), ("*.rs", 100), ("*.js", 90), ("*.ts", 90), ("tests/**", 85), ("test/**", 85)], 50),
    "security": ([("*auth*", 100), ("*secret*", 100), ("*credential*", 100), ("*password*", 100), ("*token*", 98), ("*security*", 95), ("*crypto*", 95), ("*encrypt*", 95), ("*.env*", 92), ("*config*", 88), ("*settings*", 88), ("package.json", 90), ("package-lock.json", 85), ("requirements.txt", 90), ("Cargo.toml", 90), ("Cargo.lock", 85), ("go.mod", 90), ("Gemfile", 90), ("**/server/**", 80), ("**/api/**", 80), ("**/routes/**", 78), ("**/handlers/**", 78), ("**/middleware/**", 76), ("*handler*", 75), ("*endpoint*", 75), ("*parse*", 72), ("*input*", 70), ("*valid*", 70), ("*sanitize*", 70), ("Dockerfile", 65), ("docker-compose*.yml", 65), ("*.yaml", 55), ("*.yml", 55), ("*.rs", 45), ("*.py", 45), ("*.js", 40), ("*.ts", 40), ("tests/**", 35), ("test/**", 35)], 25),
    "onboarding": ([("README.md", 100), ("CONTRIBUTING.md", 98), ("CLAUDE.md", 97), ("CHANGELOG.md", 95), ("*.md", 90), ("Cargo.toml", 88), ("package.json", 88), ("pyproject.toml", 88), ("Makefile", 85), ("Dockerfile", 80), ("**/main.rs", 75), ("**/lib.rs", 75), ("**/main.py", 75), ("**/index.js", 75), ("**/index.ts", 75), ("**/mod.rs", 70), ("*.toml", 65), ("*.yaml", 60), ("*.yml", 60), ("*.json", 55), ("tests/**", 40), ("test/**", 40), ("*.rs", 35), ("*.py", 35), ("*.js", 30), ("*.ts", 30)], 20),
}
# What else a lens sets: excluded and included patterns, lines to keep, how, and the order of files.
LENS_RULES: dict[str, dict] = {
    "architecture": {"exclude": ["tests/**", "test/**", "docs/**", "doc/**", "htmlcov/**", "coverage.xml", "*.html", "*.css", "CONTEXT.txt", "*.txt", "test_vectors/**", "research/**", "LLM/**", "target/**", "dist/**", "scripts/**", ".github/**"], "include": ["*.py", "*.js", "*.ts", "*.rs", "*.json", "*.toml", "*.yaml", "*.yml", "Dockerfile", "Makefile", "README.md"], "truncate": 2000, "mode": "structure", "sort": ("path", "asc")},
    "debug": {"exclude": ["*.pyc", "__pycache__", ".git"], "include": [], "truncate": 0, "mode": "simple", "sort": ("mtime", "desc")},
    "security": {"exclude": ["docs/**", "doc/**", "*.md", "*.txt", "htmlcov/**", "coverage/**"], "include": ["**/*auth*", "**/*security*", "**/*secret*", "**/*credential*", "package.json", "requirements.txt", "Cargo.toml", "Dockerfile"], "truncate": 0, "mode": "simple", "sort": ("path", "asc")},
    "onboarding": {"exclude": ["target/**", "dist/**", "node_modules/**", ".git/**", "*.lock", "*.min.js"], "include": ["README.md", "CONTRIBUTING.md", "LICENSE", "CHANGELOG.md", "**/main.py", "**/index.js", "package.json", "Cargo.toml", "Makefile", "Dockerfile"], "truncate": 500, "mode": "simple", "sort": ("path", "asc")},
}
# Groups whose files a lens reduces to their structure before they are costed.
STRUCTURED = {"architecture": ["*.py", "rust/src/**/*.rs", "**/*.rs"]}
# Ordered rules of concept inference over lower-case names; the first that holds wins.
NAME_RULES: list[tuple[str, str]] = [
    ("testing", r"^test_|_test$|_spec|_tests"),
    ("error_handling", r"handle_error|on_error|_error|recover|^err_|_err$"),
    ("validation", r"validate|check_|is_valid|^is_|^has_|verify|ensure"),
    ("logging", r"^log_|logger|_log|trace|debug_|metric|telemetry"),
    ("configuration", r"^config|_config|settings|options|params|builder|_opts$"),
    ("calculation", r"calculate|compute|_total|_sum|_avg|_count|score|_price|_cost|estimate|eval"),
    ("transformation", r"transform|convert|map_|_to_|into_|from_|parse|serialize|deserialize|encode|decode"),
    ("decision", r"decide|route|dispatch|should_|select|choose|pick|match_|filter|when_|^(?:main|run|start|execute|process)$|^handle_"),
    ("infrastructure", r"connect|socket|http|network|database|db_|file_|fs_|io_|read_file|write_file|send_|recv_|fetch"),
]
# Words of the documentation that decide where the name did not.
DOC_RULES: list[tuple[str, str]] = [
    ("calculation", "calculate|compute|score"), ("validation", "validate|check|verify"), ("transformation", "transform|convert|parse"),
    ("error_handling", "error|handle|recover"), ("configuration", "config|setting|option"), ("decision", "entry point|main|start"),
]
# For each intent the concept weights, boosts, thresholds of the reading decision, and bounds of a plan.
CONCEPTS = ["calculation", "validation", "decision", "transformation", "error_handling", "logging", "configuration", "infrastructure", "testing", "unknown"]
INTENTS: dict[str, dict] = {
    "business_logic": {"weights": [1.0, 0.9, 0.85, 0.7, 0.4, 0.1, 0.2, 0.2, 0.05, 0.5], "doc": 0.15, "public": 0.1, "skip": 0.3, "deep": 0.7, "most": 25, "minutes": 30, "least": 0.3},
    "debugging": {"weights": [0.5, 0.7, 0.6, 0.5, 1.0, 0.9, 0.4, 0.3, 0.2, 0.4], "doc": 0.1, "public": 0.05, "skip": 0.2, "deep": 0.6, "most": 30, "minutes": 45, "least": 0.2},
    "onboarding": {"weights": [0.8, 0.6, 1.0, 0.5, 0.4, 0.2, 0.7, 0.3, 0.3, 0.4], "doc": 0.25, "public": 0.15, "skip": 0.2, "deep": 0.5, "most": 25, "minutes": 60, "least": 0.3},
    "security_review": {"weights": [0.4, 1.0, 0.6, 0.5, 0.9, 0.3, 0.8, 0.7, 0.1, 0.5], "doc": 0.1, "public": 0.15, "skip": 0.3, "deep": 0.7, "most": 40, "minutes": 60, "least": 0.3},
    "migration": {"weights": [0.4, 0.5, 0.4, 0.6, 0.7, 0.3, 0.9, 1.0, 0.1, 0.5], "doc": 0.1, "public": 0.1, "skip": 0.2, "deep": 0.6, "most": 50, "minutes": 90, "least": 0.2},
}
# Names of manifests, and patterns of test and core paths.
MANIFESTS = ["cargo.toml", "package.json", "pyproject.toml", "setup.py", "go.mod", "pom.xml", "build.gradle", "composer.json", "gemfile", "requirements.txt", "pipfile"]
TEST_PATH = r"(?:^|/)(?:tests|test|examples|benches)/|(?:^|/)test_[^/]*$|_test\.(?:py|rs|go)$|\.(?:test|spec)\.(?:js|ts)$"
CORE_PATH = r"(?:^|/)(?:src|lib|pkg|internal|app|core)/"


def tier(path: Column) -> Column:
    """config, tests, core or other, from the path; JSON below a test folder is no configuration."""
    p = F.lower(path)
    config = F.regexp_extract(p, r"([^/]*)$", 1).isin(MANIFESTS) | F.rlike(p, F.lit(r"/configs?/|\.(?:toml|yaml|yml)$")) | (F.endswith(p, F.lit(".json")) & ~F.contains(p, F.lit("/test")))
    return F.when(config, "config").when(F.rlike(p, F.lit(TEST_PATH)), "tests").when(F.rlike(p, F.lit(CORE_PATH)), "core").otherwise("other")


def tier_rank(t: Column) -> Column:
    return F.when(t == "core", 0).when(t == "config", 1).when(t == "tests", 2).otherwise(3)


def lens_priority(path: Column, lens: str) -> Column:
    """Greatest priority over the lens groups that match, else its fallback."""
    groups, fallback = LENSES[lens]
    hits = [F.when(lens_glob(path, pattern), F.lit(priority)) for pattern, priority in groups]
    return F.coalesce(F.greatest(*hits), F.lit(fallback)).cast("int")


def structured(path: Column, lens: str) -> Column:
    """Does the group of greatest priority reduce the file to its structure (the first of equals decides)."""
    groups, _ = LENSES[lens]
    out = F.lit(False)
    for pattern, _ in sorted(reversed(groups), key=lambda g: g[1]):
        # of equal priorities the first listed is asked last, and so wins
        out = F.when(lens_glob(path, pattern), F.lit(pattern in STRUCTURED.get(lens, []))).otherwise(out)
    return out


def lens_keeps(path: Column, lens: str) -> Column:
    """The inclusion rule with the lens's patterns: excluded ones never; its whitelist counts while it excludes nothing."""
    rule = LENS_RULES[lens]
    return included(path, rule["exclude"], rule["include"])


def drift_class(rate: Column) -> Column:
    return F.when(rate.isNull(), "none").when(rate < 10, "minimal").when(rate < 25, "low").when(rate < 50, "moderate").when(rate < 75, "high").otherwise("extreme")


def life_cycle(is_new: Column, is_ancient: Column, new: Column, ancient: Column, active: Column) -> Column:
    return F.when(is_new, "newborn").when(is_ancient, "ancient").when(new > ancient, "growing").when(active > 0, "active").otherwise("dormant")


def blend(static: Column, learned: Column) -> Column:
    """Static priority and learned utility (0 to 1, 0.5 when unknown), 70 to 30."""
    return F.round(static * 0.7 + F.coalesce(learned, F.lit(0.5)) * 100 * 0.3).cast("bigint")


def age_class(days: Column) -> Column:
    return F.when(days < 30, "newborn").when(days < 365, "young").when(days < 730, "mature").otherwise("ancient")


def churn_class(n30: Column, n90: Column) -> Column:
    return F.when(n30 > 30, "supernova").when(n90 > 10, "high").when(n90 > 3, "moderate").when(n90 > 0, "low").otherwise("dormant")


def health_score(debt: Column, volcanic: Column, doc_ratio: Column, density: Column) -> Column:
    """1 less debt (at most .3), deep nesting (at most .2), thin documentation and crowding."""
    doc = F.when(doc_ratio < 0.1, 0.2).when(doc_ratio < 0.3, 0.1).otherwise(0.0)
    crowd = F.when(density > 50, 0.15).when(density > 30, 0.05).otherwise(0.0)
    score = 1 - F.least(debt, F.lit(0.3)) - F.least(0.05 * volcanic, F.lit(0.2)) - doc - crowd
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def health_rating(debt: Column, unknown: Column, volcanic: Column, doc_ratio: Column, density: Column) -> Column:
    return (
        F.when((debt > 0.1) & (doc_ratio < 0.1), "critical")
        .when((unknown > 0) | (volcanic > 3) | (debt > 0.05), "high_debt")
        .when((doc_ratio >= 0.2) & (density <= 30), "healthy")
        .otherwise("stable")
    )


def concept(name: Column, kind: Column, documentation: Column, visibility: Column) -> Column:
    """Concept of a symbol: name rules, documentation rules, then defaults by kind."""
    n, d, k = F.lower(name), F.lower(F.coalesce(documentation, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    out = F.when(k.isin("struct", "class"), "transformation").when(k.isin("trait", "interface", "enum"), "decision").when(k == "constant", "configuration")
    out = out.when(k.isin("function", "method"), F.when(visibility == "public", "calculation").otherwise("infrastructure")).otherwise("unknown")
    for label, words in reversed(DOC_RULES):
        out = F.when(F.rlike(d, F.lit(words)), label).otherwise(out)
    for label, words in reversed(NAME_RULES):
        out = F.when(F.rlike(n, F.lit(words)), label).otherwise(out)
    return out


def relevance(kind: Column, doc: Column, visibility: Column, lines: Column, name: Column, intent: str = "business_logic") -> Column:
    """Weighted concept, documentation, visibility, length and name clarity, from 0 to 1."""
    rule = INTENTS[intent]
    weight = F.lit(0.3)
    for label, w in zip(CONCEPTS, rule["weights"]):
        weight = F.when(kind == label, w).otherwise(weight)
    documented = F.when(doc.isNull(), 0.0).when(F.octet_length(doc) > 50, rule["doc"]).otherwise(rule["doc"] / 2)
    seen = F.when(F.coalesce(visibility, F.lit("")) == "public", rule["public"]).otherwise(-0.05)
    size = F.when(lines < 5, -0.1).when(lines <= 30, 0.1).when(lines <= 100, 0.0).otherwise(-0.1)
    length = F.octet_length(name)
    clear = F.when(length < 4, -0.05).when((length <= 30) & F.rlike(name, F.lit("[_A-Z]")), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * weight + documented + seen + size + clear))


def intent_decision(score: Column, complexity: Column, centrality: Column, intent: str) -> Column:
    """skip, bookmark, read or skim by the intent's thresholds; what is complex and not central waits."""
    rule = INTENTS[intent]
    hard = complexity > 0.7
    return (
        F.when(hard & (score < rule["skip"]), "skip")
        .when(hard & (score > rule["deep"]) & (centrality < 0.3), "bookmark")
        .when(score < rule["skip"], "skip")
        .when(score >= rule["deep"], "read")
        .otherwise("skim")
    )


def reading_decision(score: Column) -> Column:
    return F.when(score > 0.7, "read").when(score > 0.4, "skim").otherwise("skip")


def match_confidence(score: Column) -> Column:
    return F.when(score > 0.85, "high").when(score > 0.7, "medium").otherwise("low")


def attention(priority: Column, utility: Column, dropped: Column) -> Column:
    return F.when(dropped, "cold").when((priority >= 95) | (utility > 0.8), "critical").when(priority >= 80, "high").otherwise("normal")


def brightness(utility: Column) -> Column:
    return F.when(utility >= 0.9, "brilliant").when(utility >= 0.8, "bright").when(utility >= 0.5, "steady").otherwise("dim")
