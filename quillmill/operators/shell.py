"""Shell scripts: what they are for, in which dialect, and as a vector of twelve positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of scripts in the order of their vector; what each pattern found adds, the confidence
# that must be exceeded, and the patterns.
CLASSES: list[tuple[str, float, float, list[str]]] = [
    ("deployment", 0.2, 0.3, [r"(?i)docker\s+(?:build|push|pull|run|compose)", r"(?i)kubectl\s+(?:apply|delete|rollout|get|describe)", r"(?i)helm\s+(?:install|upgrade|uninstall|template)", r"(?i)terraform\s+(?:apply|plan|destroy|init)", r"(?i)ansible(?:-playbook)?", r"(?i)aws\s+(?:s3|ec2|ecs|lambda|deploy)", r"(?i)gcloud\s+(?:deploy|run)", r"(?i)az\s+(?:webapp|functionapp|container)", r"(?i)(?:deploy|release|rollout|publish)\s+"]),
    ("error_handling", 0.25, 0.3, [r"set\s+-[euo]+", r"set\s+-o\s+(?:errexit|nounset|pipefail)", r"trap\s+['\"].*?['\"]\s+(?:EXIT|ERR|INT|TERM)", r"\|\|\s*(?:exit|return|die|fatal)", r"if\s+\[\s*\$\?\s*-ne\s*0\s*\]", r"(?i)(?:handle|catch|recover).*error"]),
    ("data_processing", 0.15, 0.2, [r"(?i)\bawk\s+", r"(?i)\bsed\s+", r"(?i)\bjq\s+", r"(?i)\bgrep\s+", r"(?i)\bcut\s+", r"(?i)\bsort\s+", r"(?i)\buniq\s+", r"(?i)\bxargs\s+", r"(?i)\btr\s+", r"\|\s*while\s+read"]),
    ("automation", 0.25, 0.3, [r"(?i)cron(?:tab)?", r"#\s*@(?:hourly|daily|weekly|monthly|yearly)", r"\d+\s+\d+\s+\*\s+\*\s+\*", r"(?i)systemd|systemctl", r"(?i)\bat\s+", r"(?i)\bwatch\s+", r"while\s+true\s*;?\s*do", r"(?i)schedule|scheduled"]),
    ("backup", 0.25, 0.3, [r"(?i)\btar\s+[a-z]*[czx]", r"(?i)\brsync\s+", r"(?i)\bcp\s+-[ra]", r"(?i)\bdd\s+", r"(?i)(?:backup|bak|snapshot|archive)", r"(?i)pg_dump|mysqldump|mongodump"]),
    ("monitoring", 0.2, 0.3, [r"(?i)\blog\s", r"(?i)logger\s+", r"(?i)syslog", r"(?i)(?:prometheus|grafana|datadog|newrelic)", r"(?i)health.*check", r"(?i)(?:alert|notify|slack|email)", r"(?i)\btop\s|\bhtop\s|\bvmstat\s"]),
    ("testing", 0.2, 0.3, [r"(?i)\btest\s+", r"(?i)(?:pytest|jest|mocha|rspec|unittest)", r"(?i)assert|expect", r"(?i)mock|stub|fake", r"(?i)(?:integration|unit|e2e).*test", r"\[\s*-[a-z]\s+"]),
    ("build", 0.2, 0.3, [r"(?i)\bmake\s+", r"(?i)\bcmake\s+", r"(?i)\bcargo\s+(?:build|test|run)", r"(?i)\bnpm\s+(?:run|build|install)", r"(?i)\byarn\s+(?:build|install)", r"(?i)\bgo\s+(?:build|test)", r"(?i)\bmvn\s+", r"(?i)\bgradle\s+", r"(?i)(?:compile|build|package)"]),
    ("cleanup", 0.25, 0.3, [r"(?i)\brm\s+-[rf]+", r"(?i)\bfind\s+.*-delete", r"(?i)(?:cleanup|clean|purge|prune)", r"(?i)docker\s+(?:system\s+)?prune", r"(?i)apt(?:-get)?\s+autoremove"]),
    ("setup", 0.2, 0.3, [r"(?i)(?:init|setup|install|bootstrap)", r"(?i)apt(?:-get)?\s+install", r"(?i)yum\s+install", r"(?i)pip\s+install", r"(?i)npm\s+install", r"(?i)\bmkdir\s+", r"(?i)configure"]),
    ("network", 0.2, 0.3, [r"(?i)\bcurl\s+", r"(?i)\bwget\s+", r"(?i)\bssh\s+", r"(?i)\bscp\s+", r"(?i)\bnetstat\s+|\bss\s+", r"(?i)\bping\s+", r"(?i)\bnc\s+|\bnetcat\s+", r"(?i)iptables|firewall"]),
    ("security", 0.2, 0.3, [r"(?i)\bchmod\s+", r"(?i)\bchown\s+", r"(?i)ssl|tls|certificate", r"(?i)\bgpg\s+|\bopenssl\s+", r"(?i)password|secret|credential", r"(?i)\bsudo\s+"]),
]


# Names whose mention adds a tenth to deployment.
TOOLS = ["docker", "kubectl", "helm", "terraform", "ansible", "aws", "gcloud", "az", "jenkins", "github", "gitlab"]


def confidence(content: Column, step: float, above: float, patterns: list[str]) -> Column:
    """Hundredths of confidence of a class, 0 unless it is exceeded: a step for each pattern that occurs."""
    hits = reduce(lambda a, b: a + b, [F.rlike(content, F.lit(p)).cast("int") for p in patterns])
    points = hits * round(step * 100)
    if patterns is CLASSES[0][3]:
        points = points + 10 * reduce(lambda a, b: a + b, [F.contains(F.lower(content), F.lit(t)).cast("int") for t in TOOLS])
    return F.when(points > round(above * 100), F.least(points, F.lit(100))).otherwise(0)


def vector(content: Column) -> Column:
    """``ARRAY<DOUBLE>`` of twelve confidences in the order of the classes."""
    return F.array(*[confidence(content, step, above, patterns) / 100.0 for _, step, above, patterns in CLASSES])


def primary(content: Column) -> Column:
    """The class of greatest confidence, the first of equals; ``unknown`` where none is exceeded."""
    best = F.greatest(*[confidence(content, *rest) for _, *rest in CLASSES])
    out = F.lit("unknown")
    for name, *rest in reversed(CLASSES):
        out = F.when((best > 0) & (confidence(content, *rest) == best), name).otherwise(out)
    return out


def dialect(content: Column) -> Column:
    """Dialect by the first line where it names an interpreter: bash, zsh, ksh, fish, else sh."""
    first = F.lower(F.regexp_extract(content, r"^(#![^\n]*)", 1))
    out = F.lit("sh")
    for name in ("fish", "ksh", "zsh", "bash"):
        out = F.when(F.contains(first, F.lit(name)), name).otherwise(out)
    return out
