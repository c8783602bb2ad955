"""Fixed values of the findings model and the small tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities from least to most (fixed values).
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Categories of findings (fixed values).
CATEGORIES = ("bug", "documentation", "maintainability", "performance", "security", "style", "typing")
#: Points per severity in the quality score, the complexity at which a function counts, its weight, and the grades' lower ends (fixed values).
WEIGHTS = {"critical": 25, "high": 10, "medium": 4, "low": 1, "info": 0}
COMPLEX_AT, COMPLEXITY_WEIGHT = 21, 20.0
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
#: Sources that are models; all others are tools (fixed values).
MODELS = ("nvidia", "gemini", "hf-large", "hf-small", "local")
#: Statuses that are reported, and the confidence under which findings of models alone are hidden (fixed values).
REPORTED = ("open", "needs_review", "accepted")
LEAST_CONFIDENCE = 0.6
#: Rule families that are about formatting only (fixed values).
FORMATTING = ("E1", "E2", "E3", "E5", "W", "I", "Q", "COM")
#: (prefix of a lint rule, category, severity); the longest prefix decides, else style and low (fixed values).
RULE_PREFIXES = (
    ("F821", "bug", "high"), ("F401", "maintainability", "low"), ("F841", "maintainability", "low"), ("E722", "bug", "medium"), ("E9", "bug", "high"), ("F", "bug", "medium"), ("B", "bug", "medium"),
    ("PERF", "performance", "low"), ("C4", "maintainability", "low"), ("SIM", "maintainability", "low"), ("UP", "maintainability", "low"), ("RET", "maintainability", "low"), ("W", "style", "info"), ("E", "style", "low"), ("N", "style", "low"),
)
#: (tool, rule, kind of issue): rules of different tools for one kind of issue (fixed values).
EQUIVALENT_RULES = (
    ("ruff", "F401", "unused-import"), ("vulture", "unused-import", "unused-import"), ("ruff", "F841", "unused-variable"), ("vulture", "unused-variable", "unused-variable"),
    ("bandit", "B105", "hardcoded-credential"), ("bandit", "B106", "hardcoded-credential"), ("bandit", "B107", "hardcoded-credential"),
    ("opengrep", "python-shell-command-from-dynamic-input", "shell-injection"), ("bandit", "B602", "shell-injection"), ("bandit", "B605", "shell-injection"),
    ("opengrep", "python-sql-built-with-string-formatting", "sql-injection"), ("bandit", "B608", "sql-injection"),
    ("opengrep", "python-yaml-load-without-safe-loader", "unsafe-yaml-load"), ("bandit", "B506", "unsafe-yaml-load"),
    ("opengrep", "python-tls-certificate-verification-disabled", "tls-verification-off"), ("bandit", "B501", "tls-verification-off"),
    ("opengrep", "python-web-debug-mode-enabled", "debug-mode"), ("bandit", "B201", "debug-mode"),
    ("opengrep", "python-insecure-random-for-secret", "insecure-random"), ("bandit", "B311", "insecure-random"),
    ("opengrep", "python-password-hashed-with-fast-hash", "weak-hash"), ("bandit", "B324", "weak-hash"),
    ("opengrep", "python-insecure-temporary-file", "insecure-temp-file"), ("bandit", "B306", "insecure-temp-file"),
    ("opengrep", "python-eval-of-dynamic-value", "dynamic-eval"), ("bandit", "B307", "dynamic-eval"),
    ("radon", "cyclomatic-complexity", "complexity"), ("lizard", "function-complexity", "complexity"),
)
#: Severity of a security test's (severity, confidence); other pairs are low (fixed values).
TEST_SEVERITY = (("HIGH", "HIGH", "high"), ("HIGH", "MEDIUM", "medium"), ("MEDIUM", "HIGH", "medium"), ("MEDIUM", "MEDIUM", "medium"))
#: Directories, file names and endings that are skipped when sources are read (fixed values).
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "venv", ".venv", "site-packages", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "dist", "build", ".next", ".nuxt", "coverage",
    "htmlcov", ".idea", ".vscode",
)
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "pdm.lock", "pipfile.lock", "uv.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum",
)
GENERATED_SUFFIXES = (".min.js", ".min.mjs", ".min.css", ".js.map", ".css.map")
MAX_FILES, MAX_TOTAL_BYTES, MAX_FILE_BYTES, SNIFF_BYTES, MAX_RATIO = 2_000, 80_000_000, 1_000_000, 8192, 100
#: Directories and endings of test files (fixed values).
TEST_DIRS = ("test", "tests", "testing", "spec", "specs", "__tests__", "testdata", "fixture", "fixtures")
TEST_SUFFIXES = ("_test", ".test", "_spec", ".spec")
#: Languages by extension and interpreter (fixed values).
LANGUAGES = {
    "python": ((".py", ".pyi"), ("python",)), "javascript": ((".js", ".jsx", ".mjs", ".cjs"), ("node",)), "typescript": ((".ts", ".mts", ".cts"), ()),
    "tsx": ((".tsx",), ()), "java": ((".java",), ()), "go": ((".go",), ()),
}


def severity_rank(severity: Column) -> Column:
    """0 for info to 4 for critical, null for other values."""
    out = F.when(severity == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == s, i)
    return out


def literal_table(spark: SparkSession, rows: tuple, schema: str) -> DataFrame:
    """A table of a few fixed rows, marked for broadcast: its size is that of the constants above."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))
