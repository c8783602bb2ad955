"""larkspur: Spark-first analytics over code-review findings, model calls and training text."""

__version__ = "0.1.0"
