"""Extension points: analysers of files and responders to requests, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDINGS = "repository string, file_path string, tool string, rule_id string, start_line int, end_line int, title string"


class Analyser(Protocol):
    """A name, the extensions it reads, and (rule, first line, last line, title) of a text."""

    name: str
    extensions: tuple[str, ...]

    def analyse(self, text: str) -> list[tuple[str, int, int, str]]: ...


def run_analysers(files: DataFrame, *analysers: Analyser) -> DataFrame:
    """Findings of all analysers in one pass over (repository, file_path, content); an analyser that fails on a file gives a finding of the rule `failed`."""
    rows = files.filter("content is not null").select("repository", "file_path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for a in analysers:
                    if not r.file_path.lower().endswith(a.extensions):
                        continue
                    try:
                        out += [(r.repository, r.file_path, a.name, rule, s, max(s, e), title) for rule, s, e, title in a.analyse(r.content)]
                    except Exception as error:  # a tool's failure is a result, not the end of the scan
                        out.append((r.repository, r.file_path, a.name, "failed", 1, 1, str(error)[:80]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return rows.mapInPandas(run, FINDINGS)


class TodoComments:
    """A sample analyser: comments that say TODO."""

    name, extensions = "todo", (".py", ".js", ".ts", ".tsx", ".go", ".java")

    def analyse(self, text: str) -> list[tuple[str, int, int, str]]:
        return [("todo", i, i, s.strip()[:80]) for i, s in enumerate(text.split("\n"), 1) if s.lstrip().startswith(("#", "//", "*")) and "TODO" in s]


def respond(requests: DataFrame, responder: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """Adds `answer`, `input_tokens` and `output_tokens` of a deterministic responder: characters over 3.5, and a quarter of them, at least 1."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else responder(p))

    rows = requests.withColumn("answer", ask(column))
    return rows.withColumn("input_tokens", F.ceil(F.length(column) / 3.5)).withColumn("output_tokens", F.greatest(F.lit(1), F.floor(F.length("answer") / 4)))
