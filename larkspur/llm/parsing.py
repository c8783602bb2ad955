"""Source files that do not parse in their language, by packrat grammars.

A file is valid if the grammar of its language consumes all of it. For an invalid one the furthest failure's line, what was
wanted there and a cause are reported. Nothing of another file is needed, so the text never leaves the partition
it was read in; only verdicts are grouped.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.syntax.packrat import Grammar

_CONFLICT = re.compile(r"(?m)^(<{7}|>{7})( \S|$)")
#: Calls that the engine nests (hundreds of thousands of brackets in each other). A file beyond it gets no verdict but the cause "nested too deep".
DEPTH = 4_000_000
_PACKAGE = re.compile(r"(?:\s|;|//[^\n]*|/\*(?s:.*?)\*/)*package\b")


def languages() -> dict[str, tuple[Callable[..., str], Grammar]]:
    """Lexer and grammar per language; a lexer's second argument receives the place in the text of each class."""
    from larkspur.llm.syntax import go_grammar, java_grammar, python_grammar, script_grammar

    return {
        "python": (python_grammar.lex, python_grammar.PYTHON),
        "java": (java_grammar.lex, java_grammar.JAVA),
        "go": (go_grammar.lex, go_grammar.GO),
        "javascript": (functools.partial(script_grammar.lex, dialect="ts"), script_grammar.JAVASCRIPT),
        "typescript": (functools.partial(script_grammar.lex, dialect="ts"), script_grammar.TYPESCRIPT),
        "tsx": (functools.partial(script_grammar.lex, dialect="tsx"), script_grammar.TYPESCRIPT),
    }


def normalised(content: str) -> str:
    """Without a byte-order mark, with \\n for every line end."""
    return content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def is_valid(content: str, language: str, table: dict | None = None) -> bool | None:
    """Whether `content` parses; None for a language without a grammar or if nested beyond `DEPTH`. Empty and blank files are valid."""
    table = table or languages()
    if language not in table:
        return None
    text = normalised(content)
    if not text.strip():
        return True
    lex, grammar = table[language]
    try:
        return grammar.accepts(lex(text))
    except RecursionError:
        return None


def explain(content: str, language: str, table: dict | None = None) -> tuple[int | None, str, str]:
    """(line of the furthest failure, cause, what was wanted there) of a file that is not valid."""
    table = table or languages()
    lex, grammar = table[language]
    text = normalised(content)
    places: list[int] = []
    try:
        s = lex(text, at=places)
        far, wanted = grammar.failure(s)
    except RecursionError:
        return None, "nested too deep", ""
    line = text.count("\n", 0, places[far]) + 1 if far < len(places) else len(text.split("\n"))
    if _CONFLICT.search(text):
        cause = "merge conflict"
    elif far >= len(s):
        cause = "truncated"
    elif other := _other(text, language, table):
        cause = f"is {other}"
    elif s[far] == "\x00":
        cause = "bad token"
    else:
        cause = "unexpected token"
    return line, cause, " ".join(wanted[:8]).replace("\n", "end of line")


def _other(text: str, language: str, table: dict) -> str | None:
    """A language in which the text is valid, if there is one. Go needs a package clause at its start, and what is no tsx by its marks is lexed as TypeScript once."""
    lexed: dict[object, str] = {}
    for other, (lex, grammar) in table.items():
        if other == language or {other, language} == {"typescript", "tsx"} or (other == "go" and not _PACKAGE.match(text)):
            continue
        key = (lex.func, lex.keywords["dialect"]) if isinstance(lex, functools.partial) else lex
        try:
            if key not in lexed:
                lexed[key] = lex(text)
            if grammar.accepts(lexed[key]):
                return other
        except RecursionError:
            continue
    return None


def verdicts(source: DataFrame) -> DataFrame:
    """(file_id, repository, file_language, valid, fail_line, cause, wanted): one row per row of `source`.

    Null content and languages without a grammar have valid null; empty texts are valid. `partial_regions` is not read: it is
    from an older run and not always right.
    """
    rows = source.select("file_id", "repository", F.lower("file_language").alias("file_language"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        table = languages()
        for batch in batches:
            out = []
            for content, language in zip(batch["content"], batch["file_language"]):
                ok = is_valid(content, language, table) if isinstance(content, str) else None
                why = explain(content, language, table) if ok is False else (None, None, None)
                if ok is None and isinstance(content, str) and language in table:
                    why = (None, "nested too deep", None)
                out.append((ok, *why))
            found = pd.DataFrame(out, columns=["valid", "fail_line", "cause", "wanted"], dtype=object)
            found["fail_line"] = found["fail_line"].astype("Int32")
            found["valid"] = found["valid"].astype("boolean")
            yield pd.concat([batch[["file_id", "repository", "file_language"]].reset_index(drop=True), found], axis=1)

    return rows.mapInPandas(
        run, "file_id bigint, repository string, file_language string, valid boolean, fail_line int, cause string, wanted string"
    )


def invalid(source: DataFrame) -> DataFrame:
    """(file_id) of files that do not parse, each once."""
    return verdicts(source).filter("not valid and file_id is not null").select("file_id").distinct()


def rates(source: DataFrame) -> DataFrame:
    """(repository, file_language, n_files, n_invalid, invalid_share, n_conflicts) of files with a verdict; null repository or language in a total's row means all.

    A file_id with several rows counts once, as invalid if any is.
    """
    once = verdicts(source).filter("valid is not null").groupBy("file_id", "repository", "file_language").agg(
        F.max((~F.col("valid")).cast("int")).alias("bad"), F.max((F.coalesce("cause", F.lit("")) == "merge conflict").cast("int")).alias("conflict")
    )
    return once.rollup("repository", "file_language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bad").cast("long").alias("n_invalid"), F.round(F.avg("bad"), 6).alias("invalid_share"), F.sum("conflict").cast("long").alias("n_conflicts")
    )
