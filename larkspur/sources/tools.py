"""Outputs of analysis tools as findings: parsed in the JVM, broken lines dropped or kept as nulls as each tool demands."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C

_LINT = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>,end_location:struct<row:int,column:int>>>"
_SECURITY = "struct<results:array<struct<test_id:string,issue_text:string,filename:string,line_number:int,col_offset:int,line_range:array<int>,issue_severity:string,issue_confidence:string>>>"
_TYPES = "struct<file:string,line:int,column:int,message:string,code:string,severity:string>"


def lint(outputs: DataFrame) -> DataFrame:
    """A linter's JSON array (column `output`) as findings; a rule is letters and digits, else it is a syntax error."""
    rows = outputs.select(F.explode(F.from_json("output", _LINT)).alias("r"))
    rule = F.when(F.col("r.code").rlike("^[A-Z]+[0-9]+$"), F.col("r.code"))
    flat = rows.select(
        F.col("r.filename").alias("file_path"), rule.alias("rule_id"), F.col("r.location.row").alias("start_line"), F.greatest("r.end_location.row", "r.location.row").alias("end_line"), F.col("r.location.column").alias("start_column"),
        F.when(F.col("r.end_location.row") == F.col("r.location.row"), F.col("r.end_location.column")).alias("end_column"), C.shorten(F.col("r.message")).alias("title"), F.lit(1.0).alias("confidence"), F.array(F.lit("ruff")).alias("sources"),
    )
    return classify(flat)


def classify(rows: DataFrame) -> DataFrame:
    """Adds category and severity of a lint rule by its longest known prefix; style and low without one, bug and medium without a rule."""
    prefixes = D.literal_table(rows.sparkSession, D.RULE_PREFIXES, "prefix string, category string, severity string")
    rules = rows.select("rule_id").filter("rule_id is not null").distinct()
    best = rules.join(prefixes, F.startswith("rule_id", "prefix")).groupBy("rule_id").agg(F.max_by(F.struct("category", "severity"), F.length("prefix")).alias("c"))
    joined = rows.join(best, "rule_id", "left")
    none = F.col("rule_id").isNull()
    return joined.withColumn("category", F.when(none, "bug").otherwise(F.coalesce("c.category", F.lit("style")))).withColumn("severity", F.when(none, "medium").otherwise(F.coalesce("c.severity", F.lit("low")))).drop("c")


def security(outputs: DataFrame) -> DataFrame:
    """A security scanner's JSON object as findings; severity by the pair of its severity and confidence."""
    pairs = D.literal_table(outputs.sparkSession, D.TEST_SEVERITY, "s string, c string, severity string")
    rows = outputs.select(F.explode(F.from_json("output", _SECURITY)["results"]).alias("r")).select("r.*")
    joined = rows.join(pairs, (F.col("issue_severity") == F.col("s")) & (F.col("issue_confidence") == F.col("c")), "left")
    password = F.col("test_id").isin("B105", "B106", "B107")
    return joined.select(
        F.col("filename").alias("file_path"), F.col("test_id").alias("rule_id"), F.col("line_number").alias("start_line"), F.coalesce(F.array_max("line_range"), "line_number").alias("end_line"), (F.col("col_offset") + 1).alias("start_column"),
        F.when(password, "Possible hard-coded password").otherwise(C.shorten(F.col("issue_text"))).alias("title"), F.coalesce("severity", F.lit("low")).alias("severity"), F.lit("security").alias("category"), F.array(F.lit("bandit")).alias("sources"),
    )


def types(outputs: DataFrame) -> DataFrame:
    """A type checker's JSON lines as findings: errors with a line."""
    rows = outputs.select(F.explode(F.split("output", "\n")).alias("l")).filter("trim(l) != ''").select(F.from_json("l", _TYPES).alias("r")).select("r.*")
    return rows.filter("severity = 'error' and line >= 1").select(F.col("file").alias("file_path"), F.col("code").alias("rule_id"), F.col("line").alias("start_line"), C.shorten(F.col("message")).alias("title"))


def dead_code(outputs: DataFrame) -> DataFrame:
    """Lines `file:n: unused kind 'name' (90% confidence, 3 lines)` as findings; other lines are dropped."""
    pattern = r"^(.+?):(\d+): unused ([a-z ]+?) '(.+?)' \((\d+)% confidence(?:, (\d+) lines?)?\)$"
    part = lambda i: F.regexp_extract("l", pattern, i)
    rows = outputs.select(F.explode(F.split("output", "\n")).alias("l")).filter(F.col("l").rlike(pattern))
    start = part(2).cast("int")
    return rows.select(
        part(1).alias("file_path"), start.alias("start_line"), (start + F.coalesce(F.nullif(part(6), F.lit("")).cast("int"), F.lit(1)) - 1).alias("end_line"), F.concat(F.lit("unused-"), F.replace(part(3), F.lit(" "), F.lit("-"))).alias("rule_id"), (part(5).cast("int") / 100).alias("confidence")
    )


def function_findings(metrics: DataFrame) -> DataFrame:
    """(file_path, start_line, rule_id) for functions that are complex (over 15, not Python), long (over 80 lines) or take over 6 parameters."""
    hits = F.array(
        F.struct(F.lit("function-complexity").alias("rule_id"), ((F.col("complexity") > 15) & ~F.col("file_path").endswith(".py")).alias("hit")),
        F.struct(F.lit("long-function").alias("rule_id"), (F.col("n_lines") > 80).alias("hit")), F.struct(F.lit("too-many-parameters").alias("rule_id"), (F.col("parameters") > 6).alias("hit")),
    )
    return metrics.select("file_path", "start_line", F.explode(F.filter(hits, lambda h: h["hit"])).alias("h")).select("file_path", "start_line", "h.rule_id")


def merge_metrics(metrics: DataFrame, fields: list[str]) -> DataFrame:
    """One row per file of several tools' metrics: each field's last value that is not null, in the order of `ord`."""
    return metrics.groupBy("file_path").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields])


def relative_path(path: Column, root: str) -> Column:
    """A reported path below the root, or null."""
    base = root.rstrip("/") + "/"
    p = F.regexp_replace(path, r"^\./", "")
    return F.when(p.startswith(base), F.substring(p, len(base) + 1, 4096)).when(~p.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."), p)


def _relative(path: Column, root: str | None) -> Column:
    return path if root is None else relative_path(path, root)


#: Severity of a complexity rank (fixed values); better ranks give no finding.
RANK_SEVERITY = {"D": "low", "E": "medium", "F": "medium"}
#: Maintainability index under which a file is reported.
LOW_MAINTAINABILITY = 20.0
_BLOCK = "struct<type:string,name:string,complexity:int,rank:string,lineno:int,endline:int,methods:array<string>,closures:array<string>>"


def complexity_blocks(outputs: DataFrame, root: str | None = None, depth: int = 32) -> DataFrame:
    """(file_path, name, complexity, rank, start_line, end_line): functions, methods and closures of a complexity report (column `output`, a JSON object of path -> blocks).

    Classes give only their methods; closures are followed as deep as the report nests (`depth` levels at most, beyond which it raises).
    A report's value that is no list (a file with an error) gives nothing.
    """
    files = outputs.select(F.explode(F.from_json("output", "map<string,string>")).alias("reported", "blocks"))
    level = files.select(_relative(F.col("reported"), root).alias("file_path"), F.explode(F.from_json("blocks", "array<string>")).alias("b")).filter("file_path is not null")
    found = None
    for _ in range(depth):
        parsed = level.select("file_path", F.from_json("b", _BLOCK).alias("b")).select("file_path", "b.*")
        here = parsed.filter("type != 'class'").select("file_path", "name", "complexity", "rank", F.col("lineno").alias("start_line"), F.greatest("endline", "lineno").alias("end_line"))
        found = here if found is None else found.unionByName(here)
        inner = F.concat(F.coalesce("methods", F.array().cast("array<string>")), F.coalesce("closures", F.array().cast("array<string>")))
        level = parsed.select("file_path", F.explode(inner).alias("b"))
        if level.isEmpty():
            return found
    raise ValueError(f"the report nests deeper than {depth} levels")


def complexity(outputs: DataFrame, root: str | None = None, depth: int = 32) -> DataFrame:
    """Findings for functions of rank D, E or F of a complexity report."""
    severity = F.create_map(*[F.lit(x) for kv in RANK_SEVERITY.items() for x in kv])[F.col("rank")]
    title = F.substring(F.format_string("'%s' is too complex (cyclomatic complexity %d)", "name", "complexity"), 1, 80)
    rows = complexity_blocks(outputs, root, depth).withColumn("severity", severity).filter("severity is not null")
    return rows.select("file_path", "start_line", "end_line", F.lit("maintainability").alias("category"), "severity", title.alias("title"), F.lit("cyclomatic-complexity").alias("rule_id"), F.array(F.lit("radon")).alias("sources"))


def maintainability(outputs: DataFrame, root: str | None = None) -> DataFrame:
    """A finding per file whose maintainability index (JSON object of path -> {mi}) is below `LOW_MAINTAINABILITY`."""
    rows = outputs.select(F.explode(F.from_json("output", "map<string,struct<mi:double>>")).alias("reported", "r")).select(_relative(F.col("reported"), root).alias("file_path"), F.col("r.mi").alias("mi"))
    low = rows.filter("file_path is not null").filter(F.col("mi") < LOW_MAINTAINABILITY)
    return low.select("file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("maintainability").alias("category"), F.lit("medium").alias("severity"), F.format_string("Low maintainability index (%.0f/100)", "mi").alias("title"), F.lit("maintainability-index").alias("rule_id"))


def raw_metrics(outputs: DataFrame, root: str | None = None) -> DataFrame:
    """(file_path, n_lines, source_lines, comment_lines, blank_lines) of a line count report; entries without loc are dropped."""
    shape = "map<string,struct<loc:int,sloc:int,comments:int,multi:int,blank:int>>"
    rows = outputs.select(F.explode(F.from_json("output", shape)).alias("reported", "r")).select(_relative(F.col("reported"), root).alias("file_path"), "r.*")
    return rows.filter("file_path is not null and loc is not null").select("file_path", F.col("loc").alias("n_lines"), F.col("sloc").alias("source_lines"), (F.col("comments") + F.col("multi")).alias("comment_lines"), F.col("blank").alias("blank_lines"))


_FUNCTION_CSV = "nloc int, ccn int, tokens int, parameters int, length int, location string, file string, name string, long_name string, start int, end int, _more string"


def functions(outputs: DataFrame, reviewed: DataFrame, root: str | None = None) -> DataFrame:
    """(file_path, name, start_line, end_line, complexity, n_lines, parameters, length) of a function counter's CSV lines; lines of another arity or of files not under review are dropped."""
    lines = outputs.select(F.explode(F.split("output", "\r?\n")).alias("l")).filter("l != ''")
    # fields may be quoted and hold commas, so the arity is that of the parsed line: the 11th field is there and no 12th
    rows = lines.select(F.from_csv("l", F.lit(_FUNCTION_CSV), {"mode": "PERMISSIVE"}).alias("r")).select("r.*").filter("`end` is not null and _more is null and start is not null")
    named = rows.select(_relative(F.col("file"), root).alias("file_path"), "name", F.col("start").alias("start_line"), F.col("end").alias("end_line"), F.col("ccn").alias("complexity"), F.col("nloc").alias("n_lines"), "parameters", "length")
    return named.filter("file_path is not null").join(reviewed.select("file_path").distinct(), "file_path", "left_semi")


def function_rules(rows: DataFrame) -> DataFrame:
    """Findings of `functions`: complex (over 15, not Python), long (over 80 lines) or taking over 6 parameters."""
    name = F.col("name")
    checks = F.array(
        F.struct(F.lit("function-complexity").alias("rule_id"), F.format_string("'%s' is too complex (cyclomatic complexity %d)", name, "complexity").alias("title"), ((F.col("complexity") > 15) & ~F.lower("file_path").endswith(".py")).alias("hit")),
        F.struct(F.lit("long-function").alias("rule_id"), F.format_string("'%s' is long (%d lines)", name, "length").alias("title"), (F.col("length") > 80).alias("hit")),
        F.struct(F.lit("too-many-parameters").alias("rule_id"), F.format_string("'%s' takes %d parameters", name, "parameters").alias("title"), (F.col("parameters") > 6).alias("hit")),
    )
    hits = rows.select("file_path", "start_line", F.greatest("start_line", "end_line").alias("end_line"), F.explode(F.filter(checks, lambda c: c["hit"])).alias("c"))
    return hits.select("file_path", "start_line", "end_line", "c.rule_id", F.substring("c.title", 1, 80).alias("title"), F.lit("maintainability").alias("category"), F.lit("low").alias("severity"))


_PATTERN_REPORT = (
    "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,end:struct<line:int,col:int>,extra:struct<message:string,severity:string,metadata:struct<category:string,confidence:string,cwe:string>>>>>"
)
#: Severity and confidence words of a pattern scanner (fixed values).
PATTERN_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
PATTERN_CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}


def patterns(outputs: DataFrame, root: str | None = None) -> DataFrame:
    """A pattern scanner's JSON object as findings: blanks of the message collapsed, the title its first sentence, unknown words to defaults, only CWE ids of the usual form."""
    r = outputs.select(F.explode(F.from_json("output", _PATTERN_REPORT)["results"]).alias("r")).select("r.*")
    message = F.trim(F.regexp_replace("extra.message", r"\s+", " "))
    words = lambda m, c, default: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c], F.lit(default))
    cwe, category = F.col("extra.metadata.cwe"), F.col("extra.metadata.category")
    rows = r.select(
        _relative(F.col("path"), root).alias("file_path"), F.col("start.line").alias("start_line"), F.greatest("end.line", "start.line").alias("end_line"), F.col("start.col").alias("start_column"),
        F.when(F.col("end.line") == F.col("start.line"), F.col("end.col")).alias("end_column"), F.when(category.isin(*D.CATEGORIES), category).otherwise("security").alias("category"), words(PATTERN_SEVERITY, F.col("extra.severity"), "low").alias("severity"),
        C.shorten(F.substring_index(message, ". ", 1)).alias("title"), message.alias("message"), F.col("check_id").alias("rule_id"), words(PATTERN_CONFIDENCE, F.col("extra.metadata.confidence"), 0.7).alias("confidence"),
        F.when(cwe.startswith("CWE-"), cwe).alias("cwe"),
    )
    return rows.filter("file_path is not null")


def parseable(files: DataFrame) -> DataFrame:
    """The Python files (file_path ends in .py or .pyi) whose content the interpreter parses."""

    @F.pandas_udf("boolean")
    def parses(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_parses(t) for t in batch], dtype="bool")

    return files.filter(F.col("file_path").rlike(r"\.pyi?$") & F.col("content").isNotNull()).filter(parses("content"))


def _parses(text: str) -> bool:
    try:
        ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True
