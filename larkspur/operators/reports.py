"""Reports: the JSON document, tables, project facts and summaries, activity lines and exports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import findings as fnd


def project_description(files: DataFrame) -> DataFrame:
    """Per repository, `n files: language n, ...`, the most common first, then by name."""
    n = files.groupBy("repository", "file_language").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.coalesce("file_language", F.lit("unknown")).alias("l"))))
    rows = n.groupBy("repository").agg(F.sum("n").alias("total"), order.alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: F.concat(x["l"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    return rows.select("repository", F.concat(F.col("total").cast("string"), F.when(F.col("total") == 1, " file: ").otherwise(" files: "), text).alias("description"))


def repository_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per repository: files, thousand lines, findings per severity (zeros included), findings per thousand lines."""
    n = fnd.reported(findings).groupBy("repository").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")], F.count(F.lit(1)).alias("n_reported"))
    size = files.groupBy("repository").agg(F.count(F.lit(1)).alias("n_files"), (F.sum(F.coalesce("line_count", F.lit(0))) / 1000.0).alias("kloc"))
    rows = size.join(n, "repository", "left").na.fill(0, ["critical", "high", "medium", "low", "info", "n_reported"])
    return rows.withColumn("per_kloc", F.round(F.col("n_reported") / F.nullif("kloc", F.lit(0.0)), 6)).withColumn("kloc", F.round("kloc", 6))


def category_pivot(findings: DataFrame) -> DataFrame:
    """Repository by category, reported findings."""
    return fnd.reported(findings).groupBy("repository").pivot("category", ["bug", "documentation", "maintainability", "performance", "security", "style", "typing"]).agg(F.count(F.lit(1))).na.fill(0)


def everywhere(findings: DataFrame, by: str = "severity") -> DataFrame:
    """Relational division: rules that were reported at every value of `by` that occurs."""
    values = findings.filter(F.col(by).isNotNull()).agg(F.count_distinct(by).alias("total"))
    mine = findings.filter(F.col("rule_id").isNotNull() & F.col(by).isNotNull()).groupBy("rule_id").agg(F.count_distinct(by).alias("k"))
    return mine.join(F.broadcast(values), F.col("k") == F.col("total")).select("rule_id")  # one row


def activity_lines(events: DataFrame) -> DataFrame:
    """(scan_id, id, text): events as lines of text; tool starts (even keys) are dropped."""
    text = (
        F.when(F.col("kind") == "stage", F.concat(F.lit("stage "), F.col("key").cast("string"))).when((F.col("kind") == "tool") & (F.col("key") % 2 == 1), F.concat(F.lit("tool done in "), C.milliseconds(F.floor(F.col("value") * 100).cast("bigint"))))
        .when(F.col("kind") == "finding", F.lit("finding")).when(F.col("kind") == "llm_call", F.concat(F.lit("model call "), F.col("key").cast("string"))).when(F.col("kind") == "status", F.lit("status"))
    )
    return events.select("scan_id", "id", F.substring(text, 1, 120).alias("text")).filter("text is not null")


def progress(events: DataFrame, stages: int = 6) -> DataFrame:
    """Per scan, the share of stages that are done, at most 100."""
    n = events.groupBy("scan_id").agg(F.count_if(F.col("kind") == "stage").alias("done"), (F.max_by("kind", "id") != "status").alias("running"))
    return n.select("scan_id", F.least(F.lit(100.0), F.round((F.col("done") + F.when(F.col("running"), 0.5).otherwise(0.0)) * 100 / stages, 6)).alias("percent"))


def report_json(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, report): score, grade and the gravest findings of each repository as one JSON document."""
    top = fnd.summary_lines(findings, 10).groupBy("repository").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("top"))
    rows = fnd.quality_score(findings, files).join(top, "repository", "left")
    return rows.select("repository", F.to_json(F.struct("repository", "score", "grade", "n_files", "n_reported", F.coalesce("top", F.array().cast("array<string>")).alias("top"))).alias("report"))


def html_table(df: DataFrame, title: str, most: int = 500) -> str:
    """A small result as an HTML table; `most` rows at most come to the driver (a page is no place for more), and the page says if there are more."""
    rows = df.limit(most + 1).collect()
    more = f"<p>The first {most} rows; there are more.</p>" if len(rows) > most else ""
    rows = rows[:most]
    cell = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><title>{cell(title)}</title><h1>{cell(title)}</h1><table><tr>{head}</tr>{body}</table>{more}"


def embed(document: str, named: dict[str, str]) -> str:
    """Replace the blocks between `<!-- begin name -->` and `<!-- end name -->`; an unknown name is an error."""
    import re

    def put(m: re.Match) -> str:
        if m[1] not in named:
            raise KeyError(m[1])
        return f"<!-- begin {m[1]} -->\n{named[m[1]]}\n<!-- end {m[1]} -->"

    return re.sub(r"<!-- begin ([\w-]+) -->.*?<!-- end \1 -->", put, document, flags=re.S)


def rating_sheet(sample: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blind sheet, key): the sampled findings numbered, without their sources, and the sources by number."""
    w = Window.orderBy("repository", "place")  # a sample is small
    item = F.concat(F.lit("S"), F.lpad(F.row_number().over(w).cast("string"), 4, "0"))
    rows = sample.join(findings, ["repository", "finding_id"]).withColumn("item", item)
    sheet = rows.select("item", "file_path", C.range_text(F.col("start_line"), F.coalesce("end_line", "start_line")).alias("lines"), "category", "title", "message", "suggestion", *[F.lit("").alias(c) for c in ("correctness", "usefulness", "clarity")])
    return sheet, rows.select("item", "finding_id", "sources")


def note(summary: Column, reason: Column) -> Column:
    """`summary: reason`, or `summary.` without one."""
    return F.when(F.coalesce(F.trim(reason), F.lit("")) != "", F.concat(summary, F.lit(": "), F.trim(reason))).otherwise(F.concat(summary, F.lit(".")))
