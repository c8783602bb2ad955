"""Findings: de-duplication, counts, quality score, rankings and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C

FILE = ("repository", "file_path")


def issue_key(findings: DataFrame) -> DataFrame:
    """Adds `kind`: the kind of issue that rules of several tools stand for, else tool:rule."""
    rules = D.literal_table(findings.sparkSession, D.EQUIVALENT_RULES, "tool string, rule string, equivalent string")
    tool = F.try_element_at("sources", F.lit(1))
    joined = findings.withColumn("_tool", tool).join(rules, (F.col("_tool") == F.col("tool")) & (F.col("rule_id") == F.col("rule")), "left")
    kind = F.when(F.col("_tool") == "detect-secrets", "hardcoded-credential").otherwise(F.coalesce("equivalent", F.concat_ws(":", "_tool", F.coalesce("rule_id", F.lit("")))))
    return joined.withColumn("kind", kind).drop("_tool", "tool", "rule", "equivalent")


def dedupe(findings: DataFrame, key: Column | None = None) -> DataFrame:
    """Findings of different sources on one line and of one kind become one.

    The k-th finding of a source under a key goes to the key's k-th bucket. The lead of a bucket is the first of the most severe and
    confident; it keeps its fields, with the bucket's last line, largest confidence, sources (lead first, then by order) and first CWE.
    """
    keyed = issue_key(findings) if key is None else findings.withColumn("kind", key)
    place = Window.partitionBy(*FILE, "start_line", "kind", F.try_element_at("sources", F.lit(1))).orderBy("ord")
    rows = keyed.withColumn("bucket", F.row_number().over(place))
    lead = F.struct("sev_rank", F.coalesce("confidence", F.lit(-1.0)), -F.col("ord"))
    grouped = rows.groupBy(*FILE, "start_line", "kind", "bucket").agg(
        F.max_by(F.struct("ord", "rule_id", "category", "severity", "sev_rank", "title", "sources", "cwe"), lead).alias("lead"), F.max("end_line").alias("end_line"), F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_merged"), F.min_by("cwe", F.when(F.col("cwe").isNotNull(), F.col("ord"))).alias("first_cwe"),
        F.array_sort(F.collect_list(F.struct("ord", "sources"))).alias("all"),
    )
    union = F.array_distinct(F.concat(F.col("lead.sources"), F.flatten(F.transform("all", lambda x: x["sources"]))))
    return grouped.select(
        F.col("lead.ord").alias("finding_id"), *FILE, "start_line", "end_line", "kind", "bucket", "lead.rule_id", "lead.category", "lead.severity", "lead.title", union.alias("sources"), "confidence",
        F.coalesce("lead.cwe", "first_cwe").alias("cwe"), "n_merged",
    )


def canonical_order() -> list[Column]:
    """Most severe first, then file, line, rule and arrival."""
    return [F.desc("sev_rank"), F.asc("file_path"), F.asc("start_line"), F.coalesce("rule_id", F.lit("")).asc(), F.asc("ord")]


def reported(findings: DataFrame) -> DataFrame:
    return findings.filter(C.is_reported(F.col("status"), F.col("sources"), F.col("confidence")))


def headline_counts(findings: DataFrame, by: str = "repository") -> DataFrame:
    """Reported findings in all, by severity and by category in one pass; counts are ordered by rank: n descending, first seen."""
    rows = reported(findings)
    wanted = [[by], [by, "severity"], [by, "category"]]
    sets = rows.groupingSets([[F.col(c) for c in s] for s in wanted], F.col(by), F.col("severity"), F.col("category")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen"), F.grouping_id().alias("g"))
    kept = sets.withColumn("dimension", F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "severity").otherwise("category"))
    place = F.row_number().over(Window.partitionBy(by, "dimension").orderBy(F.desc("n"), "first_seen"))
    return kept.select(by, "dimension", F.coalesce("severity", "category", F.lit("")).alias("value"), "n", place.alias("place"))


def hidden_counts(findings: DataFrame, by: str = "repository") -> DataFrame:
    """Dismissed, rejected and otherwise reportable findings below the least confidence."""
    weak = C.is_unconfident(F.col("sources"), F.col("confidence"))
    return findings.groupBy(by).agg(
        F.count_if(F.col("status") == "dismissed_by_ai").alias("dismissed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status").isin(*D.REPORTED) & weak).alias("below_confidence"), F.count(F.lit(1)).alias("n_all"),
    )


def hidden_reasons(findings: DataFrame) -> DataFrame:
    """(finding_id, reason): the first reason that hides a finding."""
    weak = C.is_unconfident(F.col("sources"), F.col("confidence"))
    reason = F.when(F.col("status") == "dismissed_by_ai", "dismissed").when(F.col("status") == "rejected", "rejected").when(weak, F.format_string("confidence %.2f", F.col("confidence")))
    return findings.select("finding_id", reason.alias("reason")).filter("reason is not null")


def quality_score(findings: DataFrame, files: DataFrame, by: str = "repository") -> DataFrame:
    """100 less weighted findings per thousand lines and the share of complex files, half-even rounded within 0..100, with its grade.

    Complexity is taken per file: one with findings of the kind complex-function counts as complex.
    """
    weight = F.lit(0)
    for s, w in D.WEIGHTS.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    points = reported(findings).groupBy(by).agg(F.sum(weight).alias("points"), F.count(F.lit(1)).alias("n_reported"))
    size = files.groupBy(by).agg(F.sum(F.coalesce("line_count", F.lit(0))).alias("lines"), F.count(F.lit(1)).alias("n_files"))
    knotty = findings.filter("issue_key = 'complex-function'").select(*FILE).distinct().groupBy("repository").agg(F.count(F.lit(1)).alias("n_complex"))
    rows = size.join(points, by, "left").join(knotty, "repository", "left").na.fill(0, ["points", "n_reported", "n_complex"])
    kloc = F.col("lines") / 1000.0
    finding_penalty = F.col("points") / F.greatest(F.lit(1.0), kloc)
    complexity_penalty = D.COMPLEXITY_WEIGHT * F.col("n_complex") / F.greatest(F.col("n_files"), F.lit(1))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - finding_penalty - complexity_penalty))).cast("int")
    return rows.select(by, "n_files", "lines", "n_reported", F.round(finding_penalty, 6).alias("finding_penalty"), F.round(complexity_penalty, 6).alias("complexity_penalty"), score.alias("score")).withColumn(
        "grade", C.grade(F.col("score"))
    )


def file_entries(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Every file with its number of reported findings (0 for none) and the highest severity."""
    n = reported(findings).groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.max_by("severity", "sev_rank").alias("highest"))
    return files.select(*FILE, "file_language").join(n, list(FILE), "left").na.fill(0, ["n"])


def top_files(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k files of most reported findings, ties by first seen."""
    return reported(findings).groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def top_rules(findings: DataFrame, k: int = 3) -> DataFrame:
    """The k most common rules per repository, ties by name."""
    n = findings.filter("rule_id is not null").groupBy("repository", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("n"), "rule_id"))
    return n.withColumn("place", place).filter(F.col("place") <= k)


def folder_rollup(findings: DataFrame) -> DataFrame:
    """Per repository and folder, findings in all files below and the highest rank."""
    per_file = reported(findings).groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.max("sev_rank").alias("rank"))
    above = per_file.select("repository", F.explode(C.ancestors(F.col("file_path"))).alias("folder"), "n", "rank")
    return above.groupBy("repository", "folder").agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))


def summary_lines(findings: DataFrame, k: int = 30) -> DataFrame:
    """(repository, place, text): the k gravest reported findings of a repository and a last line for the rest."""
    rows = reported(findings)
    w = Window.partitionBy("repository").orderBy(F.desc("sev_rank"), "file_path", "start_line", "ord")
    text = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), C.shorten(F.col("title")))
    shown = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("repository", F.col("place").cast("int").alias("place"), text.alias("text"))
    rest = rows.groupBy("repository").agg((F.count(F.lit(1)) - k).alias("more")).filter("more > 0")
    return shown.unionByName(rest.select("repository", F.lit(k + 1).alias("place"), F.format_string("and %d more", F.col("more")).alias("text")))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_index, rule_id, first_title, tags, security_rank, n): one row per rule in the order first seen."""
    rows = reported(findings).withColumn("rule", C.rule_or_source(F.col("rule_id"), F.col("sources")))
    tags = F.flatten(F.collect_set(F.array_compact(F.array("category", F.when(F.col("cwe").isNotNull(), F.concat(F.lit("external/cwe/"), F.lower("cwe")))))))
    security = F.max(F.when(F.col("category") == "security", F.col("sev_rank")))
    rules = rows.groupBy("rule").agg(F.min("ord").alias("first_seen"), F.min_by("title", "ord").alias("first_title"), F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("tags"), security.alias("security_rank"), F.count(F.lit(1)).alias("n"))
    # one row per rule of the whole export: a global numbering of a small table
    return rules.select((F.row_number().over(Window.orderBy("first_seen")) - 1).alias("rule_index"), F.col("rule").alias("rule_id"), "first_title", "tags", "security_rank", "n")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(finding_id, result): each reported finding as a result object; null fields are left out."""
    rows = reported(findings)
    level = F.when(F.col("sev_rank") >= 3, "error").when(F.col("sev_rank") == 2, "warning").otherwise("note")
    rule = C.rule_or_source(F.col("rule_id"), F.col("sources"))
    body = F.to_json(F.struct(
        rule.alias("ruleId"), level.alias("level"), F.struct(F.coalesce("message", "title").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(C.fingerprint(rule, F.col("file_path"), F.col("evidence"), F.col("title")).alias("v1")).alias("partialFingerprints"),
    ))
    return rows.select("finding_id", body.alias("result"))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of `after` that are new or differ from `before`."""
    cols = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*cols).alias("_old"))
    return after.join(old, key, "left").filter(~F.struct(*cols).eqNullSafe(F.col("_old"))).drop("_old")
