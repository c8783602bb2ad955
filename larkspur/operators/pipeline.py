"""Steps of a review pipeline as joins and projections: answers to findings, judgements, permissions, pauses, states, orders and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.operators import answers, routing

#: Longest wait in seconds per priority, and the severity rank from which a depth of review verifies (fixed values; null: never).
LONGEST_WAIT = {"interactive": 5.0, "batch": 30.0}
VERIFY_FROM = {"static": None, "quick": 4, "standard": 3, "deep": 2}
#: Seconds of a pause after failures that say so themselves, and whether a failure counts towards opening the breaker (fixed values).
PAUSES = (("quota_exhausted", 3600.0, False), ("auth_failed", 3600.0, False), ("misconfigured", 3600.0, False), ("rejected", 0.0, False), ("rate_limited", None, False), ("unavailable", 30.0, True))
#: Where a tool of a name lists its models, and the capability that a model must have there (fixed values).
CAPABILITY = "generateContent"


def to_findings(items: DataFrame, provider: Column) -> DataFrame:
    """Valid items of answers (see `answers.issues`) as findings: the rule is the category's, the source the provider, evidence without line numbers."""
    rows = items.filter("valid")
    return rows.withColumns({"rule_id": F.concat(F.lit("ai/"), "category"), "sources": F.array(provider), "evidence": C.clean_evidence(F.col("evidence")), "end_line": F.greatest("start_line", "end_line")})


def with_judgements(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """Every finding with its judgements (finding_id, place, verdict) in order; an empty list where there is none."""
    lists = judged.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "verdict"))), lambda x: x["verdict"]).alias("verdicts"))
    return findings.join(lists, "finding_id", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast("array<string>")))


def loaded(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The findings whose file was loaded (has content)."""
    return findings.join(files.filter("content is not null").select("repository", "file_path").distinct(), ["repository", "file_path"], "left_semi")


def with_limits(providers: DataFrame, tuning: DataFrame, limits: DataFrame) -> DataFrame:
    """Providers with their tuning (provider, limits_group, priority) and the limits of that group, which providers share."""
    return providers.join(tuning, "provider").join(limits, "limits_group", "left")


def permitted(provider: Column, external: Column, excluded: list[str], only: list[str] | None, allow_external: bool) -> Column:
    """Whether a provider may serve: not excluded, among `only` if given, and external ones only with consent."""
    within = F.lit(True) if only is None else provider.isin(*only)
    return ~provider.isin(*excluded) & within & (F.lit(allow_external) | ~external)


def pauses(calls: DataFrame) -> DataFrame:
    """Failed calls with the pause that their failure asks for (null: by the number of limits in a row) and whether they count towards opening the breaker."""
    shape = "array<struct<status:string,pause:double,counts:boolean>>"
    table = F.from_json(F.lit("[" + ", ".join(f'{{"status": "{s}", "pause": {"null" if p is None else p}, "counts": {str(c).lower()}}}' for s, p, c in PAUSES) + "]"), shape)
    known = F.try_element_at(F.filter(table, lambda t: t["status"] == F.col("status")), F.lit(1))
    return calls.withColumn("_p", known).filter("_p is not null").withColumns({"pause": F.col("_p.pause"), "counts": F.col("_p.counts")}).drop("_p")


def states_now(calls: DataFrame) -> DataFrame:
    """(provider, state, n_open, last_call): the breaker's state at the latest call of each provider, and how many calls met it open."""
    states = routing.breaker_states(calls)
    return states.groupBy("provider").agg(F.max_by("state", "call_id").alias("state"), F.count_if(F.col("state") == "open").alias("n_open"), F.max("call_id").alias("last_call"))


def curated(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Findings with the list of labels that match them (finding_id, label_id), or none."""
    lists = matches.groupBy("finding_id").agg(F.array_join(F.array_sort(F.collect_set("label_id")), ", ").alias("labels"))
    return findings.join(lists, "finding_id", "left").withColumn("labels", F.coalesce("labels", F.lit("none")))


def recovered(scans: DataFrame) -> DataFrame:
    """Scans as they are after a restart: what was queued or running has failed, as it was interrupted."""
    cut = F.col("status").isin("queued", "running")
    return scans.withColumn("error", F.when(cut, F.lit("interrupted"))).withColumn("status", F.when(cut, F.lit("failed")).otherwise(F.col("status")))


def resumed(events: DataFrame, seen: DataFrame) -> DataFrame:
    """The events after the last one seen per scan (scan_id, last_id), as server-sent events (id, event, data); all of a scan that was not seen."""
    rows = events.join(seen, "scan_id", "left").filter(F.col("id") > F.coalesce("last_id", F.lit(0)))
    return rows.select("scan_id", "id", F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nevent: "), F.col("kind"), F.lit("\ndata: "), F.to_json(F.struct("key")), F.lit("\n\n")).alias("message"))


def model_list(payload: Column) -> Column:
    """Model ids of a listing: `models` with the capability and without their prefix, or `data`; sorted, empty for null."""
    p = F.from_json(payload, "struct<models:array<struct<name:string,supportedGenerationMethods:array<string>>>,data:array<struct<id:string>>>")
    able = F.filter(F.coalesce(p["models"], F.array().cast("array<struct<name:string,supportedGenerationMethods:array<string>>>")), lambda m: F.array_contains(m["supportedGenerationMethods"], CAPABILITY))
    own = F.transform(able, lambda m: F.regexp_replace(m["name"], "^models/", ""))
    return F.array_sort(F.concat(own, F.transform(F.coalesce(p["data"], F.array().cast("array<struct<id:string>>")), lambda m: m["id"])))


def listing(models: DataFrame, text: str) -> DataFrame:
    """(provider, line): how many models of a provider hold the text whatever its case, and which."""
    kept = F.filter("models", lambda m: F.contains(F.lower(m), F.lit(text.lower())))
    rows = models.groupBy("provider").agg(F.array_sort(F.flatten(F.collect_list("models"))).alias("models")).withColumn("models", kept)
    n = F.size("models")
    return rows.select("provider", F.concat(F.col("provider"), F.lit(" ("), n.cast("string"), F.when(n == 1, " model)").otherwise(" models)"), F.array_join(F.transform("models", lambda m: F.concat(F.lit("\n  "), m)), "")).alias("line"))


def reading_order() -> list[Column]:
    """Gravest first, then by path as a reader sorts it, then by line."""
    return [F.desc("sev_rank"), F.collate("file_path", "UNICODE"), F.asc_nulls_first("start_line"), F.col("ord")]


def tree_order() -> list[Column]:
    """Folders before files, then by name as a reader sorts it."""
    return [F.col("is_file"), F.collate("name", "UNICODE"), F.col("name")]


def configuration_order(name: Column, pinned: list[str], routed: list[str]) -> Column:
    """A sort key: the pinned ones in their order, the routed ones in theirs, the others by name."""
    at = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), name)
    return F.struct(F.when(at(pinned) > 0, 0).when(at(routed) > 0, 1).otherwise(2).alias("group"), F.when(at(pinned) > 0, at(pinned)).otherwise(at(routed)).alias("place"), name.alias("name"))


def run_of(variant: Column) -> Column:
    """The run that records a configuration: A static, B llm-only, D and E hybrid, B-x llm-only-x, F-x model-x, E-x+y verify-model-x-by-y; null for others."""
    prefix, rest = F.substring_index(variant, "-", 1), F.regexp_extract(variant, r"^[^-]*-(.*)$", 1)
    return (
        F.when(variant == "A", "static").when(variant == "B", "llm-only").when(variant.isin("D", "E"), "hybrid").when((prefix == "B") & (rest != ""), F.concat(F.lit("llm-only-"), rest)).when((prefix == "F") & (rest != ""), F.concat(F.lit("model-"), rest))
        .when((prefix == "E") & rest.contains("+"), F.concat(F.lit("verify-model-"), F.substring_index(rest, "+", 1), F.lit("-by-"), F.regexp_extract(rest, r"^[^+]*\+(.*)$", 1)))
    )


def active_filters(severity: Column, category: Column, source: Column, hidden: Column) -> Column:
    """How many filters of the list are not at their default."""
    return (severity != "any").cast("int") + (category != "any").cast("int") + (source != "any").cast("int") + hidden.cast("int")


def upload(name: Column) -> Column:
    """struct(kind, name): an archive for .zip in any case, else a single file of which only the last path component is kept."""
    archive = F.lower(name).endswith(".zip")
    return F.struct(F.when(archive, "archive").otherwise("file").alias("kind"), F.when(archive, name).otherwise(F.regexp_extract(F.translate(name, "\\", "/"), r"([^/]*)$", 1)).alias("name"))


def prompt_version(template: Column) -> Column:
    """The version that a template's header comment declares, or null."""
    return F.nullif(F.regexp_extract(template, r"^\{#\s*PROMPT_VERSION:\s*(\S+)\s*#\}", 1), F.lit(""))


def payload(findings: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(finding_id, payload): what a verifier is shown as JSON: the finding without who reported it, and the excerpt around it."""
    fields = ["file_path", "start_line", "end_line", "category", "severity", "title", "message"]
    return findings.join(excerpts, "finding_id", "left").select("finding_id", F.to_json(F.struct(*fields, F.struct("first_line", "last_line").alias("excerpt"))).alias("payload"))


def complete(verified: DataFrame, note: str = "not verified") -> DataFrame:
    """(repository, file_path, n, complete): a file's record is complete if no finding was left with that note."""
    left = F.count_if(F.col("note") == note)
    return verified.groupBy("repository", "file_path").agg(F.count(F.lit(1)).alias("n"), (left == 0).alias("complete"))


def tally(rows: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Of a map tool -> state how many are ok, and the sum of a map tool -> number."""
    return rows.select(*keys, F.size(F.filter(F.map_values("states"), lambda s: s == "ok")).alias("n_ok"), F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


def called(attempts: DataFrame) -> DataFrame:
    """Attempts (task, provider, model, status, detail, latency_ms) as records: the detail cut, no negative latency, and no model for a skipped attempt."""
    return attempts.select(
        "call_id", "task", "provider", F.when(F.col("status") != "skipped", F.col("model")).alias("model"), "status", F.substring("detail", 1, answers.LONGEST_ERROR).alias("detail"), F.when(F.col("latency_ms") >= 0, F.col("latency_ms")).otherwise(F.lit(0)).alias("latency_ms"),
    )


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """Rows with their place within keys."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
