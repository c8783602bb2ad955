"""The engine's entities as views of the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C
from larkspur.plans.durable import table


def findings(spark: SparkSession, d: str) -> DataFrame:
    """One row per finding_id (the latest loaded), sources and confidence normalised, with sev_rank and ord."""
    raw = table(spark, d, "findings").filter("finding_id is not null")
    fields = [c for c in raw.columns if c not in ("finding_id", "loaded_at", "verified_by", "rationale", "ai_note")]
    rows = raw.groupBy("finding_id").agg(F.max_by(F.struct(*fields), "loaded_at").alias("r")).select("finding_id", "r.*")
    names = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    confidence = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return rows.withColumns({
        "sources": F.array_distinct(F.filter(names, lambda s: s.isNotNull() & (s != ""))), "confidence": confidence,
        "sev_rank": D.severity_rank(F.col("severity")), "ord": F.col("finding_id"),
    })


def files(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of every file by repository and path."""
    raw = table(spark, d, "source_files").filter("repository is not null and file_path is not null")
    fields = [c for c in raw.columns if c not in ("repository", "file_path", "content", "partial_regions")]  # contents are read by `lines`
    order = F.struct("ingested_at", "file_id")
    return raw.groupBy("repository", "file_path").agg(F.max_by(F.struct(*fields), order).alias("r")).select("repository", "file_path", "r.*")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, repository, file_path, line_no, text): the lines of every file with content."""
    rows = table(spark, d, "source_files").filter("content is not null")
    return rows.select("file_id", "repository", "file_path", F.posexplode(C.split_lines(F.col("content"))).alias("p", "text")).withColumn("line_no", F.col("p") + 1).drop("p")


def lengths(spark: SparkSession, d: str) -> DataFrame:
    """(repository, file_path, n_lines, lengths): of the latest version of every file the number of its lines and their lengths, 0 and none without content."""
    lines = C.split_lines(F.col("content"))
    rows = table(spark, d, "source_files").filter("repository is not null and file_path is not null")
    rows = rows.select("repository", "file_path", F.struct("ingested_at", "file_id").alias("at"), F.size(lines).alias("n_lines"), F.transform(lines, F.length).alias("lengths"))
    return rows.groupBy("repository", "file_path").agg(F.max_by("n_lines", "at").alias("n_lines"), F.max_by("lengths", "at").alias("lengths"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk_id."""
    raw = table(spark, d, "chunks").filter("chunk_id is not null")
    return raw.groupBy("chunk_id").agg(F.max(F.struct(*[c for c in raw.columns if c != "chunk_id"])).alias("r")).select("chunk_id", "r.*")


def calls(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """One row per call_id (the latest logged) with the given fields (all by default), models without case and outer blanks.

    The fields travel through an aggregate as one struct, which hides them from column pruning: name those that are needed.
    """
    raw = table(spark, d, "calls").filter("call_id is not null")
    kept = list(fields) or [c for c in raw.columns if c not in ("call_id", "logged_at")]
    rows = raw.groupBy("call_id").agg(F.max(F.struct("logged_at", *kept)).alias("r")).select("call_id", *[F.col(f"r.{c}") for c in kept])
    return rows.withColumn("model", F.lower(F.trim("model"))) if "model" in kept else rows


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Rated items as located labels: (label_id, repository, file_path, start_line, end_line, category)."""
    ends = F.split("line_range", "-")
    start = F.try_element_at(ends, F.lit(1)).try_cast("int")
    return table(spark, d, "rating_items").select(
        F.col("item").alias("label_id"), "repository", "file_path", start.alias("start_line"), F.coalesce(F.try_element_at(ends, F.lit(2)).try_cast("int"), start).alias("end_line"), "category"
    ).filter("start_line is not null")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(rater, item, criterion, score): the latest row of a rater and item, whole scores of 1 to 5."""
    raw = table(spark, d, "rating_sheet").filter("rater is not null and item is not null")
    latest = raw.groupBy("rater", "item").agg(F.max_by(F.struct("correctness", "usefulness", "clarity"), F.struct("rated_at", "rating_id")).alias("r")).select("rater", "item", "r.*")
    long = latest.unpivot(["rater", "item"], ["correctness", "usefulness", "clarity"], "criterion", "typed")
    score = F.trim("typed").try_cast("double")
    return long.select("rater", "item", "criterion", score.alias("score")).filter("score in (1, 2, 3, 4, 5)").withColumn("score", F.col("score").cast("int"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as a log: (scan_id, id, ts, kind, key, value), id numbered from 1 in a scan."""
    from pyspark.sql import Window

    kind = F.create_map(*[F.lit(x) for p in (("view", "stage"), ("click", "tool"), ("signup", "finding"), ("purchase", "llm_call"), ("error", "status")) for x in p])
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("scan_id"), number.cast("long").alias("id"), "ts", F.try_element_at(kind, F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("key"), "value", "event_id"
    )
