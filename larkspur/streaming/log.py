"""The event log as a stream: replay and follow, keyed upserts, retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "scan_id bigint, id bigint, ts timestamp_ntz, kind string, key int, value double"


def follow(spark: SparkSession, folder: str, after: int = 0, files_per_batch: int = 100) -> DataFrame:
    """The events of a folder of JSON lines after an id, as a stream; broken lines are skipped."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = raw.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return rows.filter(F.col("id").isNotNull() & (F.col("id") > after))


def once(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each (scan_id, id) once; with a watermark on ts the state of old ids is dropped."""
    if watermark:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["scan_id", "id"])
    return events.dropDuplicates(["scan_id", "id"])


def upserts(events: DataFrame) -> DataFrame:
    """The latest event per (scan_id, kind, key) and the id it first came with, kept as state and emitted on change."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, value = state.get if state.exists else (None, -1, None)
        changed = False
        for b in batches:
            for r in b.sort_values("id").itertuples(index=False):
                first = r.id if first is None else min(first, r.id)
                if r.id > last:
                    last, value, changed = r.id, r.value, True
        if changed:
            state.update((first, last, value))
            yield pd.DataFrame([(*key, first, last, value)], columns=["scan_id", "kind", "key", "first_id", "last_id", "value"])

    return events.groupBy("scan_id", "kind", "key").applyInPandasWithState(
        run, "scan_id bigint, kind string, key int, first_id bigint, last_id bigint, value double", "first_id bigint, last_id bigint, value double", "update", GroupStateTimeout.NoTimeout
    )


def upserts_batch(events: DataFrame) -> DataFrame:
    """The same over a finished log."""
    return events.groupBy("scan_id", "kind", "key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("value", "id").alias("value"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per kind and tumbling window with a watermark for late ones."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n", "total")


def write(events: DataFrame, folder: str, checkpoint: str) -> None:
    """Append a stream to a folder exactly once, until nothing is left to read."""
    events.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()


def stage_durations(events: DataFrame) -> DataFrame:
    """(scan_id, id, seconds): time from each stage event of a scan to the next one."""
    w = Window.partitionBy("scan_id").orderBy("id")
    rows = events.filter("kind = 'stage'").withColumn("next", F.lead("ts").over(w))
    return rows.filter("next is not null").select("scan_id", "id", (F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


def last_activity(events: DataFrame, n: int = 300) -> DataFrame:
    """The last n events per scan."""
    w = Window.partitionBy("scan_id").orderBy(F.desc("id"))
    return events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("scan_id", "id", "kind")


def terminal_check(events: DataFrame) -> DataFrame:
    """(scan_id, n, gapless, closed): whether ids run from 1 without gaps and the last event is a status."""
    return events.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), (F.max("id") == F.count_distinct("id")).alias("gapless"), (F.max_by("kind", "id") == "status").alias("closed"))


def expired(events: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Scans whose last event is older than so many hours."""
    last = events.groupBy("scan_id").agg(F.max("ts").alias("last_ts"))
    return last.filter(F.col("last_ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))
