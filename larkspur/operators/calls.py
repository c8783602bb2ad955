"""Records of model calls: usage, percentiles, rates and routing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses under which a provider worked on a file (fixed values).
WORKED = ("ok", "rejected", "unavailable", "rate_limited")


def provider_usage(calls: DataFrame) -> DataFrame:
    """Per provider over calls that were made: attempts, answers, failures, nearest-rank p50 and p95 of answers, and files worked on."""
    made = calls.filter("status not in ('skipped', 'cached')")
    return made.groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") == "ok").alias("answered"), F.count_if(F.col("status") != "ok").alias("failed"),
        F.expr("coalesce(percentile_disc(0.5) within group (order by latency_ms) filter (where status = 'ok'), 0)").cast("bigint").alias("p50"),
        F.expr("coalesce(percentile_disc(0.95) within group (order by latency_ms) filter (where status = 'ok'), 0)").cast("bigint").alias("p95"),
        F.count_distinct(F.when(F.col("status").isin(*WORKED), F.struct("repository", "file_path"))).alias("n_files"),
    )


def provenance(calls: DataFrame) -> DataFrame:
    """Per provider: answers of the cache count, tokens over answers, other outcomes as `status:n` in order of status."""
    answered = F.col("status").isin("ok", "cached")
    n = calls.groupBy("provider", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(answered, F.coalesce("input_tokens", F.lit(0))).otherwise(0)).alias("tin"), F.sum(F.when(answered, F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias("tout")
    )
    other = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~answered, F.struct("status", "n")))), lambda s: F.concat_ws(":", s["status"], s["n"].cast("string"))), " ")
    return n.groupBy("provider").agg(F.sum(F.when(answered, F.col("n")).otherwise(0)).alias("answered"), F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), other.alias("other"))


def totals(calls: DataFrame) -> DataFrame:
    """Calls, answers, those that fell through, providers, tokens and the upper of the middle latencies."""
    ok = F.col("status") == "ok"
    return calls.agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(ok).alias("answered"), F.count_if(F.col("status").isin("rejected", "unavailable", "rate_limited")).alias("fell_through"), F.count_distinct("provider").alias("providers"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )


def order_statistics(calls: DataFrame) -> DataFrame:
    """Per provider over answers, the four definitions side by side: nearest-rank p95, inclusive-linear p95, median of two middles, upper middle."""
    ok = calls.filter("status = 'ok' and latency_ms is not null")
    return ok.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.expr("cast(percentile_disc(0.95) within group (order by latency_ms) as bigint)").alias("p95_nearest"), F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("p95_linear"),
        F.round(F.median("latency_ms"), 6).alias("median_mean"),
    ).join(_upper_middle(ok), "provider")


def _upper_middle(ok: DataFrame) -> DataFrame:
    """The value at position floor(n / 2) from 0: found by rank, so no group is collected."""
    w = Window.partitionBy("provider").orderBy("latency_ms", "call_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("provider"))
    return ok.select("provider", F.col("latency_ms").alias("median_upper"), (F.row_number().over(w) - 1).alias("k"), n.alias("n")).filter("k = n div 2").select("provider", "median_upper")


def status_pivot(calls: DataFrame) -> DataFrame:
    """Provider by status."""
    statuses = ["ok", "cached", "rejected", "unavailable", "rate_limited", "skipped"]
    return calls.groupBy("provider").pivot("status", statuses).agg(F.count(F.lit(1))).na.fill(0)


def cost_by_task(calls: DataFrame) -> DataFrame:
    """Answered tokens and time per task, with and without verification."""
    ok = calls.filter("status = 'ok'")
    plain = F.col("task") != "verify"
    return ok.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(plain).alias("n_unverified"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("tokens_all"), F.sum(F.when(plain, F.coalesce("output_tokens", F.lit(0))).otherwise(0)).alias("tokens_unverified"),
    )


def observed_rate(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """The largest number of calls of a provider within any window of so many seconds that ends with a call.

    Calls are counted per second first, so the range frame runs over one row a second at most; its partitions are days, with the window's
    tail of the day before added, so that no provider is one task.
    """
    per = calls.filter("called_at is not null and status != 'skipped'").groupBy("provider", F.unix_seconds(F.col("called_at").cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    day = 86_400
    spread = per.select("provider", "at", "n", F.explode(F.when(F.pmod("at", F.lit(day)) >= day - seconds, F.array(F.floor(F.col("at") / day), F.floor(F.col("at") / day) + 1)).otherwise(F.array(F.floor(F.col("at") / day)))).alias("day"))
    frame = Window.partitionBy("provider", "day").orderBy("at").rangeBetween(-(seconds - 1), 0)
    counted = spread.withColumn("in_window", F.sum("n").over(frame)).filter(F.floor(F.col("at") / day) == F.col("day"))
    return counted.groupBy("provider").agg(F.max("in_window").alias("busiest"))


def cache_hits(calls: DataFrame) -> DataFrame:
    """Per provider, calls whose key (task, model, path) was called before, and that share."""
    key = F.sha2(F.to_json(F.array("task", "model", "repository", "file_path"), {"ignoreNullFields": "false"}), 256)
    rows = calls.filter("file_path is not null").withColumn("key", key)
    per_key = rows.groupBy("provider", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("provider").agg(F.sum("n").alias("n_calls"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("n") - 1).alias("n_repeats"))


def route_candidates(routes: DataFrame, providers: DataFrame) -> DataFrame:
    """(task, pos, provider): a route's providers that are configured and whose breaker is not open, in order."""
    return routes.join(providers.filter("breaker_state != 'open'").select("provider", "is_external"), "provider").select("task", "pos", "provider", "is_external")


def last_calls(calls: DataFrame, k: int = 14) -> DataFrame:
    """The last k calls per provider: a lane of recent activity."""
    w = Window.partitionBy("provider").orderBy(F.desc("called_at"), F.desc("call_id"))
    return calls.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("provider", "k", "call_id", "status")


def latency_benchmark(calls: DataFrame) -> DataFrame:
    """Per task: inclusive p50 and p95 of answers, and answers a minute at the median."""
    ok = calls.filter("status = 'ok' and latency_ms > 0")
    both = ok.groupBy("task").agg(F.percentile("latency_ms", F.lit(0.5)).alias("a"), F.percentile("latency_ms", F.lit(0.95)).alias("b"), F.count(F.lit(1)).alias("n"))
    return both.select("task", "n", F.bround("a").cast("bigint").alias("p50"), F.bround("b").cast("bigint").alias("p95"), F.round(60000.0 / F.col("a"), 6).alias("per_minute"))
