"""Percentiles per group by exact bisection on counts.

Every group and percentile keeps an interval that must hold its value. A pass counts the
rows of each interval below `ways - 1` evenly spaced midpoints and keeps the part in which
the target rank falls; after ``ceil(log_ways(range))`` passes the interval is one value.
Counts of separate partitions, files or days add up, so nothing but (value, count)
partials ever needs to be stored or combined, and no group is ever sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.durable import checkpoint, small

WAYS = 256


def partials(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(groups, value, n): the mergeable form; union the partials of several days and call this again with weight="n".

    Null and NaN values count for nothing. Values are kept as whole multiples of `resolution`
    (the stated error of fractional columns; whole numbers at resolution 1 are exact).
    """
    v = F.col(value).cast("double")
    exact = resolution == 1.0 and dict(df.dtypes)[value] in ("bigint", "int", "smallint", "tinyint")
    unit = F.col(value).cast("long") if exact else F.floor(v / F.lit(resolution)).cast("long")
    n = F.count(F.lit(1)) if weight is None else F.sum(F.coalesce(F.col(weight), F.lit(0)))
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(v))
    return kept.groupBy(*groups, unit.alias("_v")).agg(n.cast("long").alias("n")).filter("n > 0").withColumnRenamed("_v", value)


def bisect(parts: DataFrame, groups: Sequence[str], value: str, percents: Sequence[float], ways: int = WAYS) -> DataFrame:
    """(groups, percent, value, n_rows): nearest-rank percentiles of (value, n) partials.

    Rank = max(1, ceil(percent / 100 * n_rows)). An empty input gives no rows; null group
    keys form a group of their own; ties need no rule, as equal values have equal results.
    Only one row (range and group count) comes to the driver, to fix the number of passes.
    """
    groups = list(groups)
    keys = [f"_g{i}" for i in range(len(groups))]
    data = parts.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).alias("_v"), F.col("n").alias("_n"))
    data = checkpoint(data)
    totals = checkpoint(data.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")))
    span = totals.agg(F.max(F.col("_hi") - F.col("_lo")).alias("range"), F.count(F.lit(1)).alias("groups")).first()
    passes, width = 0, 1
    while span["range"] is not None and width <= span["range"]:
        passes, width = passes + 1, width * ways

    def rank(p: float) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_total") / F.lit(100.0))).cast("long")

    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p).alias("rank")) for p in percents])
    at = totals.select(*keys, "_total", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), wanted.alias("_want"))
    for _ in range(passes):
        at = _narrow(data, at, keys, ways, span["groups"] * len(percents))
    each = at.select(*keys, "_total", "_lo", F.explode("_want").alias("w"))
    return each.select(
        *[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("w.p").alias("percent"), F.col("_lo").alias(value), F.col("_total").alias("n_rows")
    )


def _narrow(data: DataFrame, at: DataFrame, keys: list[str], ways: int, rows: int) -> DataFrame:
    """One pass. Intervals of a group differ in `_lo`; percentiles in one interval are counted together."""
    left, right = data.alias("d"), small(at, rows).alias("i")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys] + [F.col("d._v").between(F.col("i._lo"), F.col("i._hi"))]
    step = F.greatest(F.lit(1), F.ceil((F.col("i._hi") - F.col("i._lo") + 1) / F.lit(float(ways)))).cast("long")
    hit = left.join(right, on).select(
        *[F.col(f"i.{k}").alias(k) for k in keys], "i._total", "i._lo", "i._hi", "i._below", "i._want", step.alias("_step"),
        F.expr("(d._v - i._lo) div greatest(1L, cast(ceil((i._hi - i._lo + 1) / %d.0D) as bigint))" % ways).alias("_bin"), "d._n",
    )
    counted = hit.groupBy(*keys, "_lo", "_bin").agg(
        F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_total", "_hi", "_below", "_want", "_step")]
    )
    cum = F.sum("_n").over(Window.partitionBy(*keys, "_lo").orderBy("_bin"))
    ranged = counted.withColumn("_upto", F.col("_below") + cum)
    inside = F.filter("_want", lambda w: (w["rank"] <= F.col("_upto")) & (w["rank"] > F.col("_upto") - F.col("_n")))
    low = F.col("_lo") + F.col("_bin") * F.col("_step")
    return ranged.withColumn("_want", inside).filter(F.size("_want") > 0).select(
        *keys, "_total", low.alias("_lo"), F.least(F.col("_hi"), low + F.col("_step") - 1).alias("_hi"),
        (F.col("_upto") - F.col("_n")).alias("_below"), "_want",
    )


def percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: Sequence[float], resolution: float = 1.0) -> DataFrame:
    """Partials and bisection in one call."""
    return bisect(partials(df, groups, value, resolution=resolution), groups, value, percents)


def call_latencies(calls: DataFrame, providers: DataFrame) -> DataFrame:
    """(model, call_day, latency_ms), one row per distinct successful call of a known model.

    A call is the latest-logged of the rows under its call_id. Calls with a null id, time or
    latency, or a latency of 0 or less, have none. `providers` is one row per model.
    """
    ok = calls.filter("status = 'ok' and latency_ms > 0 and call_id is not null and called_at is not null").select(
        "call_id", F.lower(F.trim("model")).alias("_m"), F.to_date("called_at").alias("_day"), "latency_ms", "logged_at"
    )
    once = ok.groupBy("call_id").agg(F.max(F.struct("logged_at", "_m", "_day", "latency_ms")).alias("c")).select("c._m", "c._day", "c.latency_ms")
    names = providers.filter("model is not null").groupBy(F.lower(F.trim("model")).alias("_m")).agg(F.min("model").alias("model"))
    return once.join(names, "_m").select("model", F.date_format("_day", "yyyy-MM-dd").alias("call_day"), "latency_ms")
