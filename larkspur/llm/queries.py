"""The queries of the training-data operators over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import consensus, credentials, mixing, packing, parsing, percentiles, provenance, quality, splitting, survivors
from larkspur.operators import texts
from larkspur.plans import views as V
from larkspur.plans.durable import table

Query = Callable[[SparkSession, str], DataFrame]


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.call_latencies(table(spark, d, "calls"), table(spark, d, "provider_status"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, d, "source_files"))


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "source_files"))


def p1_findings(spark: SparkSession, d: str) -> DataFrame:
    kept = provenance.hand_written_findings(table(spark, d, "findings"), table(spark, d, "source_files"))
    return kept.select("finding_id", "repository", "file_path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.unreliable(table(spark, d, "rating_sheet"))


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "rating_sheet"))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "rating_sheet"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.accuracies(consensus.ratings(table(spark, d, "rating_sheet")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(table(spark, d, "chunks"), table(spark, d, "findings"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "chunks"), table(spark, d, "findings"))


def sensitive_lines(spark: SparkSession, d: str) -> DataFrame:
    findings = table(spark, d, "findings")
    known = texts.quoted_secrets(findings).unionByName(credentials.values(findings))
    reported = texts.reported_lines(V.findings(spark, d), table(spark, d, "source_files"))
    return texts.sensitive_lines(V.lines(spark, d), reported, known.select(F.sha1("v").alias("sha1")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "findings")).select("first_id", "best_id")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "findings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid(table(spark, d, "source_files"))


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return parsing.verdicts(table(spark, d, "source_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    daily = percentiles.percentiles(_latencies(spark, d), ["model", "call_day"], "latency_ms", [95])
    limits = table(spark, d, "provider_status").select("model", "p95_limit_ms")
    return daily.join(limits, "model").filter("latency_ms > p95_limit_ms").select("model", "call_day")


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_latencies(spark, d), ["model", "call_day"], "latency_ms", [50, 90, 95, 99])


def p6_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles over the days of a week from the days' partials alone."""
    days = percentiles.partials(_latencies(spark, d), ["model", "call_day"], "latency_ms")
    weeks = days.withColumn("week", F.date_format(F.trunc(F.to_date("call_day"), "week"), "yyyy-MM-dd"))
    merged = percentiles.partials(weeks, ["model", "week"], "latency_ms", weight="n")
    return percentiles.bisect(merged, ["model", "week"], "latency_ms", [50, 95])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.boundaries(table(spark, d, "chunks")).select("chunk_id", "line_no")


def p7_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return splitting.boundaries(table(spark, d, "chunks"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.containers(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_kinds, p1_findings, p2_found, p2_consensus, p2_agreement, p2_reliability, p3_found, p3_redacted, p4_found, p4_survivors, p5_found, p5_verdicts,
        p5_rates, p6_found, p6_daily, p6_weekly, p7_found, p7_boundaries, p7_pieces, p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_statistics,
        sensitive_lines,
    )
}

_CALLS = """with latest as (
  select call_id, lower(trim(model)) as m, strftime(called_at, '%Y-%m-%d') as call_day, latency_ms,
         row_number() over (partition by call_id order by logged_at desc) as k
  from calls where status = 'ok' and latency_ms > 0 and called_at is not null
), ok as (select p.model, l.call_day, l.latency_ms, p.p95_limit_ms from latest l join provider_status p on l.m = lower(trim(p.model)) where k = 1)"""

_SCORES = """with latest as (
  select *, row_number() over (partition by rater, item order by rated_at desc, rating_id desc) as k from rating_sheet
), long as (
  select item, 'correctness' as criterion, try_cast(trim(correctness) as double) as score from latest where k = 1
  union all select item, 'usefulness', try_cast(trim(usefulness) as double) from latest where k = 1
  union all select item, 'clarity', try_cast(trim(clarity) as double) from latest where k = 1
), scores as (select * from long where score in (1, 2, 3, 4, 5))"""

ORACLES: dict[str, str] = {
    "p2_agreement": _SCORES + """, items as (
  select item, criterion, count(*) as n, sum(score) as s, sum(score * score) as q from scores group by 1, 2 having count(*) > 1
), total as (
  select criterion, count(*) as n_items, sum(n) as n_all, sum(s) as s, sum(q) as q, sum(2 * (n * q - s * s) / (n - 1)) as seen from items group by 1
) select criterion, n_items, cast(n_all as bigint) as n_scores, round(1 - seen / (2 * (n_all * q - s * s) / (n_all - 1)), 9) as alpha from total""",
    "p4_found": r"""with latest as (
  select *, row_number() over (partition by finding_id order by loaded_at desc) as k from findings
  where repository is not null and file_path is not null and issue_key is not null and start_line is not null
), rows_ as (
  select *, case when confidence > 1 then confidence / 100 else confidence end as conf, trim(message) as m,
    len(list_distinct(list_filter(list_transform(sources, lambda s: lower(trim(s))), lambda s: s is not null and s <> ''))) as n_src
  from latest where k = 1
), marked as (
  select *, case when start_line - lag(start_line) over w <= 2 then 0 else 1 end as fresh from rows_ window w as (partition by repository, file_path, issue_key order by start_line, finding_id)
), issues as (
  select *, sum(fresh) over (partition by repository, file_path, issue_key order by start_line, finding_id) as issue from marked
), ranked as (
  select *, min(finding_id) over g as first_id, count(*) over g as n, row_number() over (partition by repository, file_path, issue_key, issue order by
    case when m is not null and length(m) >= 5 and not ends_with(m, '...') and not ends_with(m, '…') then 0 else 1 end, n_src desc, conf desc nulls last, reported_at desc nulls last, finding_id) as place
  from issues window g as (partition by repository, file_path, issue_key, issue)
) select first_id, finding_id as best_id from ranked where n > 1 and place = 1""",
    "p6_found": _CALLS + " select model, call_day from ok group by model, call_day having quantile_disc(latency_ms, 0.95) > max(p95_limit_ms)",
    "p6_daily": _CALLS + """, each as (
  select model, call_day, count(*) as n_rows, quantile_disc(latency_ms, 0.5) as a, quantile_disc(latency_ms, 0.9) as b, quantile_disc(latency_ms, 0.95) as c, quantile_disc(latency_ms, 0.99) as d from ok group by 1, 2
) select model, call_day, 50.0::double as percent, a as latency_ms, n_rows from each union all select model, call_day, 90.0::double, b, n_rows from each
union all select model, call_day, 95.0::double, c, n_rows from each union all select model, call_day, 99.0::double, d, n_rows from each""",
    "p6_weekly": _CALLS + """, each as (
  select model, strftime(date_trunc('week', cast(call_day as date)), '%Y-%m-%d') as week, count(*) as n_rows, quantile_disc(latency_ms, 0.5) as a, quantile_disc(latency_ms, 0.95) as b from ok group by 1, 2
) select model, week, 50.0::double as percent, a as latency_ms, n_rows from each union all select model, week, 95.0::double, b, n_rows from each""",
}
