"""All queries of the engine by name, and the SQL twins they are checked against.

The twins are written from the meaning of each query, not from its plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C
from larkspur.operators import agreement, calls, matching, reports, routing, texts
from larkspur.operators import findings as fnd
from larkspur.plans import views as V
from larkspur.plans.durable import table
from larkspur.sources import plugins, tools
from larkspur.streaming import log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_MODELS = "('" + "', '".join(D.MODELS) + "')"
_RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 when 'info' then 0 end"
#: Findings as the views have them: latest rows, normal sources and confidence.
_F = f"""with latest as (
  select * exclude (sources, confidence), sources as raw, case when confidence > 1 then confidence / 100 else confidence end as confidence,
    row_number() over (partition by finding_id order by loaded_at desc) as rn from findings
), src as (
  select finding_id, s, min(i) as i from (select finding_id, lower(trim(unnest(raw))) as s, generate_subscripts(raw, 1) as i from latest where rn = 1) where s is not null and s <> '' group by 1, 2
), lists as (select finding_id, list(s order by i) as sources, bool_and(s in {_MODELS}) as models_only from src group by 1),
f as (
  select l.* exclude (rn, raw), coalesce(k.sources, []) as sources, coalesce(k.models_only, true) as models_only, {_RANK} as sev_rank, l.finding_id as ord
  from latest l left join lists k using (finding_id) where rn = 1
), g as (
  select *, models_only and coalesce(confidence < 0.6, false) as weak, coalesce(status in ('open', 'needs_review', 'accepted'), false) as live from f
), r as (select * from g where live and not weak)"""
_FILES = "files as (select * from (select *, row_number() over (partition by repository, file_path order by ingested_at desc, file_id desc) as rn from source_files where repository is not null and file_path is not null) where rn = 1)"
_LINES = """lines as (
  select file_id, repository, file_path, line_no, regexp_replace(t, '\\r$', '') as text from (
    select file_id, repository, file_path, generate_subscripts(p, 1) as line_no, unnest(p) as t from (
      select *, case when right(content, 1) = chr(10) or content = '' then string_split(content, chr(10))[:-2] else string_split(content, chr(10)) end as p from source_files where content is not null)))"""
_CALLS = "c as (select * exclude (rn, model), lower(trim(model)) as model from (select *, row_number() over (partition by call_id order by logged_at desc) as rn from calls) where rn = 1)"
_RATINGS = """latest as (select *, row_number() over (partition by rater, item order by rated_at desc, rating_id desc) as k from rating_sheet),
long as (select rater, item, 'correctness' as criterion, try_cast(trim(correctness) as double) as s from latest where k = 1 union all
  select rater, item, 'usefulness', try_cast(trim(usefulness) as double) from latest where k = 1 union all select rater, item, 'clarity', try_cast(trim(clarity) as double) from latest where k = 1),
t as (select rater, item, criterion, cast(s as int) as score from long where s in (1, 2, 3, 4, 5))"""
_LABELS = "lab as (select *, coalesce(try_cast(nullif(split_part(line_range, '-', 2), '') as int), s) as e from (select item as label_id, repository, file_path, line_range, category, try_cast(split_part(line_range, '-', 1) as int) as s from rating_items) where s is not null)"
_EVENTS = """ev as (select user_id as scan_id, row_number() over (partition by user_id order by event_id) as id, ts, event_id, value, cast(json_extract_string(props, '$.k') as int) as key,
  case event_type when 'view' then 'stage' when 'click' then 'tool' when 'signup' then 'finding' when 'purchase' then 'llm_call' when 'error' then 'status' end as kind from events)"""


# -- findings ---------------------------------------------------------------------------------------------------


@query(_F + ", " + _FILES + """, p as (select repository, sum(case severity when 'critical' then 25 when 'high' then 10 when 'medium' then 4 when 'low' then 1 else 0 end) as points, count(*) as n_reported from r group by 1),
s as (select repository, sum(coalesce(line_count, 0)) as lines, count(*) as n_files from files group by 1),
k as (select repository, count(distinct file_path) as n_complex from f where issue_key = 'complex-function' group by 1),
j as (select s.repository, n_files, cast(lines as bigint) as lines, coalesce(n_reported, 0) as n_reported, coalesce(points, 0) / greatest(1.0, lines / 1000.0) as a, 20.0 * coalesce(n_complex, 0) / n_files as b
  from s left join p using (repository) left join k using (repository)),
z as (select *, cast(greatest(0, least(100, round_even(cast(100 - a - b as double), 0))) as int) as score from j)
select repository, n_files, lines, n_reported, round(cast(a as double), 6) as finding_penalty, round(cast(b as double), 6) as complexity_penalty, score,
  case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'E' end as grade from z""")  # fmt: skip
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return fnd.quality_score(V.findings(spark, d), V.files(spark, d))


@query(_F + """, n as (
  select repository, 'all' as dimension, '' as value, count(*) as n, min(ord) as first_seen from r group by 1 union all
  select repository, 'severity', severity, count(*), min(ord) from r group by 1, 3 union all select repository, 'category', category, count(*), min(ord) from r group by 1, 3)
select repository, dimension, value, n, cast(row_number() over (partition by repository, dimension order by n desc, first_seen) as int) as place from n""")
def headline_counts(spark: SparkSession, d: str) -> DataFrame:
    return fnd.headline_counts(V.findings(spark, d))


@query(_F + " select repository, count(*) filter (where status = 'dismissed_by_ai') as dismissed, count(*) filter (where status = 'rejected') as rejected, count(*) filter (where live and weak) as below_confidence, count(*) as n_all from g group by 1")
def hidden_counts(spark: SparkSession, d: str) -> DataFrame:
    return fnd.hidden_counts(V.findings(spark, d))


@query(_F + " select finding_id, case when status = 'dismissed_by_ai' then 'dismissed' when status = 'rejected' then 'rejected' else printf('confidence %.2f', confidence) end as reason from g where status in ('dismissed_by_ai', 'rejected') or weak")
def hidden_reasons(spark: SparkSession, d: str) -> DataFrame:
    return fnd.hidden_reasons(V.findings(spark, d))


@query(_F + """ select finding_id, sev_rank, models_only, weak, live and not weak as reported, coalesce(category = 'security' and sev_rank >= 3, false) as protected,
  list_contains(sources, 'ruff') and coalesce(regexp_matches(rule_id, '^(E1|E2|E3|E5|W|I|Q|COM)'), false) as formatting from g""")
def finding_flags(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    s, c = F.col("sources"), F.col("confidence")
    return f.select(
        "finding_id", "sev_rank", C.is_model_only(s).alias("models_only"), C.is_unconfident(s, c).alias("weak"), C.is_reported(F.col("status"), s, c).alias("reported"), C.is_protected(F.col("category"), F.col("severity")).alias("protected"),
        C.is_formatting_only(s, F.col("rule_id")).alias("formatting"),
    )


@query(_F + " select finding_id, severity from g where models_only and status = 'open' and sev_rank >= 2")
def needs_verification(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return f.filter(C.needs_verification(F.col("sources"), F.col("status"), F.col("severity"), 2)).select("finding_id", "severity")


@query(_F + ", e(tool, rule, kind) as (values " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in D.EQUIVALENT_RULES) + """)
select finding_id, case when sources[1] = 'detect-secrets' then 'hardcoded-credential' else coalesce(e.kind, coalesce(sources[1] || ':', '') || coalesce(rule_id, '')) end as kind
from f left join e on e.tool = sources[1] and e.rule = rule_id""")
def issue_kinds(spark: SparkSession, d: str) -> DataFrame:
    return fnd.issue_key(V.findings(spark, d)).select("finding_id", "kind")


@query(_F + """, b as (select *, row_number() over (partition by repository, file_path, start_line, issue_key, sources[1] order by ord) as bucket from f where issue_key is not null and start_line is not null),
q as (select repository, file_path, start_line, issue_key, bucket, max(end_line) as end_line, max(confidence) as confidence, count(*) as n_merged,
  first(finding_id order by sev_rank desc, coalesce(confidence, -1) desc, ord) as finding_id, first(severity order by sev_rank desc, coalesce(confidence, -1) desc, ord) as severity,
  coalesce(first(cwe order by sev_rank desc, coalesce(confidence, -1) desc, ord), first(cwe order by ord) filter (where cwe is not null)) as cwe from b group by 1, 2, 3, 4, 5)
select finding_id, repository, file_path, start_line, end_line, issue_key as kind, cast(bucket as int) as bucket, severity, round(confidence, 6) as confidence, cwe, n_merged from q""")
def dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).filter("issue_key is not null and start_line is not null")
    return fnd.dedupe(f, F.col("issue_key")).select("finding_id", "repository", "file_path", "start_line", "end_line", "kind", "bucket", "severity", F.round("confidence", 6).alias("confidence"), "cwe", "n_merged")


@query(_F + ", " + _FILES + ", n as (select repository, file_path, count(*) as n, max(sev_rank) as m from r group by 1, 2) select files.repository, files.file_path, file_language, coalesce(n, 0) as n, ['info', 'low', 'medium', 'high', 'critical'][cast(m as int) + 1] as highest from files left join n using (repository, file_path)")
def file_entries(spark: SparkSession, d: str) -> DataFrame:
    return fnd.file_entries(V.findings(spark, d), V.files(spark, d))


@query(_F + " select repository, file_path, count(*) as n, min(ord) as first_seen from r group by 1, 2 order by n desc, first_seen limit 5")
def top_files(spark: SparkSession, d: str) -> DataFrame:
    return fnd.top_files(V.findings(spark, d))


@query(_F + ", n as (select repository, rule_id, count(*) as n from f where rule_id is not null group by 1, 2), p as (select *, cast(row_number() over (partition by repository order by n desc, rule_id) as int) as place from n) select * from p where place <= 3")
def top_rules(spark: SparkSession, d: str) -> DataFrame:
    return fnd.top_rules(V.findings(spark, d))


@query(_F + """, q as (select repository, file_path, count(*) as n, max(sev_rank) as rank from r group by 1, 2), s as (select *, string_split(file_path, '/') as p from q),
a as (select repository, n, rank, array_to_string(p[:k], '/') as folder from s, lateral (select unnest(range(1, len(p))) as k))
select repository, folder, cast(sum(n) as bigint) as n, max(rank) as rank from a group by 1, 2""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return fnd.folder_rollup(V.findings(spark, d))


@query(_F + """, p as (select *, row_number() over (partition by repository order by sev_rank desc, file_path, start_line nulls first, ord) as place from r),
m as (select repository, count(*) - 30 as more from r group by 1 having count(*) > 30)
select repository, cast(place as int) as place, '[' || severity || '] ' || file_path || ':' || start_line || ' ' || case when length(t) > 80 then rtrim(t[:79]) || '…' else t end as text from (select *, trim(regexp_replace(title, '\\s+', ' ', 'g')) as t from p where place <= 30)
union all select repository, 31, 'and ' || more || ' more' from m""")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return fnd.summary_lines(V.findings(spark, d))


@query(_F + """, q as (select *, coalesce(nullif(rule_id, ''), sources[1]) as rule from r), tg as (select rule, category as t from q where category is not null union select rule, 'external/cwe/' || lower(cwe) from q where cwe is not null),
ts as (select rule, string_agg(t, ',' order by t) as tags from tg group by 1),
u as (select rule, min(ord) as first_seen, first(title order by ord) as first_title, max(sev_rank) filter (where category = 'security') as security_rank, count(*) as n from q group by 1)
select cast(row_number() over (order by first_seen) - 1 as int) as rule_index, u.rule as rule_id, first_title, coalesce(tags, '') as tags, security_rank, n from u left join ts on ts.rule is not distinct from u.rule""")
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    return fnd.sarif_rules(V.findings(spark, d))


_PRINT = """sha256(coalesce(coalesce(nullif(rule_id, ''), sources[1]) || chr(31), '') || file_path || chr(31) || coalesce(nullif(trim(regexp_replace(evidence, '\\s+', ' ', 'g')), ''), trim(regexp_replace(title, '\\s+', ' ', 'g'))))"""


@query(_F + f""", q as (select *, coalesce(nullif(rule_id, ''), sources[1]) as rule, {_PRINT} as print, coalesce(message, title) as said from r)
select finding_id, '{{' || coalesce('"ruleId":' || to_json(rule)::varchar || ',', '') || '"level":"' || case when sev_rank >= 3 then 'error' when sev_rank = 2 then 'warning' else 'note' end || '","message":{{' || coalesce('"text":' || to_json(said)::varchar, '') || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{' || coalesce('"uri":' || to_json(file_path)::varchar, '')
  || '}},"region":{{' || concat_ws(',', '"startLine":' || start_line, '"endLine":' || end_line) || '}}}}}}],"partialFingerprints":{{' || coalesce('"v1":"' || print || '"', '') || '}}}}' as result from q""")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return fnd.sarif_results(V.findings(spark, d))


@query(_F + """ select finding_id, sha256(coalesce(coalesce(nullif(rule_id, ''), sources[1]) || chr(31), '') || file_path || chr(31) ||
  coalesce(nullif(trim(regexp_replace(evidence, '\\s+', ' ', 'g')), ''), trim(regexp_replace(title, '\\s+', ' ', 'g')))) as fingerprint from f where title is not null""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).filter("title is not null")
    return f.select("finding_id", C.fingerprint(C.rule_or_source(F.col("rule_id"), F.col("sources")), F.col("file_path"), F.col("evidence"), F.col("title")).alias("fingerprint"))


@query(_F + " select finding_id from g where sev_rank >= 1 and not models_only and (contains(lower(coalesce(title, '')), 'line') or contains(lower(coalesce(message, '')), 'line') or contains(lower(file_path), 'line'))")
def findings_filter(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return f.filter((F.col("sev_rank") >= 1) & ~C.is_model_only(F.col("sources")) & C.matches_query("LINE", F.col("title"), F.col("message"), F.col("file_path"))).select("finding_id")


@query(_F + " select repository, bool_or(sev_rank >= 3) as failed from r group by 1")
def fail_on_gate(spark: SparkSession, d: str) -> DataFrame:
    return fnd.reported(V.findings(spark, d)).groupBy("repository").agg(F.bool_or(F.col("sev_rank") >= 3).alias("failed"))


@query("""with o as (select * from (select *, row_number() over (partition by finding_id order by loaded_at) as a, row_number() over (partition by finding_id order by loaded_at desc) as b from findings))
select n.finding_id from o n left join o p on p.finding_id = n.finding_id and p.a = 1 where n.b = 1 and (p.finding_id is null or n.loaded_at <> p.loaded_at)""")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "findings").select("finding_id", "loaded_at", "status")
    first = raw.groupBy("finding_id").agg(F.min_by("status", "loaded_at").alias("status"), F.min("loaded_at").alias("loaded_at"))
    last = raw.groupBy("finding_id").agg(F.max_by("status", "loaded_at").alias("status"), F.max("loaded_at").alias("loaded_at"))
    return fnd.changed_rows(first, last, "finding_id").select("finding_id")


@query(_F + ", s(severity, rank) as (values ('info', 0), ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)), x as (select distinct repository from f) select repository, s.severity, count(r.finding_id) as n from x cross join s left join r using (repository, severity) group by 1, 2")
def severity_counts_dense(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    wide = f.select("repository").distinct().select("repository", F.explode(F.array(*[F.lit(s) for s in D.SEVERITIES])).alias("severity"))
    n = fnd.reported(f).groupBy("repository", "severity").agg(F.count(F.lit(1)).alias("n"))
    return wide.join(n, ["repository", "severity"], "left").na.fill(0, ["n"])


@query(_F + " select repository, file_path, start_line, count(*) as n, first(finding_id order by sev_rank desc, ord) as gravest from r where start_line is not null group by 1, 2, 3")
def line_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = fnd.reported(V.findings(spark, d)).filter("start_line is not null")
    return rows.groupBy("repository", "file_path", "start_line").agg(F.count(F.lit(1)).alias("n"), F.max_by("finding_id", F.struct("sev_rank", -F.col("ord"))).alias("gravest"))


# -- files, lines and ranges ------------------------------------------------------------------------------------


@query("select file_id, size_bytes, case when list_has_any(string_split(lower(regexp_replace(file_path, '/[^/]*$', '')), '/'), [" + ", ".join(f"'{x}'" for x in D.EXCLUDED_DIRS) + "]) and contains(file_path, '/') then 'excluded_directory' when lower(regexp_extract(file_path, '([^/]*)$', 1)) in (" + ", ".join(f"'{x}'" for x in D.LOCKFILES) + ") then 'lockfile' when regexp_matches(lower(file_path), '(\\.min\\.js|\\.min\\.mjs|\\.min\\.css|\\.js\\.map|\\.css\\.map)$') then 'generated' when size_bytes > 1000000 then 'too_large' end as reason from source_files")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files")
    reason = F.coalesce(C.skip_reason_for_path(F.col("file_path")), C.skip_reason_for_content(F.col("size_bytes"), F.col("content")))
    return rows.select("file_id", "size_bytes", reason.alias("reason"))


@query("""select finding_id, case when p like '/%' or regexp_matches(p, '^[A-Za-z]:') or list_contains(string_split(p, '/'), '..') then 'path_traversal'
  when length(p) > 400 or regexp_matches(p, '[<>:"|?*]') or regexp_matches(p, '[. ](/|$)') then 'invalid_path' end as rejection
from (select finding_id, case finding_id % 5 when 0 then '/' || file_path when 1 then replace(file_path, '/', '\\') when 2 then '../' || file_path when 3 then file_path || '?' else file_path end as p from (select distinct finding_id, file_path from findings where file_path is not null)) t(finding_id, p)""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").filter("file_path is not null").select("finding_id", "file_path").distinct()
    k, p = F.col("finding_id") % 5, F.col("file_path")
    name = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.replace(p, F.lit("/"), F.lit("\\"))).when(k == 2, F.concat(F.lit("../"), p)).when(k == 3, F.concat(p, F.lit("?"))).otherwise(p)
    return rows.select("finding_id", C.path_rejection(name).alias("rejection"))


@query("select file_id, regexp_matches(file_path, '^(.*/)?tests/.*$') or regexp_matches(file_path, '^lib/[^/]*(/.*)?$') as excluded from source_files")
def glob_exclude(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files")
    p = F.col("file_path")
    return rows.select("file_id", (p.rlike(C.glob_pattern("*tests")) & p.rlike("(^|/)tests/") | p.rlike(C.glob_pattern("lib"))).alias("excluded"))


@query("""select file_id, list_has_any(string_split(lower(regexp_replace(file_path, '[^/]*$', '')), '/'), ['test', 'tests', 'testing', 'spec', 'specs', '__tests__', 'testdata', 'fixture', 'fixtures'])
  or regexp_matches(stem, '^test_') or stem = 'conftest' or regexp_matches(stem, '(_test|\\.test|_spec|\\.spec)$') as is_test from (select file_id, file_path, lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')) as stem from source_files)""")
def test_path_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", C.is_test_path(F.col("file_path")).alias("is_test"))


@query("select file_id, case lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) when '.py' then 'python' when '.pyi' then 'python' when '.js' then 'javascript' when '.jsx' then 'javascript' when '.mjs' then 'javascript' when '.cjs' then 'javascript' when '.ts' then 'typescript' when '.mts' then 'typescript' when '.cts' then 'typescript' when '.tsx' then 'tsx' when '.java' then 'java' when '.go' then 'go' end as language from source_files")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files")
    return rows.select("file_id", C.detect_language(F.col("file_path"), F.substring_index(F.coalesce("content", F.lit("")), "\n", 1)).alias("language"))


@query("with " + _LINES + " select file_id, count(*) as n_lines, count(*) filter (where trim(text) = '') as n_blank, max(length(text)) as longest, count(*) filter (where length(text) > 120) as n_long from lines group by 1")
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    return texts.line_statistics(V.lines(spark, d))


@query("with " + _LINES + ", n as (select file_id, count(*) as n from lines group by 1) select file_id, cast(w as int) as \"window\", cast(w * 40 + 1 as int) as start_line, cast(least(n, (w + 1) * 40) as int) as end_line from n, lateral (select unnest(range(0, (n - 1) // 40 + 1)) as w)")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    return texts.line_windows(table(spark, d, "source_files"))


@query("with " + _LINES + ", q as (select file_id, line_no, line_no - row_number() over (partition by file_id order by line_no) as g from lines where trim(text, ' ') <> '') select file_id, cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line from q group by file_id, g")
def paragraph_islands(spark: SparkSession, d: str) -> DataFrame:
    return texts.paragraphs(V.lines(spark, d))


_SEGMENTS = ("with recursive " + _LINES + """, q as (select file_id, line_no, line_no - row_number() over (partition by file_id order by line_no) as g from lines where trim(text, ' ') <> ''), isl as (select file_id, cast(min(line_no) as int) as a, cast(max(line_no) as int) as b from q group by file_id, g),
s as materialized (select *, row_number() over (partition by file_id order by a) as i from isl)""")
#: Greedy packing of the segments `s` (file_id, i, a, b): the group's first line moves on when the group would span over 60 lines.
_PACKED = """, p(file_id, i, first) as (select file_id, i, a from s where i = 1 union all select s.file_id, s.i, case when s.b - p.first + 1 > 60 then s.a else p.first end from p join s on s.file_id = p.file_id and s.i = p.i + 1),
groups as (select file_id, first as start_line, max(b) as end_line from p join s using (file_id, i) group by 1, 2)"""


@query(_SEGMENTS + _PACKED + " select * from groups")
def pack_segments(spark: SparkSession, d: str) -> DataFrame:
    return texts.pack_segments(texts.paragraphs(V.lines(spark, d)))


@query("""with c as (select distinct chunk_id, start_line, context from chunks where chunk_id is not null and start_line is not null and context is not null),
x as (select chunk_id, start_line, r.start_line as a, r.end_line as b, k from (select chunk_id, start_line, unnest(context) as r, generate_subscripts(context, 1) as k from c)),
cut as (select *, least(b, start_line - 1) as e from x), used as (select *, coalesce(sum(greatest(0, e - a + 1)) over (partition by chunk_id order by k rows between unbounded preceding and 1 preceding), 0) as before from cut),
kept as (select chunk_id, a, least(e, a + 40 - before - 1) as e from used where e >= a and before < 40), grp as (select *, case when a <= max(e) over w + 1 then 0 else 1 end as fresh from kept window w as (partition by chunk_id order by a, e rows between unbounded preceding and 1 preceding)),
isl as (select *, sum(fresh) over (partition by chunk_id order by a, e) as g from grp), merged as (select chunk_id, min(a) as a, max(e) as e from isl group by chunk_id, g),
shown as (select chunk_id, '[' || string_agg('{"start":' || a || ',"end":' || e || '}', ',' order by a) || ']' as shown from merged group by 1)
select chunk_id, coalesce(shown, '[]') as shown from c left join shown using (chunk_id)""")
def chunk_context(spark: SparkSession, d: str) -> DataFrame:
    c = V.chunks(spark, d).filter("start_line is not null and context is not null")
    ranges = F.transform("context", lambda r: F.struct(r["start_line"].alias("start"), r["end_line"].alias("end")))
    return c.select("chunk_id", F.to_json(texts.select_context(ranges, F.col("start_line"))).alias("shown"))


@query("with " + _LINES + """, w as (select *, cast(max(length(cast(line_no as varchar))) over (partition by file_id) as int) as width, line_no - lag(line_no) over (partition by file_id order by line_no) as step from lines where trim(text, ' ') <> '')
select file_id, string_agg(case when step > 1 then repeat(' ', width) || ' | ...' || chr(10) else '' end || lpad(cast(line_no as varchar), width, ' ') || ' | ' || text, chr(10) order by line_no) as numbered_code from w group by 1""")
def numbered_rendering(spark: SparkSession, d: str) -> DataFrame:
    return texts.numbered(V.lines(spark, d).filter("trim(text) != ''"), ["file_id"])


@query("with " + _LINES + _F.replace("with latest", ", latest", 1) + """, n as (select finding_id, repository, file_path, start_line, greatest(start_line, least(coalesce(end_line, start_line), start_line + 4)) as last from f where evidence is null and start_line is not null)
select finding_id, string_agg(rtrim(text, ' '), chr(10) order by line_no) as evidence from n join (select * from lines where file_id in (select file_id from (select file_id, row_number() over (partition by repository, file_path order by ingested_at desc, file_id desc) as k from source_files) where k = 1)) l
  on l.repository = n.repository and l.file_path = n.file_path and line_no between start_line and last group by 1 having trim(string_agg(rtrim(text, ' '), chr(10) order by line_no), ' ') <> ''""")
def evidence_attach(spark: SparkSession, d: str) -> DataFrame:
    latest = V.files(spark, d).select("file_id")
    return texts.attach_evidence(V.findings(spark, d), V.lines(spark, d).join(latest, "file_id", "left_semi"))


@query("with " + _LINES + _F.replace("with latest", ", latest", 1) + """, n as (select finding_id, repository, file_path, greatest(1, start_line - 2) as a, greatest(start_line, coalesce(end_line, start_line)) + 2 as b from f where start_line is not null)
select finding_id, cast(min(line_no) as int) as first_line, cast(max(line_no) as int) as last_line, cast(sum(length(text)) as bigint) as n_chars from n join (select * from lines where file_id in (select file_id from (select file_id, row_number() over (partition by repository, file_path order by ingested_at desc, file_id desc) as k from source_files) where k = 1)) l
  on l.repository = n.repository and l.file_path = n.file_path and line_no between a and b group by 1""")
def excerpt_padding(spark: SparkSession, d: str) -> DataFrame:
    return texts.excerpts(V.findings(spark, d), V.lengths(spark, d))


@query("""with q as (select distinct finding_id, evidence from findings where evidence is not null), s as (select finding_id, case when right(evidence, 1) = chr(10) then string_split(evidence, chr(10))[:-2] else string_split(evidence, chr(10)) end as p from q)
select finding_id, trim(array_to_string(list_transform(p[:5], lambda x: regexp_replace(regexp_replace(x, '\\r$', ''), '^\\s*\\d+ \\| ?', '')), chr(10)), ' ') as evidence from s""")
def clean_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").filter("evidence is not null").select("finding_id", "evidence").distinct()
    return rows.select("finding_id", C.clean_evidence(F.col("evidence")).alias("evidence"))


@query("""with q as (select distinct finding_id, evidence from findings where evidence is not null), s as (select finding_id, string_split(evidence, chr(10)) as p from q),
m as (select finding_id, p, coalesce(list_min(list_transform(list_filter(p, lambda x: trim(x, ' ') <> ''), lambda x: length(x) - length(ltrim(x, ' ')))), 0) as pad from s)
select finding_id, array_to_string(list_transform(p, lambda x: case when trim(x, ' ') = '' then '' else substring(x, pad + 1) end), chr(10)) as text from m""")
def dedent_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").filter("evidence is not null").select("finding_id", "evidence").distinct()
    return rows.select("finding_id", C.dedent(F.col("evidence")).alias("text"))


@query("select file_id, k as depth, array_to_string(p[:k], '/') as folder from (select file_id, string_split(file_path, '/') as p from source_files), lateral (select cast(unnest(range(1, len(p))) as int) as k)")
def ancestor_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files")
    return rows.select("file_id", F.posexplode(C.ancestors(F.col("file_path"))).alias("k", "folder")).select("file_id", (F.col("k") + 1).alias("depth"), "folder")


@query("""with g as (select repository, string_split(file_path, '/')[1] as top, min(file_path) as a, max(file_path) as b from source_files where repository is not null and contains(file_path, '/') group by 1, 2),
s as (select *, string_split(a, '/') as pa, string_split(b, '/') as pb from g),
k as (select *, list_max(list_filter(range(1, least(len(pa), len(pb))), lambda k: array_to_string(pa[:k], '/') = array_to_string(pb[:k], '/'))) as k from s)
select repository || '/' || top as area, array_to_string(pa[:coalesce(k, 0)], '/') as folder from k""")
def common_folder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").filter("repository is not null and file_path like '%/%'")
    return texts.common_folder(rows.withColumn("area", F.concat_ws("/", "repository", F.substring_index("file_path", "/", 1))), "area")


@query("select repository, file_id, cast(sum(size_bytes) over (partition by repository order by file_id) as bigint) as running, sum(size_bytes) over (partition by repository order by file_id) > 100000 as beyond from source_files where repository is not null")
def running_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").filter("repository is not null")
    total = F.sum("size_bytes").over(Window.partitionBy("repository").orderBy("file_id"))
    return rows.select("repository", "file_id", total.alias("running"), (total > 100_000).alias("beyond"))


@query("""select chunk_id, c.start_line - 2 as s1, c.end_line - 2 as e1, case when c.start_line <= c.end_line - 2 then c.start_line end as i_start, case when c.start_line <= c.end_line - 2 then c.end_line - 2 end as i_end,
  case when c.start_line <= c.end_line - 2 then 1 else 1 end as n_pieces from (select distinct chunk_id, start_line, end_line from chunks where start_line is not null and chunk_id is not null) c""")
def range_algebra(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").filter("start_line is not null and chunk_id is not null").select("chunk_id", "start_line", "end_line").distinct()
    s1, e1, s2, e2 = F.col("start_line") - 2, F.col("end_line") - 2, F.col("start_line"), F.col("end_line")
    both = C.intersection(s1, e1, s2, e2)
    return c.select("chunk_id", s1.alias("s1"), e1.alias("e1"), both["start"].alias("i_start"), both["end"].alias("i_end"), F.size(C.difference(s1, e1, s2, e2)).alias("n_pieces"))


@query("""with x as (select file_id, line_count, unnest(partial_regions) as r from source_files where partial_regions is not null and line_count > 0), y as (select file_id, least(r.start_line, line_count) as s, least(r.end_line, line_count) as e from x),
m as (select *, max(e) over (partition by file_id order by s, e rows between unbounded preceding and 1 preceding) as before from y), g as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by file_id order by s, e) as island from m)
select file_id, cast(min(s) as int) as start_line, cast(max(e) as int) as end_line from g group by file_id, island""")
def range_coalesce(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").filter("partial_regions is not null and line_count > 0")
    ranges = F.transform("partial_regions", lambda r: F.struct(r["start_line"].alias("start"), r["end_line"].alias("end")))
    merged = rows.select("file_id", F.explode(C.clamp_ranges(ranges, F.col("line_count"))).alias("r"))
    return merged.select("file_id", F.col("r.start").alias("start_line"), F.col("r.end").alias("end_line"))


@query("select o_orderkey, l_linenumber, case when l_quantity < 10 then 'a' else 'b' end as size_class from orders join lineitem on o_orderkey = l_orderkey and l_quantity between o_totalprice % 50 and o_totalprice % 50 + 10")
def range_join_lineitem(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") % 50).alias("a"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    hit = o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("l_quantity").between(F.col("a"), F.col("a") + 10))
    return hit.select("o_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 10, "a").otherwise("b").alias("size_class"))


# -- tools, answers, secrets ------------------------------------------------------------------------------------


@query(_F + ", p(prefix, category, severity) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in D.RULE_PREFIXES) + """),
m as (select rule_id, first(p.category order by length(prefix) desc) as category, first(p.severity order by length(prefix) desc) as severity from (select distinct rule_id from f where rule_id is not null) x join p on starts_with(rule_id, prefix) group by 1)
select finding_id, f.rule_id, case when f.rule_id is null then 'bug' else coalesce(m.category, 'style') end as category, case when f.rule_id is null then 'medium' else coalesce(m.severity, 'low') end as severity from f left join m using (rule_id)""")
def prefix_classify(spark: SparkSession, d: str) -> DataFrame:
    return tools.classify(V.findings(spark, d).select("finding_id", "rule_id"))


@query("""select event_id, case when s = 'HIGH' and c = 'HIGH' then 'high' when (s = 'HIGH' and c = 'MEDIUM') or (s = 'MEDIUM' and c = 'HIGH') or (s = 'MEDIUM' and c = 'MEDIUM') then 'medium' else 'low' end as severity
from (select event_id, ['LOW', 'MEDIUM', 'HIGH'][cast(user_id % 3 as int) + 1] as s, ['LOW', 'MEDIUM', 'HIGH'][cast(event_id % 3 as int) + 1] as c from events)""")
def severity_matrix(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"))
    rows = table(spark, d, "events").select("event_id", F.get(names, (F.col("user_id") % 3).cast("int")).alias("a"), F.get(names, (F.col("event_id") % 3).cast("int")).alias("b"))
    pairs = D.literal_table(spark, D.TEST_SEVERITY, "s string, c string, severity string")
    return rows.join(pairs, (F.col("a") == F.col("s")) & (F.col("b") == F.col("c")), "left").select("event_id", F.coalesce("severity", F.lit("low")).alias("severity"))


@query("""with m as (select cast(event_id as varchar) || case when event_id % 2 = 0 then '.py' else '.js' end as file_path, user_id % 40 as complexity, user_id % 130 as n_lines, user_id % 9 as parameters from events)
select file_path, 'function-complexity' as rule_id from m where complexity > 15 and file_path not like '%.py' union all select file_path, 'long-function' from m where n_lines > 80 union all select file_path, 'too-many-parameters' from m where parameters > 6""")
def threshold_rules(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    path = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".py").otherwise(".js"))
    rows = table(spark, d, "events").select(path.alias("file_path"), F.lit(1).alias("start_line"), (u % 40).alias("complexity"), (u % 130).alias("n_lines"), (u % 9).alias("parameters"))
    return tools.function_findings(rows).select("file_path", "rule_id")


@query("""with m as (select cast(user_id as varchar) as file_path, event_id as ord, case when event_type = 'view' then value end as a, case when event_type = 'click' then value end as b from events)
select file_path, arg_max(a, ord) filter (where a is not null) as a, arg_max(b, ord) filter (where b is not null) as b from m group by 1""")
def metrics_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("file_path"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", F.col("value")).alias("a"), F.when(F.col("event_type") == "click", F.col("value")).alias("b"))
    return tools.merge_metrics(rows, ["a", "b"])


@query("""select distinct on (finding_id) finding_id, case when s in ('', 'none', 'null', 'n/a', 'na') then null else translate(s, ' -', '__') end as word, case when c > 1 and c <= 100 then c / 100 else c end as fraction,
  case when regexp_extract(cwe, '(?i)CWE[-_ ]?(\\d+)', 1) <> '' then 'CWE-' || cast(cast(regexp_extract(cwe, '(?i)CWE[-_ ]?(\\d+)', 1) as bigint) as varchar) end as cwe
from (select finding_id, loaded_at, lower(trim(status)) as s, confidence as c, cwe from findings) order by finding_id, loaded_at desc""")
def answer_normalisation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").groupBy("finding_id").agg(F.max_by(F.struct("status", "confidence", "cwe"), "loaded_at").alias("r")).select("finding_id", "r.*")
    return rows.select("finding_id", C.normal_word(F.col("status")).alias("word"), C.fraction(F.col("confidence")).alias("fraction"), C.cwe_id(F.col("cwe")).alias("cwe"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def json_answers(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("<think>a { b</think>\n```json\n"), F.col("props"), F.lit("\n```"))
    rows = table(spark, d, "events").select("event_id", C.json_object(wrapped).alias("o"))
    return rows.select("event_id", F.get_json_object("o", "$.k").cast("int").alias("k"))


@query()
def secret_masking(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d)
    # known secrets: the values that credential findings quote
    quoted = texts.quoted_secrets(V.findings(spark, d))
    return texts.mask_values(lines, quoted.select(F.sha1("v").alias("sha1")).distinct())


@query("with " + _LINES + """, k as (select distinct sha1(v) as sha1 from (select unnest(regexp_extract_all(evidence, '"([A-Za-z0-9]{16,})"', 1)) as v from findings where issue_key = 'hardcoded-credential' and evidence is not null)),
v as (select file_id, line_no, unnest(regexp_split_to_array(text, '[\\s''"`,;()\\[\\]{}<>=:@/\\\\]+')) as v from lines)
select distinct file_id, cast(line_no as int) as line_no from v where v <> '' and sha1(v) in (select sha1 from k)""")
def secret_value_hits(spark: SparkSession, d: str) -> DataFrame:
    quoted = table(spark, d, "findings").filter("issue_key = 'hardcoded-credential' and evidence is not null").select(F.explode(F.regexp_extract_all("evidence", F.lit('"([A-Za-z0-9]{16,})"'), F.lit(1))).alias("v"))
    none = spark.createDataFrame([], "file_id bigint, line_no int")
    return texts.sensitive_lines(V.lines(spark, d), none, quoted.select(F.sha1("v").alias("sha1")))


# -- labels, review ---------------------------------------------------------------------------------------------

_MATCH = _F + ", " + _LABELS + """, m as (select f.finding_id, lab.label_id, f.category as pc, lab.category as lc from f join lab on f.repository = lab.repository and f.file_path = lab.file_path
  and f.start_line <= lab.e + 2 and coalesce(f.end_line, f.start_line) >= lab.s - 2)"""
_SAME = "case pc when 'typing' then 'bug' else pc end = case lc when 'typing' then 'bug' else lc end"


@query(_MATCH + f" select finding_id, label_id from m where {_SAME}")
def label_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.label_matches(V.findings(spark, d), V.labels(spark, d)).select("finding_id", "label_id")


@query(_MATCH + " select distinct finding_id from m")
def correct_predictions(spark: SparkSession, d: str) -> DataFrame:
    return matching.correct_predictions(V.findings(spark, d), V.labels(spark, d), False).select("finding_id")


@query()
def bipartite_recall(spark: SparkSession, d: str) -> DataFrame:
    return matching.found_labels(V.findings(spark, d), V.labels(spark, d))


@query()
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return matching.scorecard(fnd.reported(V.findings(spark, d)), V.labels(spark, d))


@query("with " + _FILES + ", " + _LABELS + " select repository, file_path from files where not exists (select 1 from lab where lab.repository = files.repository and lab.file_path = files.file_path)")
def clean_files(spark: SparkSession, d: str) -> DataFrame:
    return V.files(spark, d).select("repository", "file_path").join(V.labels(spark, d), ["repository", "file_path"], "left_anti")


@query(_F + """, ch as (select * from (select *, row_number() over (partition by chunk_id) as k from (select distinct chunk_id, repository, file_path, start_line, end_line from chunks)) where k = 1 and start_line is not null)
select ch.chunk_id, f.finding_id from ch join f on f.repository = ch.repository and f.file_path = ch.file_path and f.start_line between ch.start_line and ch.end_line
where not (list_contains(sources, 'ruff') and coalesce(regexp_matches(rule_id, '^(E1|E2|E3|E5|W|I|Q|COM)'), false))""")
def findings_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    return matching.findings_in_chunks(V.chunks(spark, d), V.findings(spark, d)).select("chunk_id", "finding_id")


_IN_CHUNKS = _F + """, ch as (select * from (select *, row_number() over (partition by chunk_id) as k from (select distinct chunk_id, repository, file_path, chunk_index, start_line, end_line from chunks where chunk_id is not null)) where k = 1),
fc as (select ch.chunk_id, f.finding_id, f.sev_rank, f.start_line from ch join f on f.repository = ch.repository and f.file_path = ch.file_path and f.start_line between ch.start_line and ch.end_line
  where not (list_contains(sources, 'ruff') and coalesce(regexp_matches(rule_id, '^(E1|E2|E3|E5|W|I|Q|COM)'), false)))"""


@query(_IN_CHUNKS + """, rk as (select chunk_id, sum(sev_rank + 1) as risk from fc group by 1), p as (select repository, ch.chunk_id, cast(coalesce(risk, 0) as bigint) as risk, cast(row_number() over (partition by repository order by coalesce(risk, 0) desc, file_path, chunk_index, ch.chunk_id) as int) as place, count(*) over (partition by repository) as n from ch left join rk using (chunk_id))
select repository, chunk_id, risk, place, 'review' as task from p where place <= 60 union all select repository, chunk_id, risk, place, 'style' from p where place <= 60 - least(n, 60)""")
def review_plan(spark: SparkSession, d: str) -> DataFrame:
    return matching.review_plan(V.chunks(spark, d), V.findings(spark, d))


@query(_IN_CHUNKS + ", k as (select *, row_number() over (partition by chunk_id order by sev_rank desc, start_line, finding_id) as k from fc) select chunk_id, 'S' || k as static_id, finding_id from k where k <= 40")
def static_ids(spark: SparkSession, d: str) -> DataFrame:
    return matching.numbered_for_review(V.chunks(spark, d), V.findings(spark, d))


@query(_F + """, s as (select * from f where not models_only), m as (select * from f where models_only), h as (
  select m.finding_id, s.finding_id as target_id, row_number() over (partition by m.finding_id order by s.sev_rank desc, s.start_line, coalesce(s.rule_id, ''), s.ord) as k
  from m join s on m.repository = s.repository and m.file_path = s.file_path and m.category = s.category and s.start_line <= coalesce(m.end_line, m.start_line) and m.start_line <= coalesce(s.end_line, s.start_line))
select finding_id, target_id from h where k = 1""")
def ai_merge_static_target(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    only = C.is_model_only(F.col("sources"))
    return matching.first_static_target(f.filter(only), f.filter(~only))


@query(_F.replace("with latest", "with recursive latest", 1) + """, o as materialized (select finding_id, coalesce(repository, '') as rp, coalesce(file_path, '') as fp, coalesce(category, '') as ct, start_line as s, coalesce(end_line, start_line) as e, row_number() over (partition by repository, file_path, category order by finding_id) as i from f where models_only and start_line is not null),
p(rp, fp, ct, i, leaders, finding_id, leader_id) as (
  select distinct rp, fp, ct, cast(0 as bigint), cast([] as struct(k bigint, s int, e int)[]), cast(null as bigint), cast(null as bigint) from o
  union all select p.rp, p.fp, p.ct, o.i, case when h.k is null then list_append(p.leaders, {'k': o.finding_id, 's': o.s, 'e': o.e}) else p.leaders end, o.finding_id, coalesce(h.k, o.finding_id)
  from p join o on o.rp = p.rp and o.fp = p.fp and o.ct = p.ct and o.i = p.i + 1, lateral (select list_filter(p.leaders, lambda x: x.s <= o.e and o.s <= x.e)[1].k as k) h)
select finding_id, leader_id from p where finding_id is not null""")
def ai_merge_leaders(spark: SparkSession, d: str) -> DataFrame:
    return matching.leader_clusters(V.findings(spark, d).filter(C.is_model_only(F.col("sources"))))


# -- calls ------------------------------------------------------------------------------------------------------


@query("with " + _CALLS + """, m as (select * from c where status not in ('skipped', 'cached')) select provider, count(*) as attempted, count(*) filter (where status = 'ok') as answered, count(*) filter (where status <> 'ok') as failed,
  coalesce(cast(quantile_disc(latency_ms, 0.5) filter (where status = 'ok') as bigint), 0) as p50, coalesce(cast(quantile_disc(latency_ms, 0.95) filter (where status = 'ok') as bigint), 0) as p95,
  count(distinct (repository, file_path)) filter (where status in ('ok', 'rejected', 'unavailable', 'rate_limited')) as n_files from m group by 1""")
def provider_usage(spark: SparkSession, d: str) -> DataFrame:
    return calls.provider_usage(V.calls(spark, d, "provider", "status", "latency_ms", "repository", "file_path"))


@query("with " + _CALLS + """, o as (select provider, status, count(*) as n from c where status not in ('ok', 'cached') group by 1, 2), s as (select provider, string_agg(status || ':' || n, ' ' order by status) as other from o group by 1),
a as (select provider, count(*) filter (where status in ('ok', 'cached')) as answered, cast(coalesce(sum(input_tokens) filter (where status in ('ok', 'cached')), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens) filter (where status in ('ok', 'cached')), 0) as bigint) as output_tokens from c group by 1)
select a.provider, answered, input_tokens, output_tokens, coalesce(other, '') as other from a left join s on s.provider is not distinct from a.provider""")
def provenance_table(spark: SparkSession, d: str) -> DataFrame:
    return calls.provenance(V.calls(spark, d, "provider", "status", "input_tokens", "output_tokens"))


@query("with " + _CALLS + " select count(*) as n_calls, count(*) filter (where status = 'ok') as answered, count(*) filter (where status in ('rejected', 'unavailable', 'rate_limited')) as fell_through, count(distinct provider) as providers, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from c")
def model_totals(spark: SparkSession, d: str) -> DataFrame:
    return calls.totals(V.calls(spark, d, "provider", "status", "input_tokens", "output_tokens"))


@query("with " + _CALLS + """, k as (select * from c where status = 'ok' and latency_ms is not null) select provider, count(*) as n, cast(quantile_disc(latency_ms, 0.95) as bigint) as p95_nearest, round(quantile_cont(latency_ms, 0.95), 6) as p95_linear,
  round(cast(median(latency_ms) as double), 6) as median_mean, list_sort(list(latency_ms))[count(*) // 2 + 1] as median_upper from k group by 1""")
def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    return calls.order_statistics(V.calls(spark, d, "provider", "status", "latency_ms"))


@query("with " + _CALLS + " select provider, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in ("ok", "cached", "rejected", "unavailable", "rate_limited", "skipped")) + " from c group by 1")
def call_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return calls.status_pivot(V.calls(spark, d, "provider", "status"))


@query("with " + _CALLS + " select provider, count(*) as n_all, count(*) filter (where task <> 'verify') as n_unverified, cast(sum(coalesce(output_tokens, 0)) as bigint) as tokens_all, cast(coalesce(sum(coalesce(output_tokens, 0)) filter (where task <> 'verify'), 0) as bigint) as tokens_unverified from c where status = 'ok' group by 1")
def cost_by_task(spark: SparkSession, d: str) -> DataFrame:
    return calls.cost_by_task(V.calls(spark, d, "provider", "status", "task", "output_tokens"))


@query("with " + _CALLS + """, s as (select provider, cast(epoch(date_trunc('second', called_at)) as bigint) as sec, count(*) as n from c where called_at is not null and status <> 'skipped' group by 1, 2),
w as (select provider, sum(n) over (partition by provider order by sec range between 59 preceding and current row) as k from s) select provider, cast(max(k) as bigint) as busiest from w group by 1""")
def observed_rate_window(spark: SparkSession, d: str) -> DataFrame:
    return calls.observed_rate(V.calls(spark, d, "provider", "status", "called_at"))


@query("with " + _CALLS + ", k as (select provider, task, model, repository, file_path, count(*) as n from c where file_path is not null group by 1, 2, 3, 4, 5) select provider, cast(sum(n) as bigint) as n_calls, count(*) as n_keys, cast(sum(n - 1) as bigint) as n_repeats from k group by 1")
def cache_key_hits(spark: SparkSession, d: str) -> DataFrame:
    return calls.cache_hits(V.calls(spark, d, "provider", "task", "model", "repository", "file_path"))


@query("with " + _CALLS + ", k as (select provider, call_id, status, cast(row_number() over (partition by provider order by called_at desc, call_id desc) as int) as k from c) select provider, k, call_id, status from k where k <= 14")
def last_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.last_calls(V.calls(spark, d, "provider", "status", "called_at"))


@query("with " + _CALLS + ", k as (select task, count(*) as n, quantile_cont(latency_ms, 0.5) as a, quantile_cont(latency_ms, 0.95) as b from c where status = 'ok' and latency_ms > 0 group by 1) select task, n, cast(round_even(a, 0) as bigint) as p50, cast(round_even(b, 0) as bigint) as p95, round(60000.0 / a, 6) as per_minute from k")
def latency_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return calls.latency_benchmark(V.calls(spark, d, "task", "status", "latency_ms"))


@query("select t.task, cast(list_position((select list(provider order by provider) from provider_status), provider) - 1 as int) as pos, provider, is_external from (values ('review'), ('verify')) t(task), provider_status where breaker_state <> 'open'")
def route_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provider_status")
    names = p.agg(F.array_sort(F.collect_list("provider")).alias("ps"))
    routes = names.select(F.posexplode("ps").alias("pos", "provider")).select(F.explode(F.array(F.lit("review"), F.lit("verify"))).alias("task"), "pos", "provider")
    return calls.route_candidates(routes, p)


@query("select event_id, case when c = 429 then 'rate_limited' when c = 402 then 'quota_exhausted' when c in (401, 403) then 'authentication' when c = 404 then 'configuration' when c = 408 or c >= 500 then 'unavailable' when c >= 400 then 'request' end as outcome from (select event_id, 380 + event_id % 140 as c from events)")
def http_status_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.http_outcome(F.lit(380) + F.col("event_id") % 140).alias("outcome"))


@query("select doc_id, cast(ceil(length(text) / 3.5) as bigint) + 512 as tokens from documents where text is not null")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", C.estimated_tokens(F.col("text"), F.lit(512)).alias("tokens"))


_TIMED = "with " + _CALLS + """, t as (select call_id, provider, strftime(called_at, '%Y-%m-%d') as day, epoch_us(called_at) as us, status, coalesce(input_tokens, 0) as tokens, coalesce(model, '') as model, coalesce(file_path, '') as path,
  row_number() over (partition by provider order by called_at, call_id) - 1 as i from c where called_at is not null and provider is not null)"""


@query(_TIMED + """, w as (select *, us - i // 30 * 60000000 as ahead from t), m as (select *, max(ahead) over (partition by provider, i % 30 order by i) + i // 30 * 60000000 as slot_us from w)
select call_id, provider, day, slot_us / 1000000.0::double as slot, (slot_us - us) / 1000000.0::double as wait from m""")
def limiter_slots(spark: SparkSession, d: str) -> DataFrame:
    return routing.limiter_slots(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


@query(_TIMED + """, w as (select *, least(200000, tokens) as charge from t), s as (select *, us - min(us) over (partition by provider) - 1500 * coalesce(sum(charge) over (partition by provider order by i rows between unbounded preceding and 1 preceding), 0) as less from w),
m as (select *, max(less) over (partition by provider order by i) as most from s) select call_id, provider, day, cast(200000 - cast(most - less as double) / 1500 - charge as double) as level from m""")
def token_bucket_levels(spark: SparkSession, d: str) -> DataFrame:
    return routing.token_bucket(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


_BREAKER = _TIMED.replace("with c", "with recursive c", 1) + """, b(provider, i, state, failures, limits, until, probing) as (
  select provider, cast(-1 as bigint), '', 0, 0, cast(0 as bigint), false from (select distinct provider from t)
  union all select t.provider, t.i, z.state,
    case when t.status = 'ok' and z.state <> 'open' then 0 when t.status = 'unavailable' then b.failures + 1 else b.failures end,
    case when t.status = 'ok' and z.state <> 'open' then 0 when t.status = 'rate_limited' then b.limits + 1 else b.limits end,
    case when t.status = 'rate_limited' then greatest(b.until, t.us + cast(least(pow(2, least(b.limits + 1, 30)), 60) * 1000000 as bigint)) when t.status in ('quota_exhausted', 'auth_failed', 'misconfigured') then greatest(b.until, t.us + 3600000000) when t.status = 'unavailable' and (z.state = 'half_open' or b.failures + 1 >= 3) then greatest(b.until, t.us + 30000000) else b.until end,
    case when t.status = 'ok' and z.state <> 'open' then false when t.status in ('rate_limited', 'quota_exhausted', 'auth_failed', 'misconfigured') or (t.status = 'unavailable' and (z.state = 'half_open' or b.failures + 1 >= 3)) then true else b.probing end
  from b join t on t.provider = b.provider and t.i = b.i + 1, lateral (select case when t.us < b.until then 'open' when b.probing then 'half_open' else 'closed' end as state) z)
"""


@query(_BREAKER + "select call_id, provider, day, state from b join t using (provider, i)")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return routing.breaker_states(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


@query(_TIMED + """, k as (select *, lag(i) over w as last, coalesce(lead(i) over w, 9000000000) as next from t window w as (partition by provider, model, path order by i)),
n as (select a.call_id, count(*) as between_ from k a join k b on a.provider = b.provider and b.i > a.last and b.i < a.i and b.next >= a.i group by 1)
select provider, day, count(*) as n_calls, count(*) filter (where last is not null and coalesce(between_, 0) < 512) as n_hits from k left join n using (call_id) group by 1, 2""")
def lru_hits(spark: SparkSession, d: str) -> DataFrame:
    return routing.lru_hits(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


@query()
def routing_simulation(spark: SparkSession, d: str) -> DataFrame:
    return routing.simulate_routing(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


# -- raters -----------------------------------------------------------------------------------------------------


@query("with " + _RATINGS + " select criterion, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as deviation, count(distinct item) as n_items, count(*) as n from t group by 1")
def rating_means(spark: SparkSession, d: str) -> DataFrame:
    return agreement.rating_means(V.ratings(spark, d))


@query("with " + _RATINGS + """, p as (select a.rater as first, b.rater as second, a.criterion, a.score as x, b.score as y from t a join t b on a.item = b.item and a.criterion = b.criterion and a.rater < b.rater),
n as (select first, second, criterion, count(*) as n, sum((x - y) * (x - y) / 16.0) as seen from p group by 1, 2, 3), xs as (select first, second, criterion, x, count(*) as k from p group by 1, 2, 3, 4), ys as (select first, second, criterion, y, count(*) as k from p group by 1, 2, 3, 4),
e as (select first, second, criterion, sum(xs.k * ys.k * (x - y) * (x - y) / 16.0) as s from xs join ys using (first, second, criterion) group by 1, 2, 3)
select first, second, criterion, n, round(case when s = 0 then 1.0 else 1 - seen / (s / n) end, 6) as kappa from n join e using (first, second, criterion) where n >= 2""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.cohen_kappa(V.ratings(spark, d))


@query("with " + _RATINGS + """, k as (select criterion, item, score, count(*) as k from t group by 1, 2, 3), i as (select criterion, item, sum(k) as n, sum(k * k) as q from k group by 1, 2 having sum(k) = 7),
s as (select criterion, count(*) as n_items, avg((q - 7) / 42.0) as seen from i group by 1), c as (select criterion, score, sum(k) as k from k join i using (criterion, item) group by 1, 2), p as (select criterion, sum((c.k / (7.0 * n_items)) * (c.k / (7.0 * n_items))) as chance from c join s using (criterion) group by 1)
select criterion, n_items, round((seen - chance) / (1 - chance), 6) as kappa from s join p using (criterion)""")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.fleiss_kappa(V.ratings(spark, d))


@query("with " + _RATINGS + """, k as (select criterion, item, score, count(*) as k from t group by 1, 2, 3), i as (select criterion, item, sum(k) as n, sum(k * k) as q from k group by 1, 2 having sum(k) >= 2),
s as (select criterion, n as n_raters, count(*) as n_items, avg((q - n) / (n * (n - 1.0))) as seen from i group by 1, 2), c as (select criterion, n as n_raters, score, sum(k / cast(n as double)) as share from k join i using (criterion, item) group by 1, 2, 3),
p as (select criterion, n_raters, sum((share / n_items) * (share / n_items)) as chance from c join s using (criterion, n_raters) group by 1, 2)
select criterion, cast(n_raters as bigint) as n_raters, n_items, round(case when chance = 1 then 1.0 else (seen - chance) / (1 - chance) end, 6) as kappa from s join p using (criterion, n_raters)""")
def fleiss_kappa_by_raters(spark: SparkSession, d: str) -> DataFrame:
    return agreement.fleiss_by_raters(V.ratings(spark, d))


@query(_F + ", s as (select repository, finding_id, cast(row_number() over (partition by repository order by md5('7' || cast(finding_id as varchar)), finding_id) as int) as place from f where suggestion is not null) select repository, place, finding_id from s where place <= 3")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return agreement.stratified_sample(V.findings(spark, d))


# -- log --------------------------------------------------------------------------------------------------------


@query("with " + _EVENTS + " select scan_id, kind, key, min(id) as first_id, max(id) as last_id, arg_max(value, id) as value from ev group by 1, 2, 3")
def event_upserts(spark: SparkSession, d: str) -> DataFrame:
    return log.upserts_batch(V.events(spark, d))


@query("with " + _EVENTS + ", w as (select scan_id, id, epoch_us(lead(ts) over (partition by scan_id order by id)) - epoch_us(ts) as micros from ev where kind = 'stage') select * from w where micros is not null")
def stage_durations(spark: SparkSession, d: str) -> DataFrame:
    return log.stage_durations(V.events(spark, d))


@query("with " + _EVENTS + ", w as (select scan_id, id, kind, row_number() over (partition by scan_id order by id desc) as k from ev) select scan_id, id, kind from w where k <= 300")
def activity_last_n(spark: SparkSession, d: str) -> DataFrame:
    return log.last_activity(V.events(spark, d))


@query("with " + _EVENTS + " select scan_id, count(*) as n, max(id) = count(distinct id) as gapless, arg_max(kind, id) = 'status' as closed from ev group by 1")
def terminal_event_check(spark: SparkSession, d: str) -> DataFrame:
    return log.terminal_check(V.events(spark, d))


@query("with " + _EVENTS + ", l as (select scan_id, max(ts) as last_ts from ev group by 1) select * from l where last_ts < timestamp '2024-01-31 00:00:00' - interval 24 hours")
def retention_expired(spark: SparkSession, d: str) -> DataFrame:
    return log.expired(V.events(spark, d), "2024-01-31 00:00:00")


# -- reports and helpers ----------------------------------------------------------------------------------------


@query("with " + _FILES + """, n as (select repository, coalesce(file_language, 'unknown') as l, count(*) as n from files group by 1, 2)
select repository, cast(sum(n) as varchar) || case when sum(n) = 1 then ' file: ' else ' files: ' end || string_agg(l || ' ' || n, ', ' order by n desc, l) as description from n group by 1""")
def project_description(spark: SparkSession, d: str) -> DataFrame:
    return reports.project_description(V.files(spark, d))


@query(_F + ", " + _FILES + """, n as (select repository, """ + ", ".join(f"count(*) filter (where severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low", "info")) + """, count(*) as n_reported from r group by 1),
s as (select repository, count(*) as n_files, sum(coalesce(line_count, 0)) / 1000.0 as k from files group by 1)
select repository, n_files, round(cast(k as double), 6) as kloc, """ + ", ".join(f"coalesce({s}, 0) as {s}" for s in ("critical", "high", "medium", "low", "info")) + ", coalesce(n_reported, 0) as n_reported, round(coalesce(n_reported, 0) / nullif(cast(k as double), 0), 6) as per_kloc from s left join n using (repository)")
def repository_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.repository_summary(V.findings(spark, d), V.files(spark, d))


@query(_F + " select repository, " + ", ".join(f"count(*) filter (where category = '{c}') as {c}" for c in ("bug", "documentation", "maintainability", "performance", "security", "style", "typing")) + " from r group by 1")
def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return reports.category_pivot(V.findings(spark, d))


@query(_F + " select rule_id from f where rule_id is not null and severity is not null group by 1 having count(distinct severity) = (select count(distinct severity) from f)")
def rules_everywhere(spark: SparkSession, d: str) -> DataFrame:
    return reports.everywhere(V.findings(spark, d))


@query("with " + _EVENTS + """, t as (select scan_id, id, case when kind = 'stage' then 'stage ' || key when kind = 'tool' and key % 2 = 1 then 'tool done in ' || case when floor(value * 100) < 1000 then cast(cast(floor(value * 100) as bigint) as varchar) || ' ms' else (cast(floor(value * 100) as bigint) + 50) // 100 // 10 || '.' || (cast(floor(value * 100) as bigint) + 50) // 100 % 10 || ' s' end
  when kind = 'finding' then 'finding' when kind = 'llm_call' then 'model call ' || key when kind = 'status' then 'status' end as text from ev) select * from t where text is not null""")
def activity_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.activity_lines(V.events(spark, d))


@query("with " + _EVENTS + " select scan_id, least(100.0, round((count(*) filter (where kind = 'stage') + case when arg_max(kind, id) <> 'status' then 0.5 else 0 end) * 100 / 6, 6))::double as percent from ev group by 1")
def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    return reports.progress(V.events(spark, d))


@query(_F + ", " + _FILES + """, p as (select repository, sum(case severity when 'critical' then 25 when 'high' then 10 when 'medium' then 4 when 'low' then 1 else 0 end) as points, count(*) as n_reported from r group by 1),
s as (select repository, sum(coalesce(line_count, 0)) as lines, count(*) as n_files from files group by 1), k as (select repository, count(distinct file_path) as n_complex from f where issue_key = 'complex-function' group by 1),
j as (select s.repository, n_files, coalesce(n_reported, 0) as n_reported, cast(greatest(0, least(100, round_even(cast(100 - coalesce(points, 0) / greatest(1.0, lines / 1000.0) - 20.0 * coalesce(n_complex, 0) / n_files as double), 0))) as int) as score from s left join p using (repository) left join k using (repository)),
o as (select *, row_number() over (partition by repository order by sev_rank desc, file_path, start_line nulls first, ord) as place, count(*) over (partition by repository) as all_ from r),
l as (select repository, place, '[' || severity || '] ' || file_path || ':' || start_line || ' ' || case when length(t) > 80 then rtrim(t[:79]) || '…' else t end as text from (select *, trim(regexp_replace(title, '\\s+', ' ', 'g')) as t from o where place <= 10) union all select repository, 11, 'and ' || (any_value(all_) - 10) || ' more' from o where all_ > 10 group by 1),
tp as (select repository, '[' || string_agg(to_json(text)::varchar, ',' order by place) || ']' as top from l where text is not null group by 1)
select repository, '{"repository":' || to_json(repository)::varchar || ',"score":' || score || ',"grade":"' || case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'E' end || '","n_files":' || n_files || ',"n_reported":' || n_reported || ',"top":' || coalesce(top, '[]') || '}' as report from j left join tp using (repository)""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_json(V.findings(spark, d), V.files(spark, d))


@query("""select event_id, case when s < 60 then 'just now' when s < 3600 then cast(s // 60 as varchar) || ' min ago' when s < 86400 then cast(s // 3600 as varchar) || ' h ago' else strftime(ts, '%Y-%m-%d') end as ago
from (select event_id, ts, cast(floor(epoch(timestamp '2024-01-31 00:00:00')) - floor(epoch(ts)) as bigint) as s from events)""")
def time_ago(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.time_ago(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query("select event_id, event_id % 4 in (0, 1, 3) as loopback, greatest(0, value - 50) as wait, case when event_id % 2 = 0 then event_id else 0 end as used from events")
def request_helpers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    url = F.when(k == 0, "http://localhost:11434/v1").when(k == 1, "http://u:p@127.0.0.1/x").when(k == 2, "https://localhost.example.com/").otherwise("http://[::1]:80/")
    counted = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.lit("-3"))
    return e.select("event_id", C.is_loopback(url).alias("loopback"), C.retry_after((F.col("value") - 50).cast("string"), F.col("ts")).alias("wait"), C.usage_count(counted).alias("used"))


@query("select event_id, strftime(((date_trunc('day', ts at time zone 'UTC' at time zone 'America/Los_Angeles') + interval 1 day) at time zone 'America/Los_Angeles') at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as reset from events")
def quota_reset(spark: SparkSession, d: str) -> DataFrame:
    at = C.next_quota_reset(F.to_utc_timestamp(F.col("ts").cast("timestamp"), spark.conf.get("spark.sql.session.timeZone")))
    shown = F.from_utc_timestamp(at, spark.conf.get("spark.sql.session.timeZone"))
    return table(spark, d, "events").select("event_id", F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("reset"))


@query(_F + " select finding_id, case when category not in ('style', 'maintainability') then 'category' when sev_rank > 2 then 'severity' end as off_style, case when category = 'style' then 'category' end as off_review from f")
def off_task(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return f.select("finding_id", C.off_task(F.col("category"), F.col("severity"), "style").alias("off_style"), C.off_task(F.col("category"), F.col("severity"), "review").alias("off_review"))


@query(_F + """, b as (select repository, file_path, arg_max(content, (ingested_at, file_id)) as content from source_files where content is not null group by 1, 2),
x as (select finding_id, start_line as a, coalesce(end_line, start_line) as z, evidence, case when content = '' then [] else string_split(regexp_replace(regexp_replace(content, '\\n$', ''), '\\r(\\n|$)', '\\1', 'g'), chr(10)) end as lines from f join b using (repository, file_path) where start_line is not null),
e as (select *, case when evidence is null or evidence = '' then [] else string_split(regexp_replace(evidence, '\\n$', ''), chr(10))[:5] end as ev from x),
q as (select *, case when evidence is null then null else list_filter(list_transform(string_split(trim(array_to_string(list_transform(ev, lambda l: regexp_replace(regexp_replace(l, '\\r$', ''), '^\\s*\\d+ \\| ?', '')), chr(10)), ' '), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'), ' ')), lambda l: l <> '') end as quoted,
  trim(regexp_replace(array_to_string(lines[greatest(1, a - 2):greatest(1, a - 2) + greatest(0, z - a + 5) - 1], ' '), '\\s+', ' ', 'g'), ' ') as win from e)
select finding_id, case when z > len(lines) then 'past_end' when a < 1 or z > len(lines) then 'not_shown' when length(array_to_string(coalesce(quoted, []), '')) < 3 then 'no_evidence' when len(list_filter(quoted, lambda t: not contains(win, t))) > 0 then 'not_found' end as reason from q""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    body = table(spark, d, "source_files").filter("content is not null").groupBy("repository", "file_path").agg(F.max_by("content", F.struct("ingested_at", "file_id")).alias("content"))
    f = V.findings(spark, d).filter("start_line is not null").select("finding_id", "repository", "file_path", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "evidence")
    rows = f.join(body, ["repository", "file_path"]).withColumn("lines", C.split_lines(F.col("content")))
    return rows.select("finding_id", C.ungrounded(F.col("lines"), F.col("start_line"), F.col("end_line"), F.lit(1), F.size("lines"), F.col("evidence")).alias("reason"))


@query("with " + _LINES + " select repository, file_path, cast(line_no as int) as start_line from lines where regexp_matches(text, '^\\s*(#|//|\\*)') and contains(text, 'TODO') and regexp_matches(lower(file_path), '(\\.py|\\.js|\\.ts|\\.tsx|\\.go|\\.java)$')")
def analyser_plugin(spark: SparkSession, d: str) -> DataFrame:
    return plugins.run_analysers(table(spark, d, "source_files"), plugins.TodoComments()).select("repository", "file_path", "start_line")


@query("select doc_id, case when text is not null then 'len ' || length(text) end as answer from documents")
def mock_responder(spark: SparkSession, d: str) -> DataFrame:
    return plugins.respond(table(spark, d, "documents").select("doc_id", "text"), lambda p: f"len {len(p)}", "text").select("doc_id", "answer")


@query(_F + " select finding_id, row_number() over (partition by repository order by sev_rank desc, file_path, start_line nulls first, coalesce(rule_id, ''), ord) as place from f")
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    """Every finding's place in its repository's report."""
    w = Window.partitionBy("repository").orderBy(*fnd.canonical_order())
    return V.findings(spark, d).select("finding_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("with ch as (select distinct chunk_id, repository, file_path, start_line, end_line from chunks where chunk_id is not null and start_line is not null), " + _LABELS + """ select chunk_id, count(*) as n, cast(sum(least(e, end_line) - greatest(s, start_line) + 1) as bigint) as shared_lines
  from ch join lab on ch.repository = lab.repository and ch.file_path = lab.file_path and s <= end_line and start_line <= e group by 1""")
def overlap_lines(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk, the labelled ranges that overlap its body and the lines they share with it (an interval join)."""
    ch = table(spark, d, "chunks").filter("chunk_id is not null and start_line is not null").select("chunk_id", "repository", "file_path", F.col("start_line").alias("cs"), F.col("end_line").alias("ce")).distinct()
    hit = ch.join(V.labels(spark, d), ["repository", "file_path"]).filter(C.overlaps(F.col("cs"), F.col("ce"), F.col("start_line"), F.col("end_line")))
    both = C.intersection(F.col("cs"), F.col("ce"), F.col("start_line"), F.col("end_line"))
    return hit.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(both["end"] - both["start"] + 1).alias("shared_lines"))


@query("with " + _RATINGS + """, k as (select item, unnest(sources) as s from rating_items join (select finding_id, any_value(sources) as sources from findings group by 1) using (finding_id)),
g as (select item, lower(trim(s)) as grp from k where s is not null and trim(s) <> '' union select item, 'all' from rating_items)
select grp as source_group, criterion, count(distinct item) as n_items, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as deviation from t join g using (item) group by 1, 2""")
def rating_means_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Ratings joined with the sources of their items; an item counts for each of its sources and for all."""
    f = table(spark, d, "findings").groupBy("finding_id").agg(F.max("sources").alias("sources"))
    items = table(spark, d, "rating_items").join(f, "finding_id")
    names = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    groups = items.select("item", F.explode(F.array_distinct(F.concat(F.filter(names, lambda s: s.isNotNull() & (s != "")), F.array(F.lit("all"))))).alias("source_group"))
    rows = V.ratings(spark, d).join(groups, "item")
    return rows.groupBy("source_group", "criterion").agg(F.count_distinct("item").alias("n_items"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("deviation"))


@query(_F + """, a as (select repository, count(*) filter (where live and not weak) as n_reported, count(*) filter (where status = 'dismissed_by_ai') as n_dismissed, count(*) filter (where status = 'needs_review') as n_needs_review from g group by 1) select * from a""")
def project_facts(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    live = C.is_reported(F.col("status"), F.col("sources"), F.col("confidence"))
    return f.groupBy("repository").agg(F.count_if(live).alias("n_reported"), F.count_if(F.col("status") == "dismissed_by_ai").alias("n_dismissed"), F.count_if(F.col("status") == "needs_review").alias("n_needs_review"))


@query("with " + _EVENTS + ", l as (select scan_id, max(ts) as last_ts, max(event_id) as e from ev group by 1) select scan_id, last_ts from l order by last_ts desc, e desc limit 12")
def recent_scans(spark: SparkSession, d: str) -> DataFrame:
    """The twelve scans used last."""
    last = V.events(spark, d).groupBy("scan_id").agg(F.max("ts").alias("last_ts"), F.max("event_id").alias("e"))
    return last.orderBy(F.desc("last_ts"), F.desc("e")).limit(12).select("scan_id", "last_ts")


@query("select cast(date_trunc('day', ts) as timestamp) as start, case event_type when 'view' then 'stage' when 'click' then 'tool' when 'signup' then 'finding' when 'purchase' then 'llm_call' when 'error' then 'status' end as kind, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling days of the event stream, as a batch."""
    return log.windowed(V.events(spark, d)).withColumn("total", F.round("total", 3))
