"""Queries over the steps of a review pipeline, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import _BREAKER, _CALLS, _EVENTS, _F, _FILES, _MATCH, _SAME, query
from larkspur.catalogue_inputs import _ANSWERS, _answer
from larkspur.functions import columns as C
from larkspur.operators import answers, matching, pipeline, texts
from larkspur.operators import findings as fnd
from larkspur.plans import views as V
from larkspur.plans.durable import table

_VALID = "a >= 1 and b >= a and k % 11 <> 0 and category is not null and severity is not null and trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') <> '' and trim(coalesce(message, ''), ' ') <> '' and trim(coalesce(evidence, ''), ' ') <> ''"


@query(_ANSWERS + f" select finding_id, 'ai/' || category as rule_id, a as start_line, b as end_line, severity, 'gemini' as source from an where not lost and {_VALID}")
def issue_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = pipeline.to_findings(answers.issues(_answer(spark, d), "finding_id", "answer"), F.lit("gemini"))
    return rows.select("finding_id", "rule_id", "start_line", "end_line", "severity", F.col("sources")[0].alias("source"))


@query(_ANSWERS + ", j as (select finding_id, case k % 5 when 0 then 'false_positive' when 1 then 'maybe' else 'confirmed' end as v from an where not lost) select finding_id, coalesce(v, '') as verdicts from f left join (select * from j where v <> 'maybe') using (finding_id)")
def judged_findings(spark: SparkSession, d: str) -> DataFrame:
    judged = answers.judgements(_answer(spark, d), "finding_id", "answer").filter("valid")
    return pipeline.with_judgements(V.findings(spark, d).select("finding_id"), judged).select("finding_id", F.array_join("verdicts", ",").alias("verdicts"))


@query(_F + " select finding_id from g where models_only and status = 'open' and sev_rank >= 2 and (repository, file_path) in (select (repository, file_path) from source_files where content is not null)")
def verification_targets(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    need = f.filter(C.needs_verification(F.col("sources"), F.col("status"), F.col("severity"), 2))
    return pipeline.loaded(need, table(spark, d, "source_files")).select("finding_id")


@query("select provider, p.limits_group, priority, rpm from provider_status join (select provider, case when is_external then 'shared' else provider end as limits_group, row_number() over (order by provider) as priority from provider_status) p using (provider) left join (values ('shared', 30)) l(limits_group, rpm) using (limits_group)")
def candidate_limits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provider_status")
    names = p.agg(F.array_sort(F.collect_list("provider")).alias("ps"))
    tuning = p.crossJoin(F.broadcast(names)).select("provider", F.when(F.col("is_external"), "shared").otherwise(F.col("provider")).alias("limits_group"), F.array_position("ps", F.col("provider")).alias("priority"))
    limits = spark.range(1).select(F.lit("shared").alias("limits_group"), F.lit(30).alias("rpm"))
    return pipeline.with_limits(p.select("provider"), tuning, limits).select("provider", "limits_group", "priority", "rpm")


@query("with " + _CALLS + " select provider, count(*) as n from c join provider_status p using (provider) where provider <> 'gemini' and (not p.is_external or provider in ('nvidia', 'hf-large')) and provider in ('nvidia', 'hf-large', 'local') group by 1")
def permitted_calls(spark: SparkSession, d: str) -> DataFrame:
    c = V.calls(spark, d, "provider").join(table(spark, d, "provider_status").select("provider", "is_external"), "provider")
    allowed = pipeline.permitted(F.col("provider"), F.col("is_external"), ["gemini"], ["nvidia", "hf-large", "local"], True)
    return c.filter(allowed).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("with " + _CALLS + " select call_id from c join provider_status p using (provider) where not p.is_external and call_id % 3 <> 0")
def admissible_answers(spark: SparkSession, d: str) -> DataFrame:
    cached = V.calls(spark, d, "provider").select("call_id", "provider", F.when(F.col("call_id") % 3 == 0, "no answer").otherwise('{"findings": []}').alias("answer"))
    return answers.admissible(cached, table(spark, d, "provider_status"), [], None, False).select("call_id")


@query("with " + _CALLS + """, p(status, pause, counts) as (values ('quota_exhausted', 3600.0, false), ('auth_failed', 3600.0, false), ('misconfigured', 3600.0, false), ('rejected', 0.0, false), ('rate_limited', null, false), ('unavailable', 30.0, true))
select call_id, c.status, cast(pause as double) as pause, counts from c join p using (status)""")
def failure_pauses(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.pauses(V.calls(spark, d, "status")).select("call_id", "status", "pause", "counts")


@query(_BREAKER + "select provider, arg_max(state, call_id) as state, count(*) filter (where state = 'open') as n_open, max(call_id) as last_call from b join t using (provider, i) group by 1")
def provider_states(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.states_now(V.calls(spark, d, "called_at", "provider", "status", "input_tokens", "model", "file_path"))


@query(_MATCH + f", h as (select finding_id, string_agg(distinct label_id, ', ' order by label_id) as labels from m where {_SAME} group by 1) select finding_id, coalesce(labels, 'none') as labels from r left join h using (finding_id)")
def curation(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    return pipeline.curated(fnd.reported(f), matching.label_matches(f, V.labels(spark, d))).select("finding_id", "labels")


_SCANS = "with " + _EVENTS + ", sc as (select scan_id, case when arg_max(kind, id) = 'status' then 'done' when max(id) < 5 then 'queued' else 'running' end as status from ev group by 1)"


def _scans(spark: SparkSession, d: str) -> DataFrame:
    last = V.events(spark, d).groupBy("scan_id").agg(F.max_by("kind", "id").alias("kind"), F.max("id").alias("n"))
    return last.select("scan_id", F.when(F.col("kind") == "status", "done").when(F.col("n") < 5, "queued").otherwise("running").alias("status"))


@query(_SCANS + " select scan_id, case when status <> 'done' then 'failed' else status end as status, case when status <> 'done' then 'interrupted' end as error from sc")
def recovered_scans(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.recovered(_scans(spark, d)).select("scan_id", "status", "error")


@query(_SCANS + " select count(*) filter (where status in ('queued', 'running')) as pending, count(*) filter (where status in ('queued', 'running')) >= 10 as full from sc")
def pending_scans(spark: SparkSession, d: str) -> DataFrame:
    pending = F.count_if(F.col("status").isin("queued", "running"))
    return _scans(spark, d).agg(pending.alias("pending"), (pending >= 5 * 2).alias("full"))


@query("with " + _EVENTS + " select scan_id, id, 'id: ' || id || chr(10) || 'event: ' || kind || chr(10) || 'data: {\"key\":' || key || '}' || chr(10) || chr(10) as message from ev where id > case when scan_id % 2 = 0 then scan_id % 7 else 0 end and key is not null")
def resumed_events(spark: SparkSession, d: str) -> DataFrame:
    ev = V.events(spark, d)
    seen = ev.filter(F.col("scan_id") % 2 == 0).select("scan_id").distinct().withColumn("last_id", F.col("scan_id") % 7)
    return pipeline.resumed(ev.filter("key is not null"), seen)


@query("with m as (select distinct provider, model from provider_status) select provider, provider || ' (' || count(*) filter (where contains(lower(model), 'r')) || case when count(*) filter (where contains(lower(model), 'r')) = 1 then ' model)' else ' models)' end || coalesce(string_agg(chr(10) || '  ' || model, '' order by model) filter (where contains(lower(model), 'r')), '') as line from m group by 1")
def model_listing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provider_status").select("provider", "model").distinct()
    able = F.struct(F.concat(F.lit("models/"), "model").alias("name"), F.array(F.lit(pipeline.CAPABILITY)).alias("supportedGenerationMethods"))
    other = F.struct(F.lit("models/embedder").alias("name"), F.array(F.lit("embedContent")).alias("supportedGenerationMethods"))
    payload = F.when(F.col("provider") == "gemini", F.to_json(F.struct(F.array(able, other).alias("models")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("model").alias("id"))).alias("data"))))
    return pipeline.listing(p.select("provider", pipeline.model_list(payload).alias("models")), "R")


@query(_F + " select finding_id, row_number() over (partition by repository order by sev_rank desc, file_path collate en_US, start_line nulls first, ord) as place from f")
def reader_order(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.numbered(V.findings(spark, d), ["repository"], pipeline.reading_order()).select("finding_id", F.col("place").cast("bigint").alias("place"))


@query("with " + _FILES + """, p as (select repository, string_split(file_path, '/') as s from files), n as (select distinct repository, array_to_string(s[:k - 1], '/') as parent, s[k] as name, k = len(s) as is_file from (select repository, s, unnest(range(1, len(s) + 1)) as k from p))
select repository, parent, name, is_file, row_number() over (partition by repository, parent order by is_file, name collate en_US, name) as place from n""")
def folder_order(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("file_path", "/")
    rows = V.files(spark, d).select("repository", parts.alias("s"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    nodes = rows.select("repository", F.array_join(F.slice("s", F.lit(1), F.col("k") - 1), "/").alias("parent"), F.element_at("s", F.col("k")).alias("name"), (F.col("k") == F.size("s")).alias("is_file")).distinct()
    return pipeline.numbered(nodes, ["repository", "parent"], pipeline.tree_order()).withColumn("place", F.col("place").cast("bigint"))


_VARIANTS = "v as (select distinct case user_id % 8 when 0 then 'A' when 1 then 'B' when 2 then 'D' when 3 then 'E' when 4 then 'B-gemini' when 5 then 'F-' || event_type when 6 then 'E-' || event_type || '+local' else event_type end as variant from events)"


@query("with " + _VARIANTS + """, k as (select variant, case when variant = 'A' then 'static' when variant = 'B' then 'llm-only' when variant in ('D', 'E') then 'hybrid' when variant like 'B-%' then 'llm-only-' || variant[3:] when variant like 'F-%' then 'model-' || variant[3:]
  when variant like 'E-%+%' then 'verify-model-' || split_part(variant[3:], '+', 1) || '-by-' || split_part(variant, '+', 2) end as run, coalesce(list_position(['A', 'D'], variant), 0) as p, coalesce(list_position(['E', 'B'], variant), 0) as r from v)
select variant, run, row_number() over (order by case when p > 0 then 0 when r > 0 then 1 else 2 end, case when p > 0 then p else r end, variant) as place from k""")
def variant_runs(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("user_id") % 8, F.col("event_type")
    name = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "D").when(k == 3, "E").when(k == 4, "B-gemini").when(k == 5, F.concat(F.lit("F-"), e)).when(k == 6, F.concat(F.lit("E-"), e, F.lit("+local"))).otherwise(e)
    v = table(spark, d, "events").select(name.alias("variant")).distinct().withColumn("run", pipeline.run_of(F.col("variant")))
    return pipeline.numbered(v.withColumn("one", F.lit(1)), ["one"], [pipeline.configuration_order(F.col("variant"), ["A", "D"], ["E", "B"])]).select("variant", "run", F.col("place").cast("bigint").alias("place"))


@query(_F + ", d(depth, least) as (values ('static', null), ('quick', 4), ('standard', 3), ('deep', 2)) select depth, count(finding_id) as n from d left join g on models_only and status = 'open' and sev_rank >= least group by 1")
def verifications_by_depth(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d)
    need = lambda least: F.count_if(C.needs_verification(F.col("sources"), F.col("status"), F.col("severity"), least)) if least is not None else F.lit(0).cast("bigint")
    return f.agg(*[need(least).alias(depth) for depth, least in pipeline.VERIFY_FROM.items()]).unpivot([], list(pipeline.VERIFY_FROM), "depth", "n")


@query("select event_id, cast(user_id % 2 = 0 as int) + cast(user_id % 3 = 0 as int) + cast(user_id % 5 = 0 as int) + cast(user_id % 7 = 0 as int) as n from events")
def active_filters(spark: SparkSession, d: str) -> DataFrame:
    on = lambda k: F.when(F.col("user_id") % k == 0, "x").otherwise("any")
    return table(spark, d, "events").select("event_id", pipeline.active_filters(on(2), on(3), on(5), F.col("user_id") % 7 == 0).alias("n"))


@query("select file_id, case when file_id % 3 = 0 then 'archive' else 'file' end as kind, case when file_id % 3 = 0 then file_path || '.ZIP' else regexp_extract(file_path, '([^/]*)$', 1) end as name from source_files where file_path is not null")
def upload_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("file_id") % 3
    name = F.when(k == 0, F.concat("file_path", F.lit(".ZIP"))).when(k == 1, F.translate("file_path", "/", "\\")).otherwise(F.col("file_path"))
    return table(spark, d, "source_files").filter("file_path is not null").select("file_id", pipeline.upload(name).alias("u")).select("file_id", "u.kind", "u.name")


@query("select doc_id, case when doc_id % 2 = 0 then 'v' || doc_id end as version from documents where text is not null")
def prompt_versions(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{# PROMPT_VERSION: v"), F.col("doc_id").cast("string"), F.lit(" #}\n"))).otherwise(F.lit("{# none #}\n"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", pipeline.prompt_version(F.concat(head, "text")).alias("version"))


@query("with " + _CALLS + " select call_id, case when status <> 'skipped' then model end as model, status, left(detail, 200) as detail, case when latency_ms >= 0 then latency_ms else 0 end as latency_ms from c")
def call_records(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.called(V.calls(spark, d, "task", "provider", "model", "status", "detail", "latency_ms")).select("call_id", "model", "status", "detail", "latency_ms")


@query(_F + " select repository, file_path, count(*) as n, count(*) filter (where models_only and status = 'open' and sev_rank >= 2) = 0 as complete from g where repository is not null and file_path is not null group by 1, 2")
def complete_records(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).filter("repository is not null and file_path is not null")
    note = F.when(C.needs_verification(F.col("sources"), F.col("status"), F.col("severity"), 2), "not verified")
    return pipeline.complete(f.withColumn("note", note))


@query("with " + _CALLS + ", t as (select repository, provider, count(*) as n, bool_or(status = 'ok') as ok from c where repository is not null and provider is not null group by 1, 2) select repository, cast(count(*) filter (where ok) as int) as n_ok, cast(sum(n) as bigint) as total from t group by 1")
def provider_tally(spark: SparkSession, d: str) -> DataFrame:
    one = V.calls(spark, d, "repository", "provider", "status").filter("repository is not null and provider is not null").groupBy("repository", "provider").agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_or(F.col("status") == "ok"), "ok").otherwise("failed").alias("state"))
    maps = one.groupBy("repository").agg(F.map_from_entries(F.collect_list(F.struct("provider", "state"))).alias("states"), F.map_from_entries(F.collect_list(F.struct("provider", "n"))).alias("numbers"))
    return pipeline.tally(maps, ["repository"], "numbers")


@query(_ANSWERS + f", ch as (select distinct repository, file_path, chunk_index from chunks where repository is not null and file_path is not null) select s.repository, n_reviewed, coalesce(n_answers, 0) as n_answers, coalesce(n_unusable, 0) as n_unusable, coalesce(n_found, 0) as n_found, coalesce(n_discarded, 0) as n_discarded from (select repository, count(*) as n_reviewed from ch group by 1) s left join (select repository, count(*) as n_answers, count(*) filter (where lost) as n_unusable, count(*) filter (where not lost and coalesce({_VALID}, false)) as n_found, count(*) filter (where not lost and not coalesce({_VALID}, false)) as n_discarded from an group by 1) a using (repository)")
def review_statistics(spark: SparkSession, d: str) -> DataFrame:
    reviewed = table(spark, d, "chunks").filter("repository is not null and file_path is not null").groupBy("repository").agg(F.count_distinct("file_path", F.coalesce("chunk_index", F.lit(-1))).alias("n_reviewed"))
    items = answers.issues(_answer(spark, d), "finding_id", "answer").join(V.findings(spark, d).select("finding_id", "repository"), "finding_id")
    seen = items.groupBy("repository").agg(F.count_distinct("finding_id").alias("n_answers"), F.count_if(~F.col("usable")).alias("n_unusable"), F.count_if(F.col("valid")).alias("n_found"), F.count_if(~F.col("valid")).alias("n_discarded"))
    return reviewed.join(seen, "repository", "left").na.fill(0)


@query(_F + """ select finding_id, file_path, start_line, severity, title from f where start_line is not null and title is not null""")
def verification_payloads(spark: SparkSession, d: str) -> DataFrame:
    f = V.findings(spark, d).filter("start_line is not null and title is not null")
    shown = pipeline.payload(f, texts.excerpts(f, V.lengths(spark, d), 10))
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return shown.select("finding_id", get("file_path").alias("file_path"), get("start_line").cast("int").alias("start_line"), get("severity").alias("severity"), get("title").alias("title"))
