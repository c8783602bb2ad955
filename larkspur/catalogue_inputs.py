"""Queries over tool outputs, structure of files, and answers of models, with their SQL twins.

Outputs and answers are written from the tables in the tools' own formats, one document a file, and read back by the operators; the
twins are taken from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.catalogue import _F, _LINES, _PACKED, query
from larkspur.operators import answers, structure
from larkspur.plans import views as V
from larkspur.plans.durable import table
from larkspur.sources import tools


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Findings with lines, their path below the repository's."""
    f = V.findings(spark, d).filter("start_line is not null and repository is not null and file_path is not null")
    return f.withColumn("path", F.concat_ws("/", "repository", "file_path")).withColumn("last", F.coalesce("end_line", "start_line"))


_LOC = _F + ", loc as (select *, repository || '/' || file_path as path, coalesce(end_line, start_line) as last from f where start_line is not null and repository is not null and file_path is not null)"


def _documents(rows: DataFrame, item: Column, wrap: str | None = None) -> DataFrame:
    """One JSON document of all items per path, as `output`; a file's findings are bounded by its lines."""
    one = rows.groupBy("path").agg(F.collect_list(item).alias("items"))
    return one.select(F.to_json(F.struct(F.col("items").alias(wrap)) if wrap else F.col("items")).alias("output"))


_PREFIXES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in D.RULE_PREFIXES)
_SHORT = "case when length(t) > 80 then rtrim(t[:79], ' ') || '…' else t end"


@query(_LOC + f""", pre(prefix, category, severity) as (values {_PREFIXES}), x as (select path, case when regexp_matches(rule_id, '^[A-Z]+[0-9]+$') then rule_id end as rule_id, start_line, greatest(last, start_line) as end_line from loc),
best as (select rule_id, arg_max(category, length(prefix)) as category, arg_max(severity, length(prefix)) as severity from (select distinct rule_id from x where rule_id is not null) join pre on starts_with(rule_id, prefix) group by 1)
select path as file_path, x.rule_id, start_line, end_line, case when x.rule_id is null then 'bug' else coalesce(best.category, 'style') end as category, case when x.rule_id is null then 'medium' else coalesce(best.severity, 'low') end as severity, count(*) as n
from x left join best on best.rule_id = x.rule_id group by all""")
def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(
        F.col("rule_id").alias("code"), F.coalesce("message", F.lit("")).alias("message"), F.col("path").alias("filename"), F.struct(F.col("start_line").alias("row"), F.lit(1).alias("column")).alias("location"),
        F.struct(F.col("last").alias("row"), F.lit(2).alias("column")).alias("end_location"),
    )
    return tools.lint(_documents(_located(spark, d), item)).groupBy("file_path", "rule_id", "start_line", "end_line", "category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_LOC + """, x as (select path, rule_id, start_line, last, upper(severity) as s, case when confidence is null then 'LOW' when confidence > 0.8 then 'HIGH' else 'MEDIUM' end as c from loc where severity in ('low', 'medium', 'high'))
select path as file_path, rule_id, start_line, greatest(last, start_line) as end_line, case when s = 'HIGH' and c = 'HIGH' then 'high' when (s = 'HIGH' and c = 'MEDIUM') or (s = 'MEDIUM' and c in ('HIGH', 'MEDIUM')) then 'medium' else 'low' end as severity, count(*) as n from x group by all""")
def security_findings(spark: SparkSession, d: str) -> DataFrame:
    sure = F.when(F.col("confidence").isNull(), "LOW").when(F.col("confidence") > 0.8, "HIGH").otherwise("MEDIUM")
    item = F.struct(
        F.col("rule_id").alias("test_id"), F.coalesce("message", F.lit("")).alias("issue_text"), F.col("path").alias("filename"), F.col("start_line").alias("line_number"), F.lit(0).alias("col_offset"), F.array("start_line", "last").alias("line_range"),
        F.upper("severity").alias("issue_severity"), sure.alias("issue_confidence"),
    )
    rows = tools.security(_documents(_located(spark, d).filter("severity in ('low', 'medium', 'high')"), item, "results"))
    return rows.groupBy("file_path", "rule_id", "start_line", "end_line", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_LOC + " select path as file_path, rule_id, start_line, count(*) as n from loc where severity in ('high', 'critical') and start_line >= 1 group by all")
def type_findings(spark: SparkSession, d: str) -> DataFrame:
    shown = F.to_json(F.struct(F.col("path").alias("file"), F.col("start_line").alias("line"), F.lit(0).alias("column"), F.coalesce("message", F.lit("")).alias("message"), F.col("rule_id").alias("code"), F.when(F.col("sev_rank") >= 3, "error").otherwise("note").alias("severity")))
    rows = _located(spark, d).groupBy("path").agg(F.array_join(F.collect_list(shown), "\n").alias("output"))
    return tools.types(rows).groupBy("file_path", "rule_id", "start_line").agg(F.count(F.lit(1)).alias("n"))


@query(_LOC + " select path as file_path, start_line, greatest(start_line, last) as end_line, 'unused-' || replace(category, '_', '-') as rule_id, round(cast(floor(coalesce(confidence, 0.5) * 100) as int) / 100.0, 6)::double as confidence, count(*) as n from loc where category is not null group by all")
def dead_code_findings(spark: SparkSession, d: str) -> DataFrame:
    percent = F.floor(F.coalesce("confidence", F.lit(0.5)) * 100).cast("int")
    size = F.greatest(F.col("last") - F.col("start_line") + 1, F.lit(1))
    shown = F.format_string("%s:%d: unused %s 'x' (%d%% confidence, %d line%s)", "path", "start_line", F.replace("category", F.lit("_"), F.lit(" ")), percent, size, F.when(size == 1, "").otherwise("s"))
    rows = _located(spark, d).filter("category is not null").groupBy("path").agg(F.array_join(F.collect_list(shown), "\n").alias("output"))
    return tools.dead_code(rows).withColumn("confidence", F.round("confidence", 6)).groupBy("file_path", "start_line", "end_line", "rule_id", "confidence").agg(F.count(F.lit(1)).alias("n"))


_CC = "finding_id % 60"
_RANKS = "case when cc <= 5 then 'A' when cc <= 10 then 'B' when cc <= 20 then 'C' when cc <= 30 then 'D' when cc <= 40 then 'E' else 'F' end"


@query(_LOC + f""", x as (select path, 'f' || finding_id as name, {_CC} as cc, start_line, greatest(last, start_line) as end_line from loc)
select path as file_path, start_line, end_line, case when {_RANKS} = 'D' then 'low' else 'medium' end as severity, '''' || name || ''' is too complex (cyclomatic complexity ' || cc || ')' as title from x where cc > 20""")
def complexity_findings(spark: SparkSession, d: str) -> DataFrame:
    cc = F.col("finding_id") % 60
    rank = F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 30, "D").when(cc <= 40, "E").otherwise("F")
    block = lambda kind, *more: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("f"), "finding_id").alias("name"), cc.cast("int").alias("complexity"), rank.alias("rank"), F.col("start_line").alias("lineno"), F.col("last").alias("endline"), *more)
    # a third of the functions are methods of a class, a third closures of such methods
    kept = F.to_json(block("function"))
    method = F.to_json(F.struct(F.lit("class").alias("type"), F.lit("C").alias("name"), F.array(block("method")).alias("methods")))
    closure = F.to_json(F.struct(F.lit("class").alias("type"), F.lit("C").alias("name"), F.array(F.struct(F.lit("class").alias("type"), F.lit("I").alias("name"), F.array(block("function")).alias("closures"))).alias("methods")))
    k = F.col("finding_id") % 3
    rows = _located(spark, d).groupBy("path").agg(F.array_join(F.collect_list(F.when(k == 0, kept).when(k == 1, method).otherwise(closure)), ",").alias("items"))
    outputs = rows.select(F.concat(F.lit("{"), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(": ["), "items", F.lit("]}")).alias("output"))
    return tools.complexity(outputs).select("file_path", "start_line", "end_line", "severity", "title")


@query("select repository || '/' || file_path as file_path, 'Low maintainability index (' || (file_id % 40) || '/100)' as title, file_id % 40 < 20 as low from source_files where repository is not null and file_path is not null and file_id % 40 < 20")
def maintainability_findings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").filter("repository is not null and file_path is not null").select("file_id", F.concat_ws("/", "repository", "file_path").alias("path"))
    outputs = f.select(F.to_json(F.create_map("path", F.struct((F.col("file_id") % 40).cast("double").alias("mi")))).alias("output"))
    return tools.maintainability(outputs).select("file_path", "title", F.lit(True).alias("low"))


@query(_LOC + """, x as (select path, start_line, greatest(last, start_line) as end_line, finding_id % 40 as cc, finding_id % 130 as size, finding_id % 9 as par from loc where path in (select repository || '/' || file_path from source_files))
select path as file_path, start_line, end_line, 'function-complexity' as rule_id, '''a, b'' is too complex (cyclomatic complexity ' || cc || ')' as title from x where cc > 15 and not ends_with(lower(path), '.py')
union all select path, start_line, end_line, 'long-function', '''a, b'' is long (' || size || ' lines)' from x where size > 80 union all select path, start_line, end_line, 'too-many-parameters', '''a, b'' takes ' || par || ' parameters' from x where par > 6""")
def function_rule_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("finding_id")
    shown = F.concat_ws(",", F.lit("9"), (k % 40).cast("string"), F.lit("50"), (k % 9).cast("string"), (k % 130).cast("string"), F.lit('"a@1@x"'), F.concat(F.lit('"'), "path", F.lit('"')), F.lit('"a, b"'), F.lit('"a, b(c)"'), F.col("start_line").cast("string"), F.col("last").cast("string"))
    rows = _located(spark, d).groupBy("path").agg(F.concat(F.array_join(F.collect_list(shown), "\n"), F.lit("\n1,2,3\n")).alias("output"))
    reviewed = table(spark, d, "source_files").select(F.concat_ws("/", "repository", "file_path").alias("file_path"))
    return tools.function_rules(tools.functions(rows, reviewed)).select("file_path", "start_line", "end_line", "rule_id", "title")


@query(_LOC + f""", x as (select *, trim(regexp_replace(coalesce(message, ''), '\\s+', ' ', 'g')) as m from loc), y as (select *, trim(regexp_replace(split_part(m, '. ', 1), '\\s+', ' ', 'g')) as t from x)
select finding_id, path as file_path, start_line, greatest(last, start_line) as end_line, case when category in ({", ".join(f"'{c}'" for c in D.CATEGORIES)}) then category else 'security' end as category,
  case when severity = 'high' then 'high' when severity = 'medium' then 'medium' else 'low' end as severity, {_SHORT} as title, case when starts_with(cwe, 'CWE-') then cwe end as cwe from y""")
def pattern_findings(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("severity") == "high", "ERROR").when(F.col("severity") == "medium", "WARNING").when(F.col("severity") == "low", "INFO").otherwise("OTHER")
    item = F.struct(
        F.col("finding_id").cast("string").alias("check_id"), "path", F.struct(F.col("start_line").alias("line"), F.lit(1).alias("col")).alias("start"), F.struct(F.col("last").alias("line"), F.lit(9).alias("col")).alias("end"),
        F.struct(F.coalesce("message", F.lit("")).alias("message"), word.alias("severity"), F.struct("category", F.lit("high").alias("confidence"), "cwe").alias("metadata")).alias("extra"),
    )
    rows = tools.patterns(_documents(_located(spark, d), item, "results"))
    return rows.select(F.col("rule_id").cast("bigint").alias("finding_id"), "file_path", "start_line", "end_line", "category", "severity", "title", "cwe")


# -- structure --------------------------------------------------------------------------------------------------

_HEAD = "regexp_matches(text, '^(import\\b|from\\s+\\S+\\s+import\\b|package\\b|(const|let|var)\\s+.*=\\s*require\\()')"
_NOTE = "regexp_matches(text, '^\\s*(#|//|/\\*|\\*)')"
_HEADERS = f"hd as (select file_id, cast(min(line_no) as int) as start_line, cast(max(line_no) as int) as end_line from (select file_id, line_no, line_no - row_number() over (partition by file_id order by line_no) as g from lines where {_HEAD}) group by file_id, g)"
_CUT = f"""mk as (select file_id, line_no, {_NOTE} as note, regexp_matches(text, '^[^\\s)\\]}}]') and not {_NOTE} and not regexp_matches(text, '^(else|elif|except|finally|catch|while\\s*\\(.*\\);)\\b') as begins from lines),
st as (select file_id, a from (select file_id, begins, coalesce(max(case when not note then line_no end) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding), 0) + 1 as a from mk) where begins),
sz as (select file_id, max(line_no) as n from lines group by 1), ct as (select file_id, case when row_number() over (partition by file_id order by a) = 1 then 1 else a end as a from st union all select file_id, 1 from sz where file_id not in (select file_id from st)),
ed as (select file_id, a, coalesce(lead(a) over (partition by file_id order by a) - 1, n) as b from ct join sz using (file_id)), sg as (select file_id, cast(a + k * 120 as int) as start_line, cast(least(b, a + k * 120 + 119) as int) as end_line from ed, lateral (select unnest(range(0, (b - a) // 120 + 1)) as k))"""


@query("with " + _LINES + ", " + _HEADERS + " select * from hd")
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.header_ranges(V.lines(spark, d)).select("file_id", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query("with " + _LINES + ", " + _CUT + " select * from sg")
def structural_segments(spark: SparkSession, d: str) -> DataFrame:
    return structure.segments(V.lines(spark, d))


@query("with recursive " + _LINES + ", " + _HEADERS + ", " + _CUT + ", s as materialized (select file_id, start_line as a, end_line as b, row_number() over (partition by file_id order by start_line) as i from sg)" + _PACKED + """,
body as (select file_id, cast(start_line as int) as start_line, end_line from groups g where exists (select 1 from lines l where l.file_id = g.file_id and l.line_no between g.start_line and g.end_line and trim(text, ' ') <> '')),
num as (select *, cast(row_number() over (partition by file_id order by start_line) - 1 as int) as chunk_index from body),
bef as (select n.file_id, chunk_index, h.start_line as a, h.end_line as b, coalesce(sum(h.end_line - h.start_line + 1) over (partition by n.file_id, chunk_index order by h.start_line rows between unbounded preceding and 1 preceding), 0) as used from num n join hd h on h.file_id = n.file_id and h.end_line < n.start_line),
con as (select file_id, chunk_index, string_agg(a || '-' || least(b, a + 40 - used - 1), ',' order by a) as context from bef where used < 40 group by 1, 2),
par as (select n.file_id, chunk_index, string_agg(greatest(r.start_line, n.start_line) || '-' || least(r.end_line, n.end_line), ',' order by k) as partial_regions from num n join (select file_id, unnest(partial_regions) as r, generate_subscripts(partial_regions, 1) as k from source_files) p on p.file_id = n.file_id and r.start_line <= n.end_line and r.end_line >= n.start_line and greatest(r.start_line, n.start_line) <= least(r.end_line, n.end_line) group by 1, 2)
select n.file_id, n.chunk_index, n.start_line, n.end_line, coalesce(context, '') as context, coalesce(partial_regions, '') as partial_regions from num n left join con using (file_id, chunk_index) left join par using (file_id, chunk_index)""")
def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = structure.build_chunks(table(spark, d, "source_files").filter("content is not null"), V.lines(spark, d))
    return rows.withColumn("context", structure.ranges_text(F.col("context"))).withColumn("partial_regions", structure.ranges_text(F.col("partial_regions")))


@query("with " + _LINES + _F.replace("with latest", ", latest", 1) + """, sl as (select distinct repository, file_path, unnest(range(start_line, greatest(start_line, coalesce(end_line, start_line)) + 1)) as line_no from f where issue_key = 'hardcoded-credential' and start_line >= 1)
select l.file_id, cast(l.line_no as int) as line_no, case when sl.line_no is not null then '[line withheld: possible secret]' else text end as text from lines l left join sl on sl.repository = l.repository and sl.file_path = l.file_path and sl.line_no = l.line_no""")
def redacted_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d)
    own = V.findings(spark, d).filter("issue_key = 'hardcoded-credential' and start_line >= 1").select("repository", "file_path", F.explode(F.sequence("start_line", F.greatest("start_line", F.coalesce("end_line", "start_line")))).alias("line_no")).distinct()
    hit = lines.join(own, ["repository", "file_path", "line_no"], "left_semi").select("file_id", "line_no")
    return structure.redact_lines(lines, hit).select("file_id", "line_no", "text")


# -- answers ----------------------------------------------------------------------------------------------------


def _answer(spark: SparkSession, d: str) -> DataFrame:
    """One answer per finding: an issue with its fields as a model would write them, some of them broken."""
    f = V.findings(spark, d).filter("title is not null")
    k = F.col("finding_id")
    item = F.struct(
        F.when(k % 7 == 0, F.lit(0)).otherwise(F.col("start_line")).alias("start_line"), F.coalesce("end_line", "start_line").alias("end_line"), F.when(k % 11 == 0, F.lit("nonsense")).otherwise(F.upper("category")).alias("category"),
        F.concat(F.lit(" "), F.initcap("severity")).alias("severity"), "title", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.concat((k % 101).cast("string"), F.lit("%")).alias("confidence"),
    )
    judged = F.struct(F.concat(F.lit("S"), k.cast("string")).alias("static_id"), F.when(k % 5 == 0, "False Positive").when(k % 5 == 1, "maybe").otherwise("confirmed").alias("verdict"), F.when(k % 2 == 0, "High").otherwise("none").alias("adjusted_severity"))
    body = F.when(k % 13 == 0, F.lit('{"findings": "none"}')).otherwise(F.to_json(F.struct(F.array(item).alias("findings"), F.array(judged).alias("static_judgements"))))
    return f.select("finding_id", F.when(k % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).when(k % 17 == 0, F.lit("no answer")).otherwise(body).alias("answer"))


_ANSWERS = _F + """, an as (select *, finding_id as k, case when finding_id % 7 = 0 then 0 else start_line end as a, coalesce(end_line, start_line) as b, finding_id % 13 = 0 or (finding_id % 17 = 0 and finding_id % 3 <> 0) as lost, (finding_id % 101) as c from f where title is not null)"""


@query(_ANSWERS + """ select finding_id, not lost as usable, case when not lost then coalesce(a >= 1 and b >= a and k % 11 <> 0 and category is not null and severity is not null and trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') <> '' and trim(coalesce(message, ''), ' ') <> '' and trim(coalesce(evidence, ''), ' ') <> '', false) end as valid,
  case when not lost then round(case when c > 1 then c / 100.0 else c end, 6)::double end as confidence from an""")
def answer_items(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.issues(_answer(spark, d), "finding_id", "answer")
    return rows.select("finding_id", "usable", "valid", F.when(F.col("valid").isNotNull(), F.round("confidence", 6)).alias("confidence"))


@query(_ANSWERS + " select finding_id, 'S' || k as static_id, case k % 5 when 0 then 'false_positive' when 1 then 'maybe' else 'confirmed' end as verdict, case when k % 2 = 0 then 'high' end as adjusted_severity, k % 5 <> 1 as valid from an where not lost")
def answer_judgements(spark: SparkSession, d: str) -> DataFrame:
    return answers.judgements(_answer(spark, d), "finding_id", "answer").select("finding_id", "static_id", "verdict", "adjusted_severity", "valid")


@query("select event_id, case event_id % 4 when 0 then 'valid' when 1 then 'uncertain' when 2 then 'perhaps' end as verdict, round(case when v > 1 and v <= 100 then v / 100 else v end, 6) as confidence, case when event_id % 4 = 3 then 'answer' else array_to_string(list_filter([case when (case when v > 1 and v <= 100 then v / 100 else v end) not between 0 and 1 then 'confidence' end, case when event_id % 4 = 2 then 'verdict' end], lambda x: x is not null), ', ') end as bad_fields from (select event_id, case when event_id % 4 = 3 then 0.5 else round(coalesce(value, 0.5), 3) end as v from events)")
def answer_verifications(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    body = F.to_json(F.struct(F.when(k == 0, "Valid").when(k == 1, " uncertain ").otherwise("perhaps").alias("verdict"), F.round("value", 3).alias("confidence")))
    rows = table(spark, d, "events").select("event_id", F.when(k == 3, "{broken").otherwise(body).alias("answer"))
    return answers.verifications(rows, "event_id", "answer").select("event_id", "verdict", F.round("confidence", 6).alias("confidence"), "bad_fields")


@query("""select doc_id, case when doc_id % 5 in (0, 1) then text end as text, case when doc_id % 5 = 2 then 'blocked: SAFETY' when doc_id % 5 = 3 then 'cut off' when doc_id % 5 = 4 then 'empty: STOP' end as error from documents where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' and regexp_matches(text, '[A-Za-z]')""")
def candidate_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    part = F.array(F.struct(F.lit("thinking").alias("text"), F.lit(True).alias("thought")), F.struct(F.col("text"), F.lit(False).alias("thought")))
    good = F.to_json(F.struct(F.array(F.struct(F.lit("STOP").alias("finishReason"), F.struct(part.alias("parts")).alias("content"))).alias("candidates")))
    other = F.when(k == 2, '{"promptFeedback": {"blockReason": "SAFETY"}}').when(k == 3, '{"candidates": [{"finishReason": "MAX_TOKENS"}]}').otherwise('{"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "  "}]}}]}')
    rows = table(spark, d, "documents").filter(F.trim("text") != "").filter(F.col("text").rlike("[A-Za-z]"))
    return rows.select("doc_id", answers.candidate_text(F.when(k < 2, good).otherwise(other)).alias("c")).select("doc_id", "c.text", "c.error")


@query("select event_id, case event_id % 4 when 0 then 'user ' || user_id when 1 then event_type when 2 then 'plain ' || event_id else 'Bad Request' end as detail from events")
def error_texts(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("event_id") % 4, table(spark, d, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    body = F.when(k == 0, F.to_json(F.struct(F.struct(user.alias("message")).alias("error")))).when(k == 1, F.to_json(F.struct(F.col("event_type").alias("error")))).when(k == 2, F.concat(F.lit("plain "), F.col("event_id").cast("string"))).otherwise(F.lit('{"ok": false}'))
    return e.select("event_id", answers.error_text(body, F.lit("Bad Request")).alias("detail"))


