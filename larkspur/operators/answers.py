"""Answers of models and errors of providers as rows: parsed and checked in the JVM.

Items of a list are checked one by one (bad ones are dropped and counted), whole answers are taken or refused with the
names of their bad fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C

JUDGEMENTS = ("confirmed", "false_positive", "uncertain")
VERDICTS = ("valid", "invalid", "uncertain")
#: Entries kept of a summary's lists (fixed values).
MOST = {"strengths": 3, "top_risks": 5, "recommended_next_steps": 5}
#: Characters kept of an error's text (a fixed value).
LONGEST_ERROR = 200

_TEXT = "map<string,string>"


def _present(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def _line(text: Column) -> Column:
    return text.try_cast("double").try_cast("int")


def issues(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, usable, place, valid, start_line, end_line, category, severity, title, message, evidence, confidence, cwe): one row per item of an answer's list `findings`.

    usable is false (with one row and no item) for an answer without a JSON object or such a list. An item is valid with lines from 1 on in order, a known
    category and severity, and a title, message and evidence that are not blank; confidence is 0.5 where it is left out.
    """
    whole = F.from_json(C.json_object(F.col(text)), "struct<findings:string>")["findings"]
    items = answers.select(key, F.when(F.trim(whole).startswith("["), F.from_json(whole, f"array<{_TEXT}>")).alias("items"))
    each = items.select(key, F.col("items").isNotNull().alias("usable"), F.posexplode_outer("items").alias("place", "i"))
    get = lambda f: F.try_element_at("i", F.lit(f))
    confidence = F.when(get("confidence").isNull(), F.lit(0.5)).otherwise(C.fraction(get("confidence")))
    rows = each.select(
        key, "usable", "place", _line(get("start_line")).alias("start_line"), _line(get("end_line")).alias("end_line"), C.normal_word(get("category")).alias("category"), C.normal_word(get("severity")).alias("severity"),
        C.shorten(get("title")).alias("title"), F.trim(get("message")).alias("message"), F.trim(get("evidence")).alias("evidence"), confidence.alias("confidence"), C.cwe_id(get("cwe")).alias("cwe"),
    )
    valid = (
        (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & F.col("category").isin(*D.CATEGORIES) & F.col("severity").isin(*D.SEVERITIES) & _present(F.col("title")) & _present(F.col("message"))
        & _present(F.col("evidence")) & F.col("confidence").between(0, 1)
    )
    return rows.withColumn("valid", F.when(F.col("place").isNotNull(), F.coalesce(valid, F.lit(False))))


def judgements(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, valid, static_id, verdict, reason, adjusted_severity) of an answer's list `static_judgements`; none where it is no list."""
    whole = F.from_json(C.json_object(F.col(text)), "struct<static_judgements:string>")["static_judgements"]
    each = answers.select(key, F.posexplode(F.when(F.trim(whole).startswith("["), F.from_json(whole, f"array<{_TEXT}>"))).alias("place", "i"))
    get = lambda f: F.try_element_at("i", F.lit(f))
    severity = C.normal_word(get("adjusted_severity"))
    rows = each.select(key, "place", get("static_id").alias("static_id"), C.normal_word(get("verdict")).alias("verdict"), F.coalesce(F.trim(get("reason")), F.lit("")).alias("reason"), severity.alias("adjusted_severity"))
    valid = F.col("static_id").isNotNull() & F.col("verdict").isin(*JUDGEMENTS) & (F.col("adjusted_severity").isNull() | F.col("adjusted_severity").isin(*D.SEVERITIES))
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def verifications(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, verdict, corrected_severity, confidence, bad_fields): whole answers; bad_fields names what is wrong, and `answer` means no JSON object."""
    data = F.from_json(C.json_object(F.col(text)), _TEXT)
    get = lambda f: F.try_element_at(data, F.lit(f))
    confidence = F.when(get("confidence").isNull(), F.lit(0.5)).otherwise(C.fraction(get("confidence")))
    rows = answers.select(key, data.isNotNull().alias("_is"), C.normal_word(get("verdict")).alias("verdict"), C.normal_word(get("corrected_severity")).alias("corrected_severity"), confidence.alias("confidence"))
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"), F.when(F.col("corrected_severity").isNotNull() & ~F.col("corrected_severity").isin(*D.SEVERITIES), "corrected_severity"),
        F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict"),
    ))
    return rows.withColumn("bad_fields", F.when(~F.col("_is"), F.lit("answer")).otherwise(F.array_join(bad, ", "))).drop("_is")


def summaries(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, headline, strengths, top_risks, recommended_next_steps) of summary answers, lists cut to their length; those without a headline are dropped."""
    shape = "struct<headline:string,strengths:array<string>,top_risks:array<struct<title:string,files:array<string>,why:string>>,recommended_next_steps:array<string>>"
    rows = answers.select(key, F.from_json(C.json_object(F.col(text)), shape).alias("s")).select(key, "s.*").filter(_present(F.col("headline")))
    return rows.select(key, "headline", *[F.slice(F.coalesce(c, F.array().cast(t)), 1, MOST[c]).alias(c) for c, t in (("strengths", "array<string>"), ("top_risks", "array<struct<title:string,files:array<string>,why:string>>"), ("recommended_next_steps", "array<string>"))])


def candidate_text(payload: Column) -> Column:
    """struct(text, error): the first candidate's parts but thoughts, joined; an error for a blocked, cut off or empty answer."""
    shape = "struct<candidates:array<struct<finishReason:string,content:struct<parts:array<struct<text:string,thought:boolean>>>>>,promptFeedback:struct<blockReason:string>>"
    p = F.from_json(payload, shape)
    first = F.try_element_at(p["candidates"], F.lit(1))
    parts = F.filter(F.coalesce(first["content"]["parts"], F.array().cast("array<struct<text:string,thought:boolean>>")), lambda x: ~F.coalesce(x["thought"], F.lit(False)))
    text = F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    error = (
        F.when(F.coalesce(F.size(p["candidates"]), F.lit(0)) < 1, F.concat(F.lit("blocked: "), F.coalesce(p["promptFeedback"]["blockReason"], F.lit("unknown"))))
        .when(first["finishReason"] == "MAX_TOKENS", "cut off").when(F.trim(text) == "", F.concat(F.lit("empty: "), F.coalesce(first["finishReason"], F.lit("unknown"))))
    )
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def error_text(body: Column, reason: Column) -> Column:
    """What an error body says in `LONGEST_ERROR` characters: error.message, else an error text, else the body if it is no JSON, else the reason."""
    is_json = F.try_parse_json(body).isNotNull()
    error = F.get_json_object(body, "$.error")
    said = F.when(F.trim(error).startswith("{"), F.get_json_object(body, "$.error.message")).otherwise(error)
    return F.substring(F.coalesce(F.nullif(F.when(is_json, said).otherwise(body), F.lit("")), reason), 1, LONGEST_ERROR)


def admissible(cached: DataFrame, providers: DataFrame, excluded: list[str], only: list[str] | None, allow_external: bool) -> DataFrame:
    """The cached answers whose provider may answer now: not excluded, among `only` if given, external ones only with consent, and whose text still is a JSON object."""
    p = providers.select("provider", "is_external").distinct()
    permitted = ~F.col("provider").isin(*excluded) & (F.lit(True) if only is None else F.col("provider").isin(*only)) & (F.lit(allow_external) | ~F.col("is_external"))
    return cached.join(p.filter(permitted).select("provider"), "provider", "left_semi").filter(C.json_object(F.col("answer")).isNotNull())
