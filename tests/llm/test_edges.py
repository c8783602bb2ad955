"""Every training-data operator on empty tables, nulls in any column, repeated rows and extra columns of clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.llm import consensus, credentials, mixing, packing, parsing, percentiles, provenance, quality, queries, splitting, survivors
from larkspur.operators import texts

RANGES = "array<struct<start_line:int,end_line:int>>"
SCHEMAS = {
    "source_files": f"file_id bigint, repository string, file_path string, file_language string, support string, line_count int, size_bytes bigint, partial_regions {RANGES}, content string, ingested_at timestamp_ntz",
    "chunks": f"chunk_id bigint, file_id bigint, repository string, file_path string, file_language string, chunk_index int, start_line int, end_line int, context {RANGES}, partial_regions {RANGES}, numbered_code string",
    "findings": "finding_id bigint, repository string, file_path string, start_line int, end_line int, start_column int, end_column int, category string, severity string, title string, message string, rationale string, evidence string, "
    "rule_id string, issue_key string, sources array<string>, confidence double, status string, cwe string, suggestion string, verified_by array<string>, ai_note string, reported_at timestamp_ntz, loaded_at timestamp_ntz",
    "calls": "call_id bigint, called_at timestamp_ntz, logged_at timestamp_ntz, task string, provider string, model string, status string, latency_ms bigint, input_tokens bigint, output_tokens bigint, cached boolean, detail string, repository string, file_path string",
    "provider_status": "provider string, model string, is_external boolean, breaker_state string, p95_limit_ms bigint",
    "rating_sheet": "rating_id bigint, rater string, item string, correctness string, usefulness string, clarity string, rated_at timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, repository string, file_path string, created_at timestamp_ntz",
    "mix_targets": "doc_source string, target_share double, max_repeats int",
}
OPERATORS = {
    "p1": (("source_files",), provenance.classify),
    "p1_findings": (("findings", "source_files"), provenance.hand_written_findings),
    "p2_found": (("rating_sheet",), consensus.unreliable),
    "p2_consensus": (("rating_sheet",), consensus.consensus),
    "p2_agreement": (("rating_sheet",), consensus.agreement),
    "p3_found": (("chunks", "findings"), credentials.found),
    "p3_redacted": (("chunks", "findings"), credentials.redacted),
    "p4": (("findings",), survivors.survivors),
    "p5": (("source_files",), parsing.verdicts),
    "p5_rates": (("source_files",), parsing.rates),
    "p6": (("calls", "provider_status"), lambda c, p: percentiles.percentiles(percentiles.call_latencies(c, p), ["model", "call_day"], "latency_ms", [50, 95])),
    "p7": (("chunks",), splitting.boundaries),
    "p7_pieces": (("chunks",), splitting.pieces),
    "p8": (("documents",), packing.containers),
    "p9": (("documents", "mix_targets"), lambda d, t: mixing.shares(*mixing.mix(d, t))),
    "p10": (("documents",), quality.statistics),
}
#: Names that operators use inside themselves.
CLASHES = ("n", "w", "k", "r", "score", "rank", "length", "epoch", "slot", "text2", "_v", "_n", "_g0", "_salt", "head", "hash", "size", "path", "prose", "valid", "tokens", "share", "criterion", "level")


def frames(spark, tables, rows, extra=False):
    out = []
    for t in tables:
        df = spark.createDataFrame(rows.get(t, []), SCHEMAS[t])
        out.append(df.withColumns({c: F.lit("clash") for c in CLASSES_OF(df)}) if extra else df)
    return out


def CLASSES_OF(df):  # noqa: N802
    return [c for c in CLASHES if c not in df.columns]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    tables, run = OPERATORS[name]
    got = run(*frames(spark, tables, {})).collect()
    assert len(got) == (1 if name == "p5_rates" and got else 0)


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_nulls(spark, name):
    tables, run = OPERATORS[name]
    rows = {t: [tuple(None for _ in SCHEMAS[t].replace("struct<start_line:int,end_line:int>", "x").split(","))] * 2 for t in tables}
    run(*frames(spark, tables, rows)).collect()


CODE = "\n".join(f"{i:>3} | {'def f%d(a):' % i if i % 10 == 1 else '    a = a + %d' % i}" for i in range(1, 301))


def test_sensitive_lines_are_reported_or_hold_a_known_value(spark, tmp_path):
    content = "a = 1\nfirst = 'Panel*Remote8528'\nb = 2\nc = 3\nlast = call(\"Panel*Remote8528\")\ntoken = \"eyJhbGciOi.J9_x-y/z+w==\"\n"
    spark.createDataFrame([(1, "r", "a.py", content), (2, "r", "b.py", content)], "file_id bigint, repository string, file_path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    rows = [
        (1, "r", "a.py", 3, 4, "hardcoded-credential", texts.REDACTED), (2, "r", "z.py", 9, 9, "hardcoded-credential", "password = 'Panel*Remote8528'"),
        (3, "r", "a.py", 6, 90, "hardcoded-credential", None), (4, "r", "b.py", 1, 1, "ruff:F401", "a = 1"), (5, "r", "z.py", 1, 1, "hardcoded-credential", 'token = "eyJhbGciOi.J9_x-y/z+w=="'),
    ]
    schema = "finding_id bigint, repository string, file_path string, start_line int, end_line int, issue_key string, evidence string"
    df = spark.createDataFrame(rows, schema).select("*", F.lit("high").alias("severity"), F.lit(1.0).alias("confidence"), F.array(F.lit("x")).alias("sources"), F.lit(1).alias("loaded_at"))
    df.write.parquet(f"{tmp_path}/findings.parquet")
    out = queries.sensitive_lines(spark, str(tmp_path)).collect()
    assert sorted((r["file_id"], r["line_no"]) for r in out) == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 2), (2, 5), (2, 6)]


def sample(t):
    import datetime as dt

    at = dt.datetime(2025, 1, 1, 12)
    return {
        "source_files": [(1, "r", "a.py", "python", "full", 1, 5, [], "x = 1\n", at), (2, "r", "b.py", "python", "full", 1, 5, None, "x = (\n", at), (3, "r", "c.py", "python", "full", 0, 0, [], "", at)],
        "chunks": [(1, 1, "r", "a.py", "python", 0, 1, 300, [], [], CODE)],
        "findings": [(i, "r", "a.py", 3 + i, 4, None, None, "bug", "high", "t", m, None, 'password = "Kettle!Signal204"', "R", "k", ["A ", "a"], c, "open", None, None, [], None, at, at) for i, m, c in ((1, "long enough", 90.0), (2, "cut...", None))],
        "calls": [(i, at, at, "review", "p", "M ", "ok", 10 * i, 1, 1, False, None, "r", "a.py") for i in range(1, 11)],
        "provider_status": [("p", "m", True, "closed", 50)],
        "rating_sheet": [(10 * j + i, f"r{i}", f"i{j}", str(1 + (j + (i == 9) * j * 7) % 5), "4.0", " ", at) for i in range(10) for j in range(20)],
        "documents": [(i, "This is what we have to say about it, and it is not much.", "en", "a_b ", 1, "r", None, at) for i in range(3)],
        "mix_targets": [("a-b", 1.0, 2)],
    }[t]


def plain(rows):
    return sorted(repr(r.asDict(True)) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_with_clashing_names_change_nothing(spark, name):
    tables, run = OPERATORS[name]
    rows = {t: sample(t) for t in tables}
    a = run(*frames(spark, tables, rows))
    b = run(*frames(spark, tables, rows, extra=True))
    assert plain(a.collect()) == plain(b.select(*a.columns).collect())


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("p3_redacted", "p5", "p8", "p10", "p1_findings")])
def test_repeated_rows_count_once(spark, name):
    tables, run = OPERATORS[name]
    rows = {t: sample(t) for t in tables}
    twice = {t: r if t in ("provider_status", "mix_targets") else r * 2 for t, r in rows.items()}
    assert plain(run(*frames(spark, tables, rows)).collect()) == plain(run(*frames(spark, tables, twice)).collect())
