"""Operators against brute force on small fixtures."""

from __future__ import annotations

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur import catalogue, catalogue_pipeline
from larkspur.operators import agreement, matching, routing, texts
from larkspur.operators import findings as fnd
from larkspur.sources import tools

FINDING = "finding_id bigint, repository string, file_path string, start_line int, end_line int, rule_id string, category string, severity string, sev_rank int, title string, sources array<string>, confidence double, cwe string, status string, ord bigint"


def finding(i, line=1, tool="ruff", rule="F401", sev="low", rank=1, end=None, conf=1.0, cwe=None, category="style", path="a.py"):
    return (i, "r", path, line, end or line, rule, category, sev, rank, f"t{i}", [tool], conf, cwe, "open", i)


def test_equivalent_rules_merge_and_one_tools_do_not(spark):
    rows = [finding(1), finding(2, tool="vulture", rule="unused-import", sev="high", rank=3, end=4, cwe="CWE-1"), finding(3), finding(4, line=9)]
    out = {r["finding_id"]: r for r in fnd.dedupe(spark.createDataFrame(rows, FINDING)).collect()}
    assert set(out) == {2, 3, 4}
    assert out[2]["sources"] == ["vulture", "ruff"] and out[2]["n_merged"] == 2 and out[2]["end_line"] == 4 and out[2]["cwe"] == "CWE-1"


def test_dedupe_is_idempotent(spark):
    r = random.Random(3)
    rows = [finding(i, line=r.randint(1, 3), tool=r.choice(["ruff", "vulture"]), rule="F401") for i in range(30)]
    once = fnd.dedupe(spark.createDataFrame(rows, FINDING), F.lit("k")).count()
    assert once == sum(max(sum(x[3] == k and x[10] == [t] for x in rows) for t in ("ruff", "vulture")) for k in (1, 2, 3))


def test_matching_agrees_with_brute_force(spark):
    r = random.Random(5)
    preds = [finding(i, line=(s := r.randint(1, 40)), end=s + r.randint(0, 80), category="bug", path=r.choice(["a", "b"])) for i in range(14)]
    labels = [(f"L{i:02}", "r", r.choice(["a", "b"]), (s := r.randint(1, 40)), s + r.randint(0, 3), "bug") for i in range(8)]
    p = spark.createDataFrame(preds, FINDING)
    q = spark.createDataFrame(labels, "label_id string, repository string, file_path string, start_line int, end_line int, category string")
    edges = {(x[0], y[0]) for x in preds for y in labels if x[2] == y[2] and x[3] <= y[4] + 2 and x[4] >= y[3] - 2}
    got = [(e["finding_id"], e["label_id"]) for e in matching.label_matches(p, q).collect()]
    assert sorted(got) == sorted(edges)
    found = matching.found_labels(p, q).collect()
    assert len({f["label_id"] for f in found}) == len({f["finding_id"] for f in found}) == len(found)
    assert all((f["finding_id"], f["label_id"]) in edges for f in found)
    best = 0
    names = [y[0] for y in labels]
    for k in range(len(names), 0, -1):
        for sub in itertools.combinations(names, k):
            if _perfect(sub, edges):
                best = k
                break
        if best:
            break
    assert len(found) == best


def _perfect(labels, edges):
    taken = {}

    def go(label, seen):
        for f in {f for f, x in edges if x == label} - seen:
            seen.add(f)
            if f not in taken or go(taken[f], seen):
                taken[f] = label
                return True
        return False

    return all(go(x, set()) for x in labels)


def test_undefined_precision_is_null_and_f1_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 3), (0, 2, 0, 3), (1, 2, 1, 2)], "m int, p int, c int, l int").select(*matching.counts(F.col("m"), F.col("p"), F.col("c"), F.col("l")))
    rows = df.collect()
    assert rows[0]["precision"] is None and rows[0]["f1"] is None
    assert rows[1]["f1"] == 0.0
    assert rows[2]["f1"] == 0.5


def test_no_window_holds_more_than_the_limit():
    r = random.Random(1)
    times = sorted(r.uniform(0, 50) for _ in range(200))
    out = routing.slots(times, 7, 10.0)
    assert all(s >= t for s, t in zip(out, times))
    assert all(out[i] - out[i - 7] >= 10.0 - 1e-9 for i in range(7, len(out)))


def test_breaker_opens_on_three_failures_and_ignores_late_answers():
    b = routing.Breaker()
    for t in (0.0, 1.0, 2.0):
        b.record(t, "unavailable")
    assert b.state(3.0) == "open"
    b.record(4.0, "ok")
    assert b.state(5.0) == "open" and b.state(40.0) == "half_open"
    b.record(41.0, "ok")
    assert b.state(42.0) == "closed"
    b.record(43.0, "rate_limited")
    assert b.state(44.0) == "open" and b.state(46.0) == "half_open"


CALL = "call_id bigint, called_at timestamp, provider string, status string, input_tokens bigint, model string, file_path string"


def at_midnight(spark, *rows):
    """Calls of provider p on both sides of a midnight: (second after 23:59:50, status, tokens, path)."""
    zero = datetime.datetime(2025, 3, 1, 23, 59, 50, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(i, zero + datetime.timedelta(seconds=s), "p", status, tokens, "m", path) for i, (s, status, tokens, path) in enumerate(rows)], CALL)


def test_state_outlives_midnight(spark):
    same = at_midnight(spark, (0, "ok", 0, "a"), (11, "ok", 0, "a"), (12, "ok", 0, "b"))
    assert {(r["day"], r["n_calls"], r["n_hits"]) for r in routing.lru_hits(same).collect()} == {("2025-03-01", 1, 0), ("2025-03-02", 2, 1)}
    down = at_midnight(spark, *[(s, "unavailable", 0, "a") for s in (0, 1, 2)], (11, "ok", 0, "a"), (40, "ok", 0, "a"), (41, "ok", 0, "a"))
    assert [r["state"] for r in routing.breaker_states(down).orderBy("call_id").collect()] == ["closed", "closed", "closed", "open", "half_open", "closed"]
    spent = at_midnight(spark, (0, "ok", 100, "a"), (12, "ok", 10, "a"))
    assert [r["level"] for r in routing.token_bucket(spent, 100.0, 1.0).orderBy("call_id").collect()] == [0.0, 2.0]
    queued = at_midnight(spark, (0, "ok", 0, "a"), (1, "ok", 0, "a"), (11, "ok", 0, "a"))
    assert [r["wait"] for r in routing.limiter_slots(queued, 2, 60.0).orderBy("call_id").collect()] == [0.0, 0.0, 49.0]


def test_stretches_of_a_provider_are_one_history(spark):
    r = random.Random(4)
    rows = [(s, r.choice(["ok", "ok", "unavailable", "rate_limited"]), r.randint(0, 90), f"f{r.randint(0, 9)}") for s in sorted(r.sample(range(4000), 300))]
    calls = at_midnight(spark, *rows)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    plans = (routing.limiter_slots(calls, 3, 60.0), routing.token_bucket(calls, 300.0, 1.0), routing.breaker_states(calls), routing.lru_hits(calls, 5))
    whole = [sorted(map(tuple, p.collect())) for p in plans]
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        again = (routing.limiter_slots(calls, 3, 60.0), routing.token_bucket(calls, 300.0, 1.0), routing.breaker_states(calls), routing.lru_hits(calls, 5))
        assert [sorted(map(tuple, p.collect())) for p in again] == whole
    finally:
        spark.conf.set(setting, before)


def test_a_long_run_of_rate_limits_keeps_the_longest_pause():
    b = routing.Breaker()
    for t in range(1100):
        b.record(float(t), "rate_limited")
    assert b.state(1158.0) == "open" and b.state(1159.0) == "half_open"


def test_cohen_textbook(spark):
    cells = [(1, 1, 20), (1, 2, 5), (2, 1, 10), (2, 2, 15)]
    rows, k = [], 0
    for x, y, n in cells:
        for _ in range(n):
            rows += [("a", f"i{k}", "c", x), ("b", f"i{k}", "c", y)]
            k += 1
    df = spark.createDataFrame(rows, "rater string, item string, criterion string, score int")
    assert agreement.cohen_kappa(df, quadratic=False).first()["kappa"] == pytest.approx(0.4, abs=1e-6)


def test_fleiss_has_a_row_per_number_of_raters(spark):
    rows = [(f"r{k}", item, "c", s) for item, scores in (("a", (1, 1)), ("b", (2, 2)), ("d", (1, 2, 2)), ("e", (1, 1, 1)), ("f", (3,))) for k, s in enumerate(scores)]
    out = agreement.fleiss_by_raters(spark.createDataFrame(rows, "rater string, item string, criterion string, score int")).collect()
    assert sorted(map(tuple, out)) == [("c", 2, 2, 1.0), ("c", 3, 2, 0.25)]


def test_packed_segments_stay_within_the_target(spark):
    rows = [(1, 1, 10), (1, 12, 20), (1, 22, 90), (1, 95, 99)]
    out = texts.pack_segments(spark.createDataFrame(rows, "file_id int, start_line int, end_line int"), 25).collect()
    assert [(r["start_line"], r["end_line"]) for r in out] == [(1, 20), (22, 90), (95, 99)]


def test_masking_numbers_values_by_first_use(spark):
    lines = spark.createDataFrame([(1, 1, "a = 'secret-bb'"), (1, 2, "b = 'secret-a' + 'secret-bb'")], "file_id int, line_no int, text string")
    hashes = spark.createDataFrame([("secret-a",), ("secret-bb",)], "v string").select(F.sha1("v").alias("sha1"))
    out = {r["line_no"]: r["masked"] for r in texts.mask_values(lines, hashes).collect()}
    assert out == {1: "a = '<REDACTED_SECRET_1>'", 2: "b = '<REDACTED_SECRET_2>' + '<REDACTED_SECRET_1>'"}


def test_tool_outputs(spark):
    lint = '[{"code": "F401", "message": "x  unused", "filename": "a.py", "location": {"row": 3, "column": 1}, "end_location": {"row": 3, "column": 9}}, {"code": "invalid-syntax", "message": "m", "filename": "b.py", "location": {"row": 5, "column": 1}, "end_location": {"row": 2, "column": 1}}]'
    rows = {r["file_path"]: r for r in tools.lint(spark.createDataFrame([(lint,)], "output string")).collect()}
    assert (rows["a.py"]["category"], rows["a.py"]["severity"], rows["a.py"]["end_column"], rows["a.py"]["title"]) == ("maintainability", "low", 9, "x unused")
    assert (rows["b.py"]["rule_id"], rows["b.py"]["severity"], rows["b.py"]["end_line"]) == (None, "medium", 5)
    dead = tools.dead_code(spark.createDataFrame([("a.py:3: unused import 'os' (90% confidence)\nnoise\nb.py:4: unused function 'f' (60% confidence, 5 lines)",)], "output string")).collect()
    assert [(r["file_path"], r["start_line"], r["end_line"], r["rule_id"], r["confidence"]) for r in dead] == [("a.py", 3, 3, "unused-import", 0.9), ("b.py", 4, 8, "unused-function", 0.6)]
    sec = tools.security(spark.createDataFrame([('{"results": [{"test_id": "B105", "issue_text": "s", "filename": "a.py", "line_number": 2, "col_offset": 0, "line_range": [2, 4], "issue_severity": "LOW", "issue_confidence": "MEDIUM"}]}',)], "output string")).first()
    assert (sec["severity"], sec["end_line"], sec["start_column"], sec["title"]) == ("low", 4, 1, "Possible hard-coded password")


def test_chunk_context_has_forty_lines(spark, tmp_path):
    rows = [("c", 100, [(1, 30), (50, 70)]), ("d", 100, [(1, 7)])]
    spark.createDataFrame(rows, "chunk_id string, start_line int, context array<struct<start_line:int,end_line:int>>").write.parquet(f"{tmp_path}/chunks.parquet")
    out = {r["chunk_id"]: json.loads(r["shown"]) for r in catalogue.chunk_context(spark, str(tmp_path)).collect()}
    assert out == {"c": [{"start": 1, "end": 30}, {"start": 50, "end": 59}], "d": [{"start": 1, "end": 7}]}


def test_leaders_fold_in_order(spark):
    rows = [finding(1, 1, end=5), finding(2, 4, end=8), finding(3, 7, end=9), finding(4, 5, end=6)]
    out = {r["finding_id"]: r["leader_id"] for r in matching.leader_clusters(spark.createDataFrame(rows, FINDING)).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 1}


def test_excerpts_meet_files_without_their_lines(spark, tmp_path):
    """A finding is one row however long its span, and no side of their join is broadcast by its estimate."""
    at = datetime.datetime(2026, 1, 1)
    files = [(1, "r", "a.py", "1\n22\n333\n", at), (2, "r", "a.py", "1\r\n22\n333\n4444", at + datetime.timedelta(1)), (3, "r", "b.py", "x\n", at), (4, "r", "b.py", None, at + datetime.timedelta(1)), (5, "r", "c.py", "", at)]
    spark.createDataFrame(files, "file_id bigint, repository string, file_path string, content string, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/source_files.parquet")
    spans = {1: ("a.py", 1, None), 2: ("a.py", 4, 2), 3: ("a.py", 2, 2**31 - 1), 4: ("a.py", 2**31 - 1, None), 5: ("a.py", -50, None), 6: ("a.py", 7, None), 7: ("b.py", 1, 1), 8: ("c.py", 1, 1), 9: ("a.py", None, 1), 10: (None, 1, 1)}
    rows = [(i, "r", *span, "style", "low", "t", "m", ["x"], 1.0, at) for i, span in spans.items()]
    spark.createDataFrame(rows, "finding_id bigint, repository string, file_path string, start_line int, end_line int, category string, severity string, title string, message string, sources array<string>, confidence double, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/findings.parquet")
    out = catalogue.excerpt_padding(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 6), (2, 2, 4, 9), (3, 1, 4, 10)]
    shown = catalogue_pipeline.verification_payloads(spark, str(tmp_path))
    assert sorted(map(tuple, shown.collect())) == [(i, path, line, "low", "t") for i, (path, line, _) in spans.items() if line is not None]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (out, shown)]
    assert "Broadcast" not in plans[0] and not any("Generate" in p for p in plans)
