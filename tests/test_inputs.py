"""Tool outputs, answers and structure on small fixtures: broken input, nesting, empty tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from larkspur.operators import answers, pipeline, routing, structure, texts
from larkspur.sources import tools


def _out(spark, *texts_):
    return spark.createDataFrame([(t,) for t in texts_], "output string")


def test_complexity_follows_classes_and_closures(spark):
    inner = {"type": "function", "name": "c", "complexity": 50, "rank": "F", "lineno": 3, "endline": 4}
    method = {"type": "method", "name": "m", "complexity": 22, "rank": "D", "lineno": 2, "endline": 1, "closures": [inner]}
    report = {"/r/a.py": [{"type": "class", "name": "K", "complexity": 99, "rank": "F", "lineno": 1, "endline": 9, "methods": [method]}, {"type": "function", "name": "f", "complexity": 3, "rank": "A", "lineno": 11, "endline": 12}], "/r/b.py": {"error": "x"}, "/other/c.py": [inner]}
    got = {(r["file_path"], r["title"], r["severity"], r["end_line"]) for r in tools.complexity(_out(spark, json.dumps(report), "not json", None), "/r").collect()}
    assert got == {("a.py", "'m' is too complex (cyclomatic complexity 22)", "low", 2), ("a.py", "'c' is too complex (cyclomatic complexity 50)", "medium", 4)}
    assert tools.complexity(_out(spark)).count() == 0


def test_functions_keep_whole_lines_of_reviewed_files(spark):
    lines = '9,16,50,7,81,"f@1@a.js","a.js","f","f(a, b)",1,90\n1,2,3\n9,99,50,7,81,"f@1@b.js","b.js","f","f",1,90\n1,2,3,4,5,"l","a.js","g","g",5,6,7\n'
    reviewed = spark.createDataFrame([("a.js",)], "file_path string")
    rows = tools.functions(_out(spark, lines), reviewed)
    assert [(r["file_path"], r["name"], r["end_line"]) for r in rows.collect()] == [("a.js", "f", 90)]
    assert sorted(r["rule_id"] for r in tools.function_rules(rows).collect()) == ["function-complexity", "long-function", "too-many-parameters"]


def test_patterns_take_defaults_for_unknown_words(spark):
    one = {"check_id": "r", "path": "a.py", "start": {"line": 3, "col": 2}, "end": {"line": 2, "col": 9}, "extra": {"message": "First  thing. Then\nmore", "severity": "LOUD", "metadata": {"category": "odd", "cwe": "79"}}}
    row = tools.patterns(_out(spark, json.dumps({"results": [one]}), "{}")).collect()
    assert [(r["title"], r["severity"], r["category"], r["confidence"], r["cwe"], r["end_line"], r["end_column"]) for r in row] == [("First thing", "low", "security", 0.7, None, 3, None)]


def test_parseable_files(spark):
    rows = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "x = ="), ("c.js", "x = 1"), ("d.py", None), ("e.pyi", "")], "file_path string, content string")
    assert {r["file_path"] for r in tools.parseable(rows).collect()} == {"a.py", "e.pyi"}


def test_segments_cover_every_line_once(spark):
    text = ["import os", "", "# about f", "def f():", "    return 1", "", "class A:", *["    x = 1"] * 10, "else:", "    pass"]
    rows = [(1, i + 1, t) for i, t in enumerate(text)] + [(2, 1, "    only indented"), (2, 2, "  lines")]
    lines = spark.createDataFrame(rows, "file_id bigint, line_no int, text string")
    got = sorted((r["file_id"], r["start_line"], r["end_line"]) for r in structure.segments(lines, longest=6).collect())
    assert got == [(1, 1, 2), (1, 3, 6), (1, 7, 12), (1, 13, 18), (1, 19, 19), (2, 1, 2)]
    assert [(r["start_line"], r["end_line"]) for r in structure.header_ranges(lines).collect()] == [(1, 1)]
    files = spark.createDataFrame([(1, [(5, 8)]), (2, None)], "file_id bigint, partial_regions array<struct<start_line:int,end_line:int>>")
    chunks = sorted(structure.build_chunks(files, lines, target=8, longest=6).select("file_id", "chunk_index", "start_line", "end_line", structure.ranges_text(F.col("context")), structure.ranges_text(F.col("partial_regions"))).collect())
    assert [tuple(c) for c in chunks] == [(1, 0, 1, 6, "", "5-6"), (1, 1, 7, 12, "1-1", "7-8"), (1, 2, 13, 19, "1-1", ""), (2, 0, 1, 2, "", "")]


def test_answers_are_taken_or_refused(spark):
    good = {"start_line": 1, "end_line": 2, "category": "Bug", "severity": " HIGH ", "title": "t", "message": "m", "evidence": "e", "confidence": "85%", "cwe": "cwe 0079"}
    bad = {**good, "end_line": 0}
    rows = spark.createDataFrame([(1, json.dumps({"findings": [good, bad, {}]})), (2, '{"findings": {}}'), (3, "none"), (4, None), (5, '{"findings": []}')], "k int, a string")
    got = answers.issues(rows, "k", "a").collect()
    assert sorted((r["k"], r["usable"], r["valid"]) for r in got if r["k"] != 1) == [(2, False, None), (3, False, None), (4, False, None), (5, True, None)]
    mine = [r for r in got if r["k"] == 1]
    assert [r["valid"] for r in sorted(mine, key=lambda r: r["place"])] == [True, False, False]
    assert [(r["confidence"], r["cwe"], r["category"]) for r in mine if r["valid"]] == [(0.85, "CWE-79", "bug")]
    wholes = spark.createDataFrame([(1, '{"verdict": "Valid"}'), (2, '{"verdict": "so-so", "confidence": 300}'), (3, "x")], "k int, a string")
    assert {r["k"]: r["bad_fields"] for r in answers.verifications(wholes, "k", "a").collect()} == {1: "", 2: "confidence, verdict", 3: "answer"}
    long_ = spark.createDataFrame([(1, json.dumps({"headline": "h", "strengths": list("abcde")})), (2, '{"headline": " "}')], "k int, a string")
    assert [(r["k"], r["strengths"], r["top_risks"]) for r in answers.summaries(long_, "k", "a").collect()] == [(1, ["a", "b", "c"], [])]


def test_closed_forms_are_the_folds(spark):
    """Limiter and bucket against call by call recomputation, over days and ties."""
    import datetime as dt
    import random

    r = random.Random(3)
    zero = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)
    rows = [(i, zero + dt.timedelta(seconds=r.choice([0, 0, 1, 40, 90_000]) + i * 7), p, "ok", r.randint(0, 400), "m", "f") for i in range(150) for p in ["p"]]
    calls = spark.createDataFrame(rows, "call_id bigint, called_at timestamp, provider string, status string, input_tokens bigint, model string, file_path string")
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    times = [x[1].timestamp() for x in order]
    slots = dict(zip([x[0] for x in order], routing.slots(times, 4, 60.0)))
    assert all(abs(x["slot"] - slots[x["call_id"]]) < 1e-5 for x in routing.limiter_slots(calls, 4, 60.0).collect())
    level, last, want = 300.0, None, {}
    for x, at in zip(order, times):
        level = min(300.0, level + (at - last) * 1.0) if last is not None else level
        level, last = level - min(300.0, x[4]), at
        want[x[0]] = level
    assert all(abs(x["level"] - want[x["call_id"]]) < 1e-5 for x in routing.token_bucket(calls, 300.0, 1.0).collect())


def test_small_steps(spark):
    scans = spark.createDataFrame([(1, "running"), (2, "done")], "scan_id int, status string")
    assert {(r["scan_id"], r["status"], r["error"]) for r in pipeline.recovered(scans).collect()} == {(1, "failed", "interrupted"), (2, "done", None)}
    names = spark.createDataFrame([("E-x+y+z",), ("A",), ("Q",), ("B-",)], "v string")
    assert {r["v"]: r["run"] for r in names.select("v", pipeline.run_of(F.col("v")).alias("run")).collect()} == {"E-x+y+z": "verify-model-x-by-y+z", "A": "static", "Q": None, "B-": None}
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "file_id int, line_no int, text string")
    hit = spark.createDataFrame([(1, 2), (1, 2), (9, 1)], "file_id int, line_no int")
    assert sorted(r["text"] for r in structure.redact_lines(lines, hit).collect()) == ["[line withheld: possible secret]", "a"]
    assert texts.SEPARATORS
