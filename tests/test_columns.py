"""Column functions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur import domain as D
from larkspur.functions import columns as C


def one(spark, value, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(value.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"), [("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\rb", ["a\rb"])]
)
def test_split_lines(spark, text, want):
    assert one(spark, C.split_lines(F.lit(text))) == want


def test_shorten_collapses_and_cuts(spark):
    assert one(spark, C.shorten(F.lit("  a \u00a0 b\n"))) == "a b"
    cut = one(spark, C.shorten(F.lit("x" * 100)))
    assert len(cut) == 80 and cut.endswith("…")


@pytest.mark.parametrize(
    ("name", "want"),
    [("a/b.py", None), ("/a", "path_traversal"), ("..\\a", "path_traversal"), ("C:/a", "path_traversal"), ("a/../b", "path_traversal"), ("", "invalid_path"), ("a/con.txt", "invalid_path"), ("a./b", "invalid_path"), ("a/b?", "invalid_path")],
)
def test_path_rejection(spark, name, want):
    assert one(spark, C.path_rejection(F.lit(name))) == want


@pytest.mark.parametrize(
    ("path", "first", "want"),
    [("a/b.PY", "", "python"), ("run", "#!/usr/bin/env -S FOO=1 python3.11 -O", "python"), ("run", "#!/usr/bin/node", "javascript"), ("run", "plain", None), ("a.txt", "#!/usr/bin/python", None)],
)
def test_detect_language(spark, path, first, want):
    assert one(spark, C.detect_language(F.lit(path), F.lit(first))) == want


@pytest.mark.parametrize(("path", "want"), [("tests/a.py", True), ("src/test_a.py", True), ("a/conftest.py", True), ("a/x.spec.ts", True), ("contest/a.py", False)])
def test_is_test_path(spark, path, want):
    assert one(spark, C.is_test_path(F.lit(path))) is want


def _ranges(*pairs):
    return F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in pairs])


def test_merge_ranges_joins_touching_and_is_idempotent(spark):
    merged = C.merge_ranges(_ranges((5, 6), (1, 2), (3, 4), (9, 9)))
    assert [tuple(r) for r in one(spark, merged)] == [(1, 6), (9, 9)]
    assert [tuple(r) for r in one(spark, C.merge_ranges(merged))] == [(1, 6), (9, 9)]


@pytest.mark.parametrize(("b", "want"), [((3, 4), [(1, 2), (5, 9)]), ((1, 9), []), ((20, 30), [(1, 9)]), ((0, 3), [(4, 9)])])
def test_difference(spark, b, want):
    got = one(spark, C.difference(F.lit(1), F.lit(9), F.lit(b[0]), F.lit(b[1])))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(("score", "want"), [(100, "A"), (90, "A"), (89, "B"), (60, "C"), (59, "D"), (0, "E")])
def test_grade(spark, score, want):
    assert one(spark, C.grade(F.lit(score))) == want


@pytest.mark.parametrize(("value", "want"), [("85%", 0.85), ("0.5", 0.5), ("1", 1.0), ("100", 1.0), ("250", 250.0), ("x", None)])
def test_fraction(spark, value, want):
    assert one(spark, C.fraction(F.lit(value))) == want


def test_json_object_prefers_the_fence_and_falls_back_to_braces(spark):
    assert one(spark, F.get_json_object(C.json_object(F.lit('<think>{"a": 9}</think>```json\n{"a": 1}\n```')), "$.a")) == "1"
    assert one(spark, F.get_json_object(C.json_object(F.lit('Sure: {"a": 2} done')), "$.a")) == "2"
    assert one(spark, C.json_object(F.lit("no object"))) is None


def test_reported_never_hides_tools(spark):
    low = F.lit(0.1)
    tool, model = F.array(F.lit("ruff"), F.lit("gemini")), F.array(F.lit("gemini"))
    assert one(spark, C.is_reported(F.lit("open"), tool, low)) is True
    assert one(spark, C.is_reported(F.lit("open"), model, low)) is False
    assert one(spark, C.is_reported(F.lit("rejected"), tool, low)) is False


def test_severity_rank_is_ordered(spark):
    assert [one(spark, D.severity_rank(F.lit(s))) for s in D.SEVERITIES] == [0, 1, 2, 3, 4]


def test_dedent_and_clean_evidence(spark):
    assert one(spark, C.dedent(F.lit("  a\n\n    b"))) == "a\n\n  b"
    assert one(spark, C.clean_evidence(F.lit("  7 | x\n  8 |  y\n"))) == "x\n y"


def test_ancestors_of_a_bare_name_are_none(spark):
    assert one(spark, C.ancestors(F.lit("a.py"))) == []
    assert one(spark, C.ancestors(F.lit("a/b/c.py"))) == ["a", "a/b"]
