"""Reports, plug-ins and the entry points."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
from larkspur.functions import columns as C
from larkspur.operators import reports
from larkspur.plans import durable
from larkspur.sources import plugins


def one(spark, value):
    return spark.range(1).select(value.alias("x")).first()["x"]


def test_embed_replaces_named_blocks_only():
    doc = "a <!-- begin t -->old<!-- end t --> b"
    assert reports.embed(doc, {"t": "new"}) == "a <!-- begin t -->\nnew\n<!-- end t --> b"
    with pytest.raises(KeyError):
        reports.embed(doc, {})


def test_html_escapes(spark):
    assert "&lt;b&gt;" in reports.html_table(spark.createDataFrame([("<b>",)], "x string"), "t")


def test_a_failing_analyser_is_a_finding(spark):
    class Broken:
        name, extensions = "broken", (".py",)

        def analyse(self, text):
            raise RuntimeError("no")

    files = spark.createDataFrame([("r", "a.py", "# TODO x\ny"), ("r", "a.txt", "# TODO"), ("r", "b.py", None)], "repository string, file_path string, content string")
    got = sorted((r["tool"], r["rule_id"], r["start_line"]) for r in plugins.run_analysers(files, plugins.TodoComments(), Broken()).collect())
    assert got == [("broken", "failed", 1), ("todo", "todo", 1)]


@pytest.mark.parametrize(("value", "want"), [("12", 12.0), ("-3", 0.0), ("Mon, 01 Jan 2024 00:01:00 GMT", 60.0), ("soon", None)])
def test_retry_after(spark, value, want):
    assert one(spark, C.retry_after(F.lit(value), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))) == want


@pytest.mark.parametrize(
    ("evidence", "first", "last", "want"),
    [("  2 | b = 1", 2, 2, None), ("zzz", 2, 2, "not_found"), ("ab", 2, 2, "no_evidence"), ("b = 1", 2, 9, "past_end"), ("b   =  1\nc = 2", 2, 3, None)],
)
def test_grounding(spark, evidence, first, last, want):
    lines = F.array(*[F.lit(s) for s in ("a = 0", "b = 1", "c = 2", "d = 3")])
    assert one(spark, C.ungrounded(lines, F.lit(first), F.lit(last), F.lit(1), F.lit(4), F.lit(evidence))) == want


def test_salted_ranks_number_every_key_from_zero(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    rows = durable.salted_rank(df, ["k"], ["id"], "r", salts=8).collect()
    for k in range(3):
        mine = sorted(r["r"] for r in rows if r["k"] == k)
        assert mine == list(range(len(mine)))


def test_running_start_is_a_prefix_sum(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).alias("w"), F.floor(F.col("id") / 10).alias("p"))
    rows = sorted(durable.running_start(df, ["k"], "p", ["id"], "w", "s").collect(), key=lambda r: r["id"])
    total = {0: 0, 1: 0}
    for r in rows:
        assert r["s"] == total[r["k"]]
        total[r["k"]] += r["w"]


def test_grouped_passes_whole_groups(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 9).cast("string").alias("k"), "id").withColumn("k", F.when(F.col("k") != "4", F.col("k")))
        fold = lambda g: pd.DataFrame([(g["k"].iloc[0], len(g), int(g["id"].sum()))], columns=["k", "n", "s"])
        out = durable.grouped(df, ["k"], fold, "k string, n bigint, s bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 9 and sum(r["n"] for r in out) == 100 and sum(r["s"] for r in out) == 4950


def test_names_and_twins_agree():
    names, twins = set(entries.queries()), set(entries.oracle_sql())
    assert twins <= names and len(twins) > 60
