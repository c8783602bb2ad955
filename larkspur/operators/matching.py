"""Findings against labels: range joins, one-to-one matching and scores; merging of model findings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import columns as C
from larkspur.plans.durable import checkpoint, grouped

FILE = ("repository", "file_path")
#: Lines by which a prediction may miss a label (a fixed value), and lines per cell of the bucketed join.
SLACK, CELL = 2, 64


def _category(c: Column) -> Column:
    """typing counts as bug."""
    return F.when(c == "typing", "bug").otherwise(c)


def label_matches(predictions: DataFrame, labels: DataFrame, by_category: bool = True) -> DataFrame:
    """(finding_id, label_id) pairs on one file whose lines overlap within the slack.

    Both sides are cut into cells of lines, so a file with very many findings spreads over many tasks;
    each pair is taken in the first cell that both have.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / CELL), F.floor(F.greatest(s, e) / CELL)))
    p = predictions.select("finding_id", *FILE, F.col("start_line").alias("ps"), F.coalesce("end_line", "start_line").alias("pe"), _category(F.col("category")).alias("pc")).filter("ps is not null")
    p = p.withColumn("cell", cells(F.col("ps") - SLACK, F.col("pe") + SLACK))
    q = labels.select("label_id", *FILE, F.col("start_line").alias("ls"), F.col("end_line").alias("le"), _category(F.col("category")).alias("lc")).withColumn("cell", cells(F.col("ls"), F.col("le")))
    both = p.join(q, [*FILE, "cell"]).filter(C.overlaps(F.col("ps"), F.col("pe"), F.col("ls"), F.col("le"), SLACK))
    both = both.filter(F.col("cell") == F.floor(F.greatest(F.col("ps") - SLACK, F.col("ls")) / CELL))
    return (both.filter("pc = lc") if by_category else both).select("finding_id", "label_id", *FILE)


def correct_predictions(predictions: DataFrame, labels: DataFrame, by_category: bool = True) -> DataFrame:
    """Predictions with a matching label."""
    return predictions.join(label_matches(predictions, labels, by_category).select("finding_id"), "finding_id", "left_semi")


def found_labels(predictions: DataFrame, labels: DataFrame, by_category: bool = True) -> DataFrame:
    """(label_id, finding_id): a maximum one-to-one matching, labels in the order of their id, per file.

    Edges never leave a file, so each file is matched on its own by augmenting paths over its edges alone.
    """
    return matched(label_matches(predictions, labels, by_category))


def matched(edges: DataFrame) -> DataFrame:
    """The maximum matching of (finding_id, label_id, file) edges."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        adjacent = {k: sorted(set(g)) for k, g in batch.groupby("label_id")["finding_id"]}
        taken: dict[int, str] = {}

        def augment(label: str, seen: set[int]) -> bool:
            for f in adjacent[label]:
                if f not in seen:
                    seen.add(f)
                    if f not in taken or augment(taken[f], seen):
                        taken[f] = label
                        return True
            return False

        for label in sorted(adjacent):
            augment(label, set())
        return pd.DataFrame({"label_id": list(taken.values()), "finding_id": list(taken)}, columns=["label_id", "finding_id"])

    return grouped(edges, list(FILE), run, "label_id string, finding_id bigint")


def counts(matched: Column, predicted: Column, correct: Column, labels: Column) -> list[Column]:
    """Precision, recall and F1: null where undefined, F1 0 where both are 0."""
    precision = F.try_divide(correct, predicted)
    recall = F.try_divide(matched, labels)
    f1 = F.when(precision.isNull() | recall.isNull(), F.lit(None)).when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return [F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1.cast("double"), 6).alias("f1")]


def scorecard(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(category, n_predicted, n_correct, n_labels, n_found, precision, recall, f1), matched within each category."""
    cat = _category(F.col("category")).alias("category")
    predicted = predictions.groupBy(cat).agg(F.count(F.lit(1)).alias("n_predicted"))
    edges = checkpoint(label_matches(predictions, labels))
    right = predictions.join(edges.select("finding_id"), "finding_id", "left_semi").groupBy(cat).agg(F.count(F.lit(1)).alias("n_correct"))
    wanted = labels.groupBy(cat).agg(F.count(F.lit(1)).alias("n_labels"))
    hit = labels.join(matched(edges).select("label_id"), "label_id", "left_semi").groupBy(cat).agg(F.count(F.lit(1)).alias("n_found"))
    rows = predicted.join(right, "category", "full").join(wanted, "category", "full").join(hit, "category", "full").na.fill(0, ["n_predicted", "n_correct", "n_labels", "n_found"])
    return rows.select("category", "n_predicted", "n_correct", "n_labels", "n_found", *counts(F.col("n_found"), F.col("n_predicted"), F.col("n_correct"), F.col("n_labels")))


def findings_in_chunks(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(chunk_id, finding_id, sev_rank, start_line): findings that start in a chunk's body, formatting ones left out."""
    f = findings.filter(~C.is_formatting_only(F.col("sources"), F.col("rule_id"))).select("finding_id", *FILE, F.col("start_line").alias("at"), "sev_rank", "category", "severity", "title", "message")
    c = chunks.filter("start_line is not null").select("chunk_id", *FILE, "chunk_index", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    # a chunk is in every cell of lines that it touches, a finding in one: a file with very many of both spreads over many tasks
    c = c.withColumn("cell", F.explode(F.sequence(F.floor(F.col("cs") / CELL), F.floor(F.greatest("cs", "ce") / CELL))))
    return c.join(f.filter("at is not null").withColumn("cell", F.floor(F.col("at") / CELL)), [*FILE, "cell"]).filter("at between cs and ce").drop("cell").withColumnRenamed("at", "start_line")


def first_static_target(model_findings: DataFrame, static: DataFrame) -> DataFrame:
    """(finding_id, target_id): the first tool finding, in canonical order, of one file and category that a model's finding overlaps."""
    s = static.select(*FILE, "category", F.col("start_line").alias("s1"), F.coalesce("end_line", "start_line").alias("e1"), F.col("finding_id").alias("target_id"), F.struct(-F.col("sev_rank"), "start_line", F.coalesce("rule_id", F.lit("")), "ord").alias("place"))
    m = model_findings.select("finding_id", *FILE, "category", F.col("start_line").alias("s2"), F.coalesce("end_line", "start_line").alias("e2"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.greatest(a, b) / CELL)))
    s, m = s.filter("s1 is not null").withColumn("cell", cells("s1", "e1")), m.filter("s2 is not null").withColumn("cell", cells("s2", "e2"))
    hits = m.join(s, [*FILE, "category", "cell"]).filter(C.overlaps(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")))
    return hits.groupBy("finding_id").agg(F.min_by("target_id", "place").alias("target_id"))


def leader_clusters(findings: DataFrame) -> DataFrame:
    """(finding_id, leader_id): findings fold, in order, into the first earlier leader of one file and category that they overlap.

    The fold is sequential per (file, category); its state is the leaders of that key alone, rows stream through in order.
    """
    rows = findings.select("finding_id", *FILE, "category", "start_line", F.coalesce("end_line", "start_line").alias("end_line")).filter("start_line is not null")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[int, int, int]] = []
        out = []
        for r in group.sort_values("finding_id").itertuples(index=False):
            lead = next((k for k, s, e in leaders if s <= r.end_line and r.start_line <= e), None)
            if lead is None:
                leaders.append((r.finding_id, r.start_line, r.end_line))
                lead = r.finding_id
            out.append((r.finding_id, lead))
        return pd.DataFrame(out, columns=["finding_id", "leader_id"])

    return grouped(rows, [*FILE, "category"], run, "finding_id bigint, leader_id bigint")


def review_plan(chunks: DataFrame, findings: DataFrame, budget: int = 60) -> DataFrame:
    """(chunk_id, risk, place, task): the riskiest chunks per repository within a budget of calls; what is left of it goes to style over the same order."""
    from pyspark.sql import Window

    risk = findings_in_chunks(chunks, findings).groupBy("chunk_id").agg(F.sum(F.col("sev_rank") + 1).alias("risk"))
    rows = chunks.select("chunk_id", *FILE, "chunk_index").join(risk, "chunk_id", "left").na.fill(0, ["risk"])
    w = Window.partitionBy("repository").orderBy(F.desc("risk"), "file_path", "chunk_index", "chunk_id")
    placed = rows.withColumn("place", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("repository")))
    placed = placed.filter(F.col("place") <= budget)
    review = placed.select("repository", "chunk_id", "risk", "place", F.lit("review").alias("task"))
    style = placed.filter(F.col("place") <= budget - F.least(F.col("n"), F.lit(budget))).select("repository", "chunk_id", "risk", "place", F.lit("style").alias("task"))
    return review.unionByName(style)


def numbered_for_review(chunks: DataFrame, findings: DataFrame, most: int = 40) -> DataFrame:
    """(chunk_id, static_id, finding_id): findings shown per chunk as S1, S2, ... from the gravest, at most `most`."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy(F.desc("sev_rank"), "start_line", "finding_id")
    rows = findings_in_chunks(chunks, findings).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    return rows.select("chunk_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("static_id"), "finding_id")
