"""One surviving record per issue, built from consistent bundles.

Fields that depend on each other travel together: a bundle is taken whole from one record.
Branch and bound chooses one candidate per bundle so that the total trust is largest while
bundles joined by a functional dependency agree (the message's category is the category
shown, the evidence starts at the line shown).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines by which the records of one issue may differ.
REACH = 2
#: Bundle -> (fields, attribute that must agree, bundle it must agree with or None). The first one leads.
BUNDLES = {
    "lead": (("message", "title", "rationale", "ai_note", "status"), "category", None),
    "label": (("category", "severity", "cwe", "rule_id"), "category", "lead"),
    "place": (("start_line", "end_line", "start_column", "end_column"), "start_line", None),
    "proof": (("evidence", "suggestion"), "start_line", "place"),
}
KEYS = ("repository", "file_path", "issue_key")


def usable_message(message: Column) -> Column:
    """Not null, 5 characters or more without outer blanks, and not cut short by an ellipsis."""
    m = F.trim(F.regexp_replace(message, r"(?U)^\s+|\s+$", ""))
    return F.coalesce((F.length(m) >= 5) & ~m.endswith("...") & ~m.endswith("…"), F.lit(False))


def unit_confidence(confidence: Column) -> Column:
    """Confidence from 0 to 1; values above 1 are percentages, NaN is null."""
    c = F.when(~F.isnan(confidence), confidence.cast("double"))
    return F.when(c > 1, c / 100).otherwise(c)


def clean_sources(sources: Column) -> Column:
    """Distinct source names without case, outer blanks, blanks and nulls, in order of name."""
    names = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda s: s.isNotNull() & (s != ""))))


def _filled(fields: tuple[str, ...]) -> Column:
    return sum((F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1).otherwise(0) for f in fields), F.lit(0))


def candidates(findings: DataFrame) -> DataFrame:
    """Per issue: first_id, n_records, sources and the best candidates of each bundle.

    Records: the latest loaded_at per finding_id. Candidates are the best record per bundle, category
    and line, found with partial aggregation, so a group of any size reaches a task as a few rows.
    Rows with a null id, repository, path, key or line belong to no issue.
    """
    needed = [f for fields, *_ in BUNDLES.values() for f in fields]
    wanted = list(dict.fromkeys(["loaded_at", "finding_id", *KEYS, "sources", "verified_by", "confidence", "reported_at", *needed]))
    keyed = findings.select(*wanted).filter(" and ".join(f"{c} is not null" for c in ("finding_id", *KEYS, "start_line")))
    # equal loading times: the larger record, field by field, so the choice is repeatable
    latest = keyed.groupBy("finding_id").agg(F.max(F.struct("loaded_at", *[c for c in wanted if c not in ("loaded_at", "finding_id")])).alias("r"))
    rows = latest.select("finding_id", "r.*")
    rows = rows.withColumns({
        "confidence": unit_confidence(F.col("confidence")), "_names": clean_sources(F.col("sources")), "_ok": usable_message(F.col("message")), "_verifiers": clean_sources(F.col("verified_by")),
    })
    rank = {
        "lead": (F.col("_ok"), F.size("_names"), F.coalesce("confidence", F.lit(-1.0)), F.coalesce("reported_at", F.lit("0001-01-01").cast("timestamp_ntz")), -F.col("finding_id")),
    }
    best = []
    for name, (fields, attribute, _) in BUNDLES.items():
        trust = rank.get(name, (_filled(fields), F.size("_names"), F.coalesce("confidence", F.lit(-1.0)), F.lit(None).cast("timestamp_ntz"), -F.col("finding_id")))
        order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)])
        record = F.to_json(F.struct(*fields))
        best.append(F.max(F.struct(order.alias("trust"), F.col("finding_id").alias("id"), record.alias("record"))).alias(name))
    lines = rows.groupBy(*KEYS, "start_line", "category").agg(
        F.min("finding_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.collect_set("_names").alias("_names"), F.collect_set("_verifiers").alias("_verifiers"), F.max("confidence").alias("confidence"), F.max("reported_at").alias("reported_at"), *best
    )
    order = Window.partitionBy(*KEYS).orderBy("start_line")
    before = F.max("start_line").over(order.rangeBetween(Window.unboundedPreceding, -1))
    starts = lines.withColumn("_new", F.when(before.isNull() | (F.col("start_line") - before > REACH), F.col("start_line")))
    issues = starts.withColumn("_issue", F.max("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    entry = lambda name: F.collect_list(F.struct(F.col(f"{name}.trust").alias("trust"), F.col(f"{name}.id").alias("id"), F.coalesce(F.col(BUNDLES[name][1]).cast("string"), F.lit("")).alias("agrees"), F.col(f"{name}.record").alias("record"))).alias(name)  # noqa: E731, E501
    return issues.groupBy(*KEYS, "_issue").agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("n_records"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("_names"))))).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("_verifiers"))))).alias("verified_by"),
        F.max("confidence").alias("confidence"), F.max("reported_at").alias("reported_at"), *[entry(b) for b in BUNDLES],
    ).filter("n_records > 1").drop("_issue")


def choose(bundles: list[list[tuple[float, str]]], partner: list[int]) -> list[int]:
    """Indices of one candidate (trust, agrees) per bundle, of the largest total trust; earlier candidates on a tie.

    `partner[i]` is an earlier bundle that bundle i must agree with, or -1. If nothing of a bundle
    agrees it is left out (-1, trust 0), so there is always an answer.
    """
    room = [max((t for t, _ in b), default=0.0) for b in bundles]
    rest = [sum(room[i:]) for i in range(len(bundles) + 1)]
    best: tuple[float, list[int]] = (-1.0, [])
    order = [sorted(range(len(b)), key=lambda j, b=b: (-b[j][0], j)) for b in bundles]

    def extend(i: int, total: float, taken: list[int]) -> None:
        nonlocal best
        if total + rest[i] <= best[0]:
            return
        if i == len(bundles):
            best = (total, taken)
            return
        p = partner[i]
        need = bundles[p][taken[p]][1] if p >= 0 and taken[p] >= 0 else None
        for j in order[i]:
            if need is None or bundles[i][j][1] == need:
                extend(i + 1, total + bundles[i][j][0], [*taken, j])
        extend(i + 1, total, [*taken, -1])

    extend(0, 0.0, [])
    return best[1]


def survivors(findings: DataFrame) -> DataFrame:
    """(repository, file_path, issue_key, first_id, best_id, n_records, sources, verified_by, confidence, reported_at, and per bundle its record as JSON and the id it is from).

    Fields that depend on no other hold the best that any record offers: all sources and verifiers, the highest confidence, the latest report.

    Trust of the lead, the record as a whole: usable message, distinct sources, confidence, later report, smaller id. It
    outweighs every other bundle, so best_id is the first of the issue's records in that order; other bundles
    are trusted by filled fields, sources and confidence. An empty input gives no rows.
    """
    names = list(BUNDLES)
    index = {n: i for i, n in enumerate(names)}
    partner = [index[BUNDLES[n][2]] if BUNDLES[n][2] else -1 for n in names]
    issues = candidates(findings)
    out = "repository string, file_path string, issue_key string, first_id bigint, best_id bigint, n_records bigint, sources array<string>, verified_by array<string>, confidence double, reported_at timestamp_ntz, " + ", ".join(
        f"{n}_from bigint, {n}_record string" for n in names
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                lists = []
                for i, n in enumerate(names):
                    found = sorted(getattr(r, n), key=lambda c: tuple(_plain(v) for v in c["trust"].values()), reverse=True)
                    lists.append(found)
                weighed = [[((1000.0 if i == 0 else 1.0) * (len(c) - j), e["agrees"]) for j, e in enumerate(c)] for i, c in enumerate(lists)]
                taken = choose(weighed, partner)
                chosen = [lists[i][j] if j >= 0 else None for i, j in enumerate(taken)]
                row = [r.repository, r.file_path, r.issue_key, r.first_id, chosen[0]["id"], r.n_records, list(r.sources), list(r.verified_by), r.confidence, r.reported_at]
                for c in chosen:
                    row += [c["id"] if c else None, c["record"] if c else None]
                rows.append(row)
            frame = pd.DataFrame(rows, columns=[p.split()[0] for p in out.split(", ")])
            frame = frame.astype({"confidence": "float64", "reported_at": "datetime64[us]"})
            for n in names:
                frame[f"{n}_from"] = frame[f"{n}_from"].astype("Int64")
            yield frame

    return issues.mapInPandas(run, out)


def _plain(value: object) -> object:
    """Sort key of one part of a trust; nulls first, as Spark compares structs."""
    return (value is not None and value == value, value if value is not None and value == value else 0)
