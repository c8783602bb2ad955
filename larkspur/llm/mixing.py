"""Mixing sources to target weights along a low-discrepancy schedule.

The mixture is a sequence of slots of equal token size. Slot i belongs to the source in whose
stretch of the cumulative weights the point ``frac((i + 1) * golden ratio)`` falls, so every
stretch of the sequence holds each source close to its weight. The k-th slot of a source takes the k-th
block of the source's shuffled texts, laid end to end and repeated as often as allowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.tokens import VOCABULARY, n_tokens
from larkspur.plans.durable import checkpoint, grouped, running_start, small

GOLDEN = 0.6180339887498949
BLOCK = 512
#: Ranges of the shuffle's hash within which rows of one source meet in a task.
PIECES = 4096
#: Slots numbered together in a task.
RUN = 65536
#: Equal stretches of the weights' range within which points look their source up.
CELLS = 4096


def source_name(source: Column) -> Column:
    """Sources without case, outer blanks and the difference of `_` and `-`; null for blank ones."""
    return F.nullif(F.replace(F.lower(F.trim(source)), F.lit("_"), F.lit("-")), F.lit(""))


def stock(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, tokens): one row per distinct text of a source that has a target.

    Exact copies are one text, whatever their ids and sources (else copies would be used more often than allowed);
    the smallest (doc_id, source) keeps it. Null and empty texts have no tokens and are out, as are sources without a target.
    """
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("text is not null and text != '' and source is not null")
    wanted = targets.select(source_name(F.col("doc_source")).alias("source")).filter("source is not null").distinct()
    once = (
        named.join(wanted, "source", "left_semi").groupBy(F.sha2("text", 256).alias("_h"))
        .agg(F.min(F.struct("doc_id", "source", "text")).alias("d"))
    )
    return once.select("d.source", "d.doc_id", n_tokens(F.col("d.text"), vocabulary).alias("tokens"))


def plan(stocked: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK) -> DataFrame:
    """(source, share, max_repeats, low, high, texts, held): the cumulative weights and stock of each target; one row per target.

    Rows of `targets` with a null source or a share that is null or not above 0 are left out; repeated sources are added up
    and shares are scaled to the sum 1. Null max_repeats is 1.
    """
    held = stocked.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("held"))
    goal = (
        targets.select(source_name(F.col("doc_source")).alias("source"), "target_share", "max_repeats")
        .filter("source is not null and target_share > 0").groupBy("source")
        .agg(F.sum("target_share").alias("w"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    )
    every = Window.partitionBy()
    upto = F.sum("w").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("w").over(every)
    return goal.withColumn("share", F.col("w") / whole).withColumn("high", upto / whole).withColumn("low", F.col("high") - F.col("share")).drop("w").join(
        held, "source", "left"
    ).na.fill(0, ["texts", "held"])


def schedule(weights: DataFrame, n_slots: int) -> DataFrame:
    """(slot, source, rank): rank counts the slots of the source from 0 in the order of the sequence.

    A point meets only the sources whose stretch reaches into its cell: an equi-join, whatever the number of sources.
    """
    spark = weights.sparkSession
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spans = weights.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    met = points.withColumn("cell", cell(F.col("u"))).join(small(spans, weights.count() + CELLS), "cell")
    mine = met.filter("u >= low and u < high").select("slot", "source")
    mine = mine.withColumn("run", F.floor(F.col("slot") / RUN)).withColumn("one", F.lit(1))
    return running_start(mine, ["source"], "run", ["slot"], "one", "rank").select("slot", "source", "rank")


def _shuffled(df: DataFrame, *seed: Column) -> DataFrame:
    """Adds a hash `_h` of seed and doc_id to order by, and `_piece`, its top bits as a number that grows with it."""
    df = df.withColumn("_h", F.xxhash64(*seed, "doc_id"))
    return df.withColumn("_piece", F.floor(F.col("_h") / F.lit(2.0**64 / PIECES)).cast("int"))


def _partial(laid: DataFrame, n: int, seed: int) -> DataFrame:
    """The texts of the last, incomplete repeat of each source: those first in the order of a hash whose sum stays within `part` tokens, and what fills the gap."""
    hashed = _shuffled(laid.filter("part > 0"), F.lit(seed), F.lit(-1).cast("long"))
    summed = checkpoint(running_start(hashed, ["source"], "_piece", ["_h", "doc_id"], "tokens", "_before"))
    inside = F.col("_before") + F.col("tokens") <= F.col("part")
    first, others = summed.filter(inside), summed.filter(~inside)
    gaps = others.select("source", "part").distinct().join(first.groupBy("source").agg(F.sum("tokens").alias("_first")), "source", "left")
    gaps = gaps.select("source", (F.col("part") - F.coalesce("_first", F.lit(0))).alias("_gap"))
    return first.unionByName(_filled(others.join(small(gaps, n), "source")).select(first.columns)).drop("_before")


def _filled(others: DataFrame) -> DataFrame:
    """Of the texts not drawn, those that fill the `_gap` their source has left: the largest that fits, by hash among equals, until none fits.

    If the smallest one left ends closer to the part than leaving it out does, it is taken too, so a source is off by half of an unused text at most.
    """
    # more texts of one length than fit, and one, are of no use, so a source meets in one task with few rows; first within pieces, as one length may be half of all rows
    enough = F.floor(F.col("_gap") / F.col("tokens")) + 1
    some = others.filter("_gap > 0 and tokens < 2 * _gap")
    for keys in (["source", "tokens", "_piece"], ["source", "tokens"]):
        some = some.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))).filter(F.col("_place") <= enough).drop("_place")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "_h", "doc_id"], ascending=[False, True, True], ignore_index=True)
        gap, taken, least = int(rows["_gap"].iloc[0]), [], None
        for i, t in enumerate(rows["tokens"].tolist()):
            if t <= gap:
                taken.append(i)
                gap -= t
            else:
                least = i
        if least is not None and int(rows["tokens"].iloc[least]) < 2 * gap:
            taken.append(least)
        return rows.iloc[taken]

    return grouped(some, ["source"], run, some.schema)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (slot, source, doc_id, epoch, tokens) and its weights (see `plan`, with the tokens wanted in all).

    `total_tokens` defaults to the tokens of all distinct texts of the targeted sources. A text belongs to the slot in
    which it begins. A source that cannot
    fill its part even with every repeat allowed fills only its first slots. Texts longer than their source's part cannot be used
    without passing it; the weights count them (`too_long`, `too_long_tokens`).
    """
    stocked = checkpoint(stock(documents, targets, vocabulary))
    weights = plan(stocked, targets)
    if total_tokens is None:
        total_tokens = stocked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    weights = checkpoint(weights.withColumn("wanted", F.round(F.col("share") * F.lit(int(total_tokens))).cast("long")))
    n = weights.count()
    # a text longer than its source's whole part can never be in; what is left counts as the source's stock
    sized = stocked.join(small(weights.select("source", "wanted"), n), "source")
    fits, usable = sized.filter("tokens <= wanted").drop("wanted"), F.col("tokens") <= F.col("wanted")
    stockable = sized.groupBy("source").agg(
        F.count_if(usable).alias("texts"), F.sum(F.when(usable, F.col("tokens")).otherwise(0)).alias("held"), F.count_if(~usable).alias("too_long"), F.sum(F.when(~usable, F.col("tokens")).otherwise(0)).alias("too_long_tokens")
    )
    weights = checkpoint(weights.drop("texts", "held").join(stockable, "source", "left").na.fill(0, ["texts", "held", "too_long", "too_long_tokens"]))
    n_slots = -(-int(total_tokens) // block)
    laid = fits.join(small(weights.select("source", "held", "wanted", "max_repeats"), n), "source").filter("wanted > 0")
    laid = laid.withColumn("full", F.least(F.col("max_repeats").cast("long"), F.floor(F.col("wanted") / F.greatest("held", F.lit(1)))))
    laid = laid.withColumn("part", F.when(F.col("full") < F.col("max_repeats"), F.col("wanted") - F.col("full") * F.col("held")).otherwise(F.lit(0)))
    whole = laid.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    cols = ["source", "doc_id", "tokens", "held", "epoch"]
    used = whole.select(*cols).unionByName(_partial(laid, n, seed).withColumn("epoch", F.col("full")).select(*cols))
    placed = running_start(_shuffled(used, F.lit(seed), F.col("epoch")), ["source", "epoch"], "_piece", ["_h", "doc_id"], "tokens", "_before")
    kept = placed.withColumn("_start", F.col("epoch") * F.col("held") + F.col("_before"))
    blocks = kept.select("source", "doc_id", "epoch", "tokens", F.floor(F.col("_start") / block).alias("rank"))
    slots = schedule(weights, n_slots)
    last = slots.groupBy("source").agg(F.max("rank").alias("last"), F.max("slot").alias("last_slot"))
    # a source's share of slots may be one short of its part: what begins after the last slot goes there
    at = blocks.join(small(last, n), "source", "left").withColumn("rank", F.least("rank", F.coalesce("last", "rank")))
    return at.join(slots, ["source", "rank"], "left").select(F.coalesce("slot", F.lit(n_slots)).alias("slot"), "source", "doc_id", "epoch", "tokens"), weights


def shares(mixture: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, wanted_tokens, reached_tokens, reached_share, share_of_wanted, texts_used, most_repeats, texts_too_long, fell_short), one row per target.

    reached_share is of the mixture's tokens, share_of_wanted of those wanted in all (what sources that fell short leave open is not given to others).
    A source fell short if it holds less than its part even with all repeats, or stays below it by more than 1/128, whatever the cause.
    """
    got = mixture.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k")).groupBy("source").agg(
        F.sum("t").alias("reached_tokens"), F.count(F.lit(1)).alias("texts_used"), F.max("k").alias("most_repeats")
    )
    both = weights.join(got, "source", "left").na.fill(0, ["reached_tokens", "texts_used", "most_repeats"])
    total = F.nullif(F.sum("reached_tokens").over(Window.partitionBy()), F.lit(0))
    return both.select(
        "source", F.round("share", 6).alias("target_share"), F.col("wanted").alias("wanted_tokens"), "reached_tokens",
        F.round(F.col("reached_tokens") / total, 6).alias("reached_share"),
        F.round(F.col("reached_tokens") / F.nullif(F.sum("wanted").over(Window.partitionBy()), F.lit(0)), 6).alias("share_of_wanted"),
        "texts_used", "most_repeats", F.col("too_long").alias("texts_too_long"),
        ((F.col("held") * F.col("max_repeats") < F.col("wanted")) | ((F.col("wanted") - F.col("reached_tokens")) * 128 > F.col("wanted"))).alias("fell_short"),
    )
