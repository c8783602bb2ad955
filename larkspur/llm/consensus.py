"""Consensus of several annotators by triplet moments.

Scores are standardised per annotator and criterion, so steady strictness or mildness drops
out and the mean product of two annotators' scores is their agreement corrected for chance: of scores with equal
margins it is Cohen's kappa with squared distances, 0 for agreement by chance and 1 for full agreement.
If scores depend on a common quality, the agreement of annotators i and j is ``a_i * a_j``
with a = their accuracies, so any triplet solves for each: ``a_i^2 = m_ij * m_ik / m_jk``.
With many annotators a pair shares few items; j and k are therefore two of three random
thirds of all annotators (the mean vote of each third on an item), over several divisions.
Moments need sums per item only: pairs of annotators are never emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITERIA = ("correctness", "usefulness", "clarity")
#: Divisions of the annotators into thirds.
DIVISIONS = 5
#: Standard errors by which an estimate must lie below that of the median annotator to count as unreliable.
ERRORS = 2.0


def ratings(sheet: DataFrame, criteria: Sequence[str] = CRITERIA, low: int = 1, high: int = 5) -> DataFrame:
    """(rater, item, criterion, score): the latest row of a rater and item (largest rating_id on a tie), one row per valid score.

    Blanks around a score are dropped and ``4.0`` is 4; null, blank and other texts, fractions and
    scores off the scale give no row, and neither do rows with a null rater or item.
    """
    rows = sheet.select("rater", "item", "rated_at", "rating_id", *criteria).filter("rater is not null and item is not null")
    latest = rows.groupBy("rater", "item").agg(F.max(F.struct("rated_at", "rating_id", *criteria)).alias("r"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"r.{c}").cast("string").alias("typed")) for c in criteria]))
    value = F.expr("try_cast(trim(p.typed) as double)")
    long = latest.select("rater", "item", pairs.alias("p")).select("rater", "item", "p.criterion", value.alias("score"))
    return long.filter(F.col("score").between(low, high) & (F.col("score") == F.floor("score"))).withColumn("score", F.col("score").cast("int"))


def _third(division: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(division), F.col("rater")), F.lit(3))


def standardised(scores: DataFrame) -> DataFrame:
    """Adds z, the score less the rater's mean in units of their deviation (0 for a rater who gives one score only)."""
    stats = scores.groupBy("rater", "criterion").agg(F.avg("score").alias("_m"), F.stddev_samp("score").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("score") - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))
    return scores.join(stats, ["rater", "criterion"]).withColumn("z", z).drop("_m", "_s")


def accuracies(scores: DataFrame, divisions: int = DIVISIONS) -> DataFrame:
    """(rater, criterion, n_scores, accuracy, standard_error): accuracy is -1..1, null only where no item has votes of both other thirds.

    The standard error is that of the mean agreement with the others over the annotator's items, in units of accuracy; null with one item.
    """
    z = standardised(scores)
    sums = []
    for d in range(divisions):
        for g in range(3):
            mine = F.when(_third(d) == g, F.col("z"))
            sums += [F.sum(mine).alias(f"s{d}{g}"), F.count(mine).alias(f"n{d}{g}")]
    per_item = z.groupBy("item", "criterion").agg(*sums)
    both = z.join(per_item, ["item", "criterion"])

    moments = []
    for d in range(divisions):

        def mean(turn: int, d: int = d) -> Column:
            g = F.pmod(_third(d) + turn, F.lit(3))
            pick = F.coalesce(*[F.when((g == k) & (F.col(f"n{d}{k}") > 0), F.col(f"s{d}{k}") / F.col(f"n{d}{k}")) for k in range(3)])
            return pick

        moments.append(F.struct(mean(1).alias("a"), mean(2).alias("b")))
    long = both.select("rater", "criterion", "z", F.array(*moments).alias("ms"))
    usable = F.filter("ms", lambda m: m["a"].isNotNull() & m["b"].isNotNull())
    total = lambda f: F.aggregate(usable, F.lit(0.0), lambda acc, m: acc + f(m))
    row = long.select(
        "rater", "criterion", F.size(usable).alias("k"), total(lambda m: F.col("z") * m["a"]).alias("ra"),
        total(lambda m: F.col("z") * m["b"]).alias("rb"), total(lambda m: m["a"] * m["b"]).alias("ab"),
    )
    solved = row.groupBy("rater", "criterion").agg(
        F.count(F.lit(1)).alias("n_scores"), F.sum("k").alias("k"), F.sum("ra").alias("ra"), F.sum("rb").alias("rb"), F.sum("ab").alias("ab"),
        F.count_if(F.col("k") > 0).alias("n"), F.stddev_samp(F.when(F.col("k") > 0, (F.col("ra") + F.col("rb")) / (2 * F.col("k")))).alias("spread"),
    )
    k = F.nullif(F.col("k"), F.lit(0))
    size = F.sqrt(F.abs(F.col("ra") * F.col("rb"))) / k
    common = F.sqrt(F.greatest(F.col("ab") / k, F.lit(1e-6)))
    signed = F.signum(F.col("ra") + F.col("rb")) * size / common
    return solved.select(
        "rater", "criterion", "n_scores", F.when(k.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), signed))).alias("accuracy"), (F.col("spread") / F.sqrt(F.col("n").cast("double")) / common).alias("standard_error")
    )


def unreliable(sheet: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(rater, criterion) whose scores do not follow the items' quality or run against it.

    These are nearer to answering by chance (0) than to the median annotator of the criterion, and below the latter by more than `errors` standard
    errors, so an annotator with few items is not called unreliable for bad luck.
    """
    acc = accuracies(ratings(sheet)).filter("accuracy is not null")
    usual = acc.groupBy("criterion").agg(F.percentile_approx("accuracy", 0.5, 10_000).alias("usual"))  # one row per criterion
    below = (F.col("accuracy") < F.col("usual") / 2) & (F.col("accuracy") + errors * F.coalesce("standard_error", F.lit(1.0)) < F.col("usual"))
    return acc.join(F.broadcast(usual), "criterion").filter(below).select("rater", "criterion")


def consensus(sheet: DataFrame) -> DataFrame:
    """(item, criterion, score, support, n_votes): the level with the largest sum of log-odds weights.

    A vote is the rater's standardised score put back on the scale of all raters (turned round for
    raters who answer backwards); its weight is ln((1 + |a|) / (1 - |a|)) of the accuracy a. Raters
    without an estimate, or |a| under 0.2, count with the least weight, so every rated item
    gets a score. Equal sums are decided for the level nearest the weighted mean, then the lower.
    """
    scores = ratings(sheet)
    acc = accuracies(scores)
    scale = scores.groupBy("criterion").agg(F.avg("score").alias("mu"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"))
    a = F.coalesce("accuracy", F.lit(0.0))
    size = F.least(F.abs(a), F.lit(0.99))
    weight = F.when(size < 0.2, F.lit(0.01)).otherwise(F.log((1 + size) / (1 - size)))
    level = F.greatest(F.lit(1), F.least(F.lit(5), F.round(F.col("mu") + F.col("sd") * F.col("z") * F.when(a < 0, -1).otherwise(1)))).cast("int")
    votes = (
        standardised(scores).join(acc.select("rater", "criterion", "accuracy"), ["rater", "criterion"]).join(F.broadcast(scale), "criterion")
        .select("item", "criterion", level.alias("level"), weight.alias("w"))
    )
    levels = votes.groupBy("item", "criterion", "level").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    item = Window.partitionBy("item", "criterion")
    mean = F.sum(F.col("w") * F.col("level")).over(item) / F.sum("w").over(item)
    return (
        levels.withColumn("_far", F.abs(F.col("level") - mean)).groupBy("item", "criterion")
        .agg(F.min(F.struct((-F.round("w", 9)).alias("w"), "_far", "level")).alias("b"), F.sum("w").alias("all"), F.sum("n").alias("n_votes"))
        .select("item", "criterion", F.col("b.level").alias("score"), (-F.col("b.w") / F.col("all")).alias("support"), "n_votes")
    )


def agreement(sheet: DataFrame) -> DataFrame:
    """(criterion, n_items, n_scores, alpha): Krippendorff's alpha with squared distances, from sums per item.

    Items with one score have no pair and are left out; alpha is null with under two pairable scores
    and 1 if all of them are equal.
    """
    scores = ratings(sheet).withColumn("x", F.col("score").cast("double"))
    items = scores.groupBy("item", "criterion").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    paired = items.filter("n > 1")
    total = paired.groupBy("criterion").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"),
        F.sum(2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") - 1)).alias("seen"),
    )
    chance = 2 * (F.col("N") * F.col("Q") - F.col("S") * F.col("S")) / F.nullif(F.col("N") - 1, F.lit(0))
    alpha = F.when(chance == 0, F.lit(1.0)).otherwise(1 - F.col("seen") / chance)
    return total.select("criterion", "n_items", F.col("N").alias("n_scores"), F.round(alpha, 9).alias("alpha"))
