"""Agreement of raters: means, kappas and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rating_means(ratings: DataFrame) -> DataFrame:
    """Per criterion: mean and sample deviation (0 for one score) and the number of items."""
    return ratings.groupBy("criterion").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("deviation"), F.count_distinct("item").alias("n_items"), F.count(F.lit(1)).alias("n")
    )


def cohen_kappa(ratings: DataFrame, quadratic: bool = True, least_items: int = 2) -> DataFrame:
    """(first, second, criterion, n, kappa) of raters that share items: 1 less weighted disagreement over that expected from both raters' shares.

    Only cells of 5 x 5 counts per pair of raters are kept, by a join on item and partial sums; an item has few raters. Kappa is 1 if
    no disagreement is expected.
    """
    a = ratings.select("item", "criterion", F.col("rater").alias("first"), F.col("score").alias("x"))
    b = ratings.select("item", "criterion", F.col("rater").alias("second"), F.col("score").alias("y"))
    cells = a.join(b, ["item", "criterion"]).filter("first < second").groupBy("first", "second", "criterion", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    pair = ["first", "second", "criterion"]
    weight = F.pow(F.col("x") - F.col("y"), 2) / 16.0 if quadratic else (F.col("x") != F.col("y")).cast("double")
    # the sum over all cells of weight x row x column, from the rater's moments: sum (x - y)^2 = n(qx + qy) - 2 sx sy for quadratic weights
    sums = cells.groupBy(*pair).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * weight).alias("seen"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("y")).alias("sy"),
        F.sum(F.col("n") * F.col("x") * F.col("x")).alias("qx"), F.sum(F.col("n") * F.col("y") * F.col("y")).alias("qy"),
        *[F.sum(F.when(F.col("x") == k, F.col("n")).otherwise(0)).alias(f"x{k}") for k in range(1, 6)], *[F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)).alias(f"y{k}") for k in range(1, 6)],
    ).filter(F.col("n") >= least_items)
    if quadratic:
        expected = (F.col("n") * (F.col("qx") + F.col("qy")) - 2 * F.col("sx") * F.col("sy")) / 16.0 / F.col("n")
    else:
        expected = F.col("n") - sum(F.col(f"x{k}") * F.col(f"y{k}") for k in range(1, 6)) / F.col("n")
    kappa = F.when(expected == 0, 1.0).otherwise(1 - F.col("seen") / F.nullif(expected, F.lit(0.0)))
    return sums.select(*pair, "n", F.round(kappa, 6).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, raters: int = 7) -> DataFrame:
    """(criterion, n_items, kappa) over items with exactly so many raters; 1 if no disagreement is to be expected."""
    return fleiss_by_raters(ratings).filter(F.col("n_raters") == raters).drop("n_raters")


def fleiss_by_raters(ratings: DataFrame) -> DataFrame:
    """(criterion, n_raters, n_items, kappa): Fleiss' kappa over the items of each number of raters from 2, as it is defined for a fixed number."""
    per = ratings.groupBy("criterion", "item", "score").agg(F.count(F.lit(1)).alias("k"))
    items = per.groupBy("criterion", "item").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"), *[F.sum(F.when(F.col("score") == s, F.col("k")).otherwise(0)).alias(f"s{s}") for s in range(1, 6)]).filter(F.col("n") >= 2)
    total = items.groupBy("criterion", F.col("n").alias("n_raters")).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))).alias("seen"), *[F.avg(F.col(f"s{s}") / F.col("n").cast("double")).alias(f"p{s}") for s in range(1, 6)]
    )
    chance = sum(F.col(f"p{s}") * F.col(f"p{s}") for s in range(1, 6))
    return total.select("criterion", "n_raters", "n_items", F.round(F.when(chance == 1, 1.0).otherwise((F.col("seen") - chance) / (1 - chance)), 6).alias("kappa"))


def stratified_sample(findings: DataFrame, by: str = "repository", k: int = 3, seed: str = "7") -> DataFrame:
    """k findings with a suggestion per group, by a digest of seed and id: the same at any partitioning."""
    digest = F.md5(F.concat(F.lit(seed), F.col("finding_id").cast("string")))
    w = Window.partitionBy(by).orderBy("digest", "finding_id")
    return findings.filter("suggestion is not null").withColumn("digest", digest).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(by, "place", "finding_id")
