"""Validation of scores against truth: correlations, pairwise accuracy, detection, calibration fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stats import correlation


def with_rank(df: DataFrame, x: str, name: str, *keys: str) -> DataFrame:
    """``name``: the rank of ``x`` within ``keys``, the mean rank for ties.

    Ranks come from counts of distinct values, so a long column is aggregated before it is ordered."""
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*keys).orderBy(x)
    ranks = counts.withColumn(name, F.sum("c_").over(w) - (F.col("c_") - 1) / 2.0).drop("c_")
    return df.join(ranks, [*keys, x])


def correlations(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """``keys, srcc, plcc, n``."""
    ranked = with_rank(with_rank(df, x, "rx_", *keys), y, "ry_", *keys)
    return ranked.groupBy(*keys).agg(correlation(F.col("rx_"), F.col("ry_")).alias("srcc"), correlation(F.col(x), F.col(y)).alias("plcc"), F.count("*").alias("n"))


def pairwise_accuracy(df: DataFrame, id: str, score: str, quality: str, *keys: str) -> DataFrame:
    """``keys, pairs, accuracy``: of the pairs with different quality, the share that the score orders alike (ties are wrong).

    No pairs are made: rows are counted by quality and score, and for each quality a running count over the scores tells how many
    rows of lower quality score less. That is a row for each pair of a distinct (quality, score) and a lower quality."""
    rows = df.where(F.col(score).isNotNull() & F.col(quality).isNotNull()).groupBy(*keys, F.col(quality).alias("q_"), F.col(score).alias("s_")).agg(F.count("*").alias("c_"))
    levels = rows.groupBy(*keys, "q_").agg(F.sum("c_").alias("n_"))
    higher = levels.withColumnRenamed("q_", "high_").select(*keys, "high_")
    # Each quality's race against a higher one: both sides' rows by score, the lower side counted as it goes by.
    low = rows.join(higher, list(keys)).where("q_ < high_").select(*keys, F.col("q_").alias("low_"), "high_", "s_", F.lit(0).alias("side_"), "c_")
    lower = levels.select(*keys, F.col("q_").alias("low_"))
    high = rows.join(lower, list(keys)).where("low_ < q_").select(*keys, "low_", F.col("q_").alias("high_"), "s_", F.lit(1).alias("side_"), "c_")
    # Of equal scores the higher side's come first, so ties don't count.
    w = Window.partitionBy(*keys, "low_", "high_").orderBy("s_", F.desc("side_")).rowsBetween(Window.unboundedPreceding, -1)
    seen = low.unionByName(high).withColumn("below_", F.sum(F.when(F.col("side_") == 0, F.col("c_"))).over(w))
    right = seen.where("side_ = 1").groupBy(*keys).agg(F.sum(F.col("c_") * F.coalesce("below_", F.lit(0))).alias("right_"))
    total = levels.groupBy(*keys).agg(((F.sum("n_") * F.sum("n_") - F.sum(F.col("n_") * F.col("n_"))) / 2).cast("long").alias("pairs")).where("pairs > 0")
    return total.join(right, list(keys), "left").select(*keys, "pairs", (F.coalesce("right_", F.lit(0)) / F.col("pairs")).alias("accuracy"))


def detection(df: DataFrame, predicted: str, actual: str, *keys: str) -> DataFrame:
    """``keys, tp, fp, fn, precision, recall, f1`` of boolean columns; nulls where nothing can be measured."""
    p, a = F.col(predicted), F.col(actual)
    c = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    c = c.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def colour_fit(df: DataFrame, source: str, candidate: str, *keys: str) -> DataFrame:
    """``keys, gain, offset, residual``: candidate = gain x source + offset, gain within 0.5 to 2, offset within 64 either way."""
    fit = df.groupBy(*keys).agg(F.regr_slope(candidate, source).alias("g"), F.regr_intercept(candidate, source).alias("o"))
    fit = fit.select(*keys, F.greatest(F.lit(0.5), F.least(F.lit(2.0), "g")).alias("gain"), F.greatest(F.lit(-64.0), F.least(F.lit(64.0), "o")).alias("offset"))
    residual = F.abs(F.col(candidate) - (F.col("gain") * F.col(source) + F.col("offset")))
    return df.join(fit, list(keys)).groupBy(*keys, "gain", "offset").agg(F.avg(residual).alias("residual"))
