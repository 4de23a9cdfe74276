"""Time-series operators over frame series (``stream, k, t, x``): differences, parity, robust z, risk, cuts.

Everything is one window pass for each stream, partitioned by stream; streams are the unit of parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from ..functions.stats import EPS, MAD_SCALE, alternation, parity_mean_gap


def _w() -> WindowSpec:
    return Window.partitionBy("stream").orderBy("k")


def lag_stats(s: DataFrame) -> DataFrame:
    """Differences to the frame before; 0 for the first frame."""
    d = F.col("x") - F.lag("x").over(_w())
    return s.select("stream", "k", "x", F.coalesce(d, F.lit(0.0)).alias("dx"), F.coalesce(F.abs(d), F.lit(0.0)).alias("abs_dx"), F.coalesce(F.col("t") - F.lag("t").over(_w()), F.lit(0.0)).alias("dt"))


def _signed(s: DataFrame) -> DataFrame:
    """The frame's distance from the mean of its neighbours, with the sign of its parity; 0 at the ends."""
    mid = F.col("x") - 0.5 * (F.lag("x").over(_w()) + F.lead("x").over(_w()))
    return s.withColumn("g", F.coalesce(F.when(F.col("k") % 2 == 0, mid).otherwise(-mid), F.lit(0.0)))


def parity_gap(s: DataFrame) -> DataFrame:
    return _signed(s).select("stream", "k", F.abs(F.sum("g").over(_w().rowsBetween(-4, 4)) / 9).alias("gap"))


def components(s: DataFrame) -> DataFrame:
    """The raw risk components of every frame."""
    dip = F.sum("x").over(_w().rowsBetween(-2, 2)) / 5 - F.col("x")
    flash = F.abs(F.lead("x").over(_w()) - 2 * F.col("x") + F.lag("x").over(_w()))
    step = F.coalesce(F.abs(F.col("x") - F.lag("x").over(_w())), F.lit(0.0))
    s = _signed(s).withColumn("step", step)
    return s.select(
        "stream", "k", "t", "x",
        F.abs(F.sum("g").over(_w().rowsBetween(-4, 4)) / 9).alias("gap"),
        F.greatest(dip, F.lit(0.0)).alias("dip"),
        F.col("step").alias("flicker"),
        F.coalesce(flash, F.lit(0.0)).alias("flash"),
        F.coalesce(F.abs(F.col("step") - F.lag("step").over(_w())), F.lit(0.0)).alias("jump"),
    )


def with_robust_z(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """``z_<name>`` for each of ``names``: (x - median) / (1.4826 MAD + 1e-6) within ``keys``.

    Medians are grouped aggregates joined back, so a long stream is no single sort; all names share the two passes."""
    meds = df.groupBy(*keys).agg(*(F.percentile(n, F.lit(0.5)).alias(f"m_{n}") for n in names))
    df = df.join(meds, keys)
    mads = df.groupBy(*keys).agg(*(F.percentile(F.abs(F.col(n) - F.col(f"m_{n}")), F.lit(0.5)).alias(f"a_{n}") for n in names))
    df = df.join(mads, keys)
    for n in names:
        df = df.withColumn(f"z_{n}", (F.col(n) - F.col(f"m_{n}")) / (MAD_SCALE * F.col(f"a_{n}") + EPS))
    return df.drop(*(f"{p}_{n}" for p in "ma" for n in names))


#: The weights of the risk components.
RISK_WEIGHTS = {"gap": 2.0, "dip": 1.5, "flicker": 1.0, "flash": 0.5, "jump": 1.0}


def risk_timeline(s: DataFrame, cut_score: float = 8.0) -> DataFrame:
    """``stream, k, t, risk, cut``: weighted positive robust z of the components, damped to a tenth at cuts."""
    z = with_robust_z(components(s), list(RISK_WEIGHTS), ["stream"])
    risk = sum((F.greatest(F.col(f"z_{n}"), F.lit(0.0)) * w for n, w in RISK_WEIGHTS.items()), F.lit(0.0))
    return z.select("stream", "k", "t", F.col("z_flicker").alias("cut"), F.when(F.col("z_flicker") > cut_score, risk * 0.1).otherwise(risk).alias("risk"))


def scene_cuts(s: DataFrame, least_z: float = 3.0, floor: float = 20.0) -> DataFrame:
    """Frames whose difference to the one before is an outlier and above ``floor``."""
    z = with_robust_z(components(s), ["flicker"], ["stream"])
    return z.where((F.col("z_flicker") > least_z) & (F.col("flicker") > floor)).select("stream", "k", "flicker", F.col("z_flicker").alias("z"))


def parity_summary(s: DataFrame) -> DataFrame:
    return s.groupBy("stream").agg(alternation(F.col("x"), F.col("k")).alias("e_pi"), parity_mean_gap(F.col("x"), F.col("k")).alias("mean_gap"))


def alternation_blocks(s: DataFrame, block: int = 16) -> DataFrame:
    """The largest alternation energy over whole blocks of frames; what doesn't fill a block is left out."""
    b = s.withColumn("b", F.floor(F.col("k") / block)).withColumn("n", F.count("*").over(Window.partitionBy("stream")))
    b = b.where(F.col("b") < F.greatest(F.lit(1), F.floor(F.col("n") / block)))
    each = b.groupBy("stream", "b").agg(alternation(F.col("x"), F.col("k")).alias("e"))
    return each.groupBy("stream").agg(F.max("e").alias("e_pi_block_max"), F.count("*").alias("blocks"))


def technical_summary(s: DataFrame) -> DataFrame:
    """Median and tenth percentile, odd/even ratio, and the deviation of the differences."""
    d = s.withColumn("d", F.col("x") - F.lag("x").over(_w()))
    odd, even = F.avg(F.when(F.col("k") % 2 == 1, F.col("x"))), F.avg(F.when(F.col("k") % 2 == 0, F.col("x")))
    p = F.percentile("x", F.array(F.lit(0.5), F.lit(0.1)))
    return d.groupBy("stream").agg(p[0].alias("p50"), p[1].alias("p10"), (odd / even).alias("odd_even"), F.stddev_pop("d").alias("flicker"))
