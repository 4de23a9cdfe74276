"""Alignment of a candidate sequence with its source, and the joins built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

OFFSETS = tuple(range(-3, 4))


def split_parity(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source (even frames, renumbered) and candidate (all frames) of a series."""
    return s.where(F.col("k") % 2 == 0).select("stream", (F.col("k") / 2).cast("long").alias("i"), "t", "x"), s


def offset_errors(source: DataFrame, candidate: DataFrame, samples: int = 64, least: int = 4) -> DataFrame:
    """``stream, off, err, n``: mean |t of candidate 2i+off - t of source i| over at most ``samples`` spread source frames."""
    n = F.count("*").over(Window.partitionBy("stream"))
    s = source.withColumn("n", n).withColumn("m", F.least(F.lit(samples), F.col("n")))
    # Frame i is sample j = ceil(i (m-1) / (n-1)) if that sample's place, rounded down, is i.
    step = (F.col("n") - 1).cast("double") / F.greatest(F.col("m") - 1, F.lit(1)).cast("double")
    j = F.ceil(F.col("i") / F.greatest(step, F.lit(1e-9)))
    s = s.where((F.col("n") <= samples) | ((F.floor(j * step) == F.col("i")) & (j < F.col("m"))) | (F.col("i") == F.col("n") - 1))
    tries = s.select("stream", "i", F.col("t").alias("ts"), F.explode(F.array(*map(F.lit, OFFSETS))).alias("off"))
    hit = tries.withColumn("k", 2 * F.col("i") + F.col("off")).join(candidate.select("stream", "k", "t"), ["stream", "k"])
    return hit.groupBy("stream", "off").agg(F.avg(F.abs(F.col("t") - F.col("ts"))).alias("err"), F.count("*").alias("n")).where(F.col("n") >= least)


def best_offset(errors: DataFrame) -> DataFrame:
    """The offset of least error for each stream, the most negative of equal ones."""
    return errors.groupBy("stream").agg(F.min(F.struct("err", "off")).alias("b")).select("stream", F.col("b.off").cast("long").alias("off"), F.col("b.err").alias("err"))


def anchor_pairs(candidate: DataFrame, offsets: DataFrame, source: DataFrame) -> DataFrame:
    """``stream, k, anchor, pair``: candidate 2i+off is source i's anchor; the frame after it belongs to pair i; else null."""
    n = source.groupBy("stream").agg(F.count("*").alias("n"))
    c = candidate.select("stream", "k").join(offsets.select("stream", "off"), "stream").join(n, "stream")
    d = F.col("k") - F.col("off")
    i = F.floor(d / 2)
    even = F.pmod(d, F.lit(2)) == 0
    return c.select("stream", "k", F.when(even & (i >= 0) & (i < F.col("n")), i).alias("anchor"), F.when(~even & (i >= 0) & (i < F.col("n") - 1), i).alias("pair"))


def nearest_within(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """``stream, k, t, match, dt``: for each left row the right row (``stream, i, t``) nearest in time within ``tolerance`` seconds.

    An equi join on time buckets of that width (each left row looks in three), so no stream is compared as a whole."""
    bucket = F.floor(F.col("t") / tolerance)
    l = left.select("stream", "k", "t").withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))  # noqa: E741
    r = right.select("stream", F.col("i").alias("match"), F.col("t").alias("rt")).withColumn("b", F.floor(F.col("rt") / tolerance))
    hit = l.join(r, ["stream", "b"]).withColumn("dt", F.abs(F.col("t") - F.col("rt"))).where(F.col("dt") <= tolerance)
    return hit.groupBy("stream", "k", "t").agg(F.min(F.struct("dt", "match")).alias("m")).select("stream", "k", "t", F.col("m.match").alias("match"), F.col("m.dt").alias("dt"))


def cut_pairs(cuts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``stream, pair``: pairs that a cut falls on; a cut at an anchor takes the pair before, one in a pair that pair."""
    at = cuts.select("stream", "k").join(pairs, ["stream", "k"])
    before = at.where("anchor > 0").select("stream", (F.col("anchor") - 1).alias("pair"))
    return before.union(at.where("pair IS NOT NULL").select("stream", "pair")).distinct()


def overlaps(found: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """``found`` rows (``stream, start, end, labels``) joined to truth segments (``stream, seg, t0, t1, expected``) that they
    overlap within ``tolerance`` and share a label with."""
    t = truth.select(F.col("stream").alias("s"), "seg", "t0", "t1", "expected")
    near = (F.col("stream") == F.col("s")) & (F.col("start") <= F.col("t1") + tolerance) & (F.col("end") >= F.col("t0") - tolerance)
    return found.join(t, near & F.arrays_overlap("labels", "expected")).drop("s")
