"""Choosing and laying out evaluation windows: temporal suppression, uniform samples, unions, runs, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _greedy(candidates: Column, gap: float, top: int, strict: bool = False) -> Column:
    """Folds an ordered array of structs with ``t``: takes one if it is ``gap`` or more (more, if strict) from all taken."""

    def step(taken: Column, c: Column) -> Column:
        far = F.forall(taken, lambda p: (F.abs(p["t"] - c["t"]) > gap) if strict else (F.abs(p["t"] - c["t"]) >= gap))
        return F.when((F.size(taken) < top) & far, F.array_append(taken, c)).otherwise(taken)

    return F.aggregate(candidates, F.slice(candidates, 1, 0), step)


def temporal_nms(risk: DataFrame, top: int = 8, gap: float = 3600.0, value: str = "risk") -> DataFrame:
    """``stream, k, t, value`` of the picks: by falling value (then number), above 0, apart by ``gap`` seconds.

    Only a stream's frames above 0 are folded; the fold keeps at most ``top`` of them."""
    each = risk.where(F.col(value) > 0).groupBy("stream").agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("minus"), "k", "t"))).alias("c"))
    picks = each.select("stream", F.explode(_greedy(F.col("c"), gap, top)).alias("p"))
    return picks.select("stream", "p.k", "p.t", (-F.col("p.minus")).alias("value"))


def uniform_centres(s: DataFrame, wanted: int = 8) -> DataFrame:
    """``stream, k``: of the odd frames with two neighbours either side, ``wanted`` (or all) evenly spread ones."""
    n = F.count("*").over(Window.partitionBy("stream"))
    odd = s.withColumn("n", n).where((F.col("k") % 2 == 1) & (F.col("k") >= 2) & (F.col("k") < F.col("n") - 2))
    w = Window.partitionBy("stream")
    odd = odd.withColumn("pos", F.row_number().over(w.orderBy("k")) - 1).withColumn("c", F.count("*").over(w))
    m = F.least(F.lit(wanted), F.col("c"))
    places = odd.select("stream", "c").distinct().withColumn("m", m).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    step = (F.col("c") - 1).cast("double") / F.greatest(F.col("m") - 1, F.lit(1)).cast("double")
    place = F.when(F.col("j") == F.col("m") - 1, F.when(F.col("m") == 1, F.lit(0)).otherwise(F.col("c") - 1)).otherwise(F.floor(F.col("j") * step))
    return places.select("stream", place.cast("int").alias("pos")).join(odd, ["stream", "pos"]).select("stream", "k").distinct()


def union_windows(uniform: DataFrame, picks: DataFrame) -> DataFrame:
    """``stream, k, source``: both choices, each centre once, with where it came from."""
    u = uniform.select("stream", "k", F.lit("uniform").alias("s"))
    both = u.unionByName(picks.select("stream", "k", F.lit("risk").alias("s")))
    return both.groupBy("stream", "k").agg(F.array_join(F.reverse(F.sort_array(F.collect_set("s"))), "+").alias("source"))


def explode_windows(centres: DataFrame, s: DataFrame, reach: int = 2) -> DataFrame:
    """``stream, centre, pos, k, t, x``: the frames of each window that has all of them."""
    at = centres.select("stream", F.col("k").alias("centre"), F.posexplode(F.sequence(F.col("k") - reach, F.col("k") + reach)).alias("pos", "k"))
    whole = at.join(s, ["stream", "k"])
    n = F.count("*").over(Window.partitionBy("stream", "centre"))
    return whole.withColumn("n", n).where(F.col("n") == 2 * reach + 1).select("stream", "centre", F.col("pos").cast("long").alias("pos"), "k", "t", "x")


def window_times(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream", "centre").agg(F.min("t").alias("start"), F.max("t").alias("end"))


def window_parity_gap(frames: DataFrame) -> DataFrame:
    """|mean even - mean odd| / (median + 1e-6) over a window's frames."""
    even, odd = F.avg(F.when(F.col("k") % 2 == 0, F.col("x"))), F.avg(F.when(F.col("k") % 2 == 1, F.col("x")))
    return frames.groupBy("stream", "centre").agg((F.abs(even - odd) / (F.percentile("x", F.lit(0.5)) + 1e-6)).alias("gap"))


def gap_runs(rows: DataFrame, key: str, order: str, gap: int) -> DataFrame:
    """``key, run, first, last, n``: runs of numbers that no step over ``gap`` interrupts."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    runs = rows.select(key, order).distinct().withColumn("new", new)
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return runs.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def dedupe_worst(rows: DataFrame, gap: float, top: int, value: str = "severity") -> DataFrame:
    """The worst rows first, later ones only if more than ``gap`` seconds from all taken."""
    each = rows.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("minus"), "k", "t"))).alias("c"))
    picks = each.select("stream", F.explode(_greedy(F.col("c"), gap, top, strict=True)).alias("p"))
    return picks.select("stream", "p.k", "p.t", (-F.col("p.minus")).alias(value))
