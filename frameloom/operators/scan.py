"""The tier-1 scan as one row for each frame, and what is derived from all its columns: cuts, risk, windows, global features.

Frames come as ``stream, k, t, a``: small luma frames as arrays of ``width`` x ``width`` values from 0 to 255, row by row. Statistics of a
frame are expressions of its own row; only the steps between neighbouring frames need an order, in one window pass a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import alternation, parity_mean_gap
from .series import with_robust_z

WIDTH = 8
#: Gradient from which a pixel is an edge's, and bins of the scan's and of the stand-alone detector's histogram.
EDGE, BINS, CUT_BINS = 60.0, 32, 16
#: Z and floor of the hash and histogram distances of a cut; the stand-alone detector's floor and least steps.
HASH_Z, HASH_FLOOR, HIST_Z, HIST_FLOOR, ALONE_FLOOR, ALONE_STEPS = 6.0, 8.0, 8.0, 0.20, 0.35, 8
#: Weights of the six risk components, cut score from which a frame's risk is damped, and by how much.
RISK_WEIGHTS = {"parity_gap": 2.0, "edge_flicker": 1.5, "sharpness_dip": 1.5, "grad_drop": 1.5, "luma_flash": 0.5, "motion_jump": 1.0}
CUT_SCORE, DAMPED = 8.0, 0.1
#: Frames of an alternation block, most windows of a candidate, and seconds between risk windows.
BLOCK, MAX_WINDOWS, GAP_S = 64, 256, 0.5


def _inner(width: int) -> Column:
    return F.array(*(F.lit(y * width + x) for y in range(1, width - 1) for x in range(1, width - 1)))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _variance(values: Column) -> Column:
    """Population variance, in two passes."""
    return F.transform(F.array(_mean(values)), lambda m: _mean(F.transform(values, lambda v: (v - m) * (v - m))))[0]


def histogram(a: Column, bins: int) -> Column:
    """Shares of the values 0 to 255 in equal bins."""
    of = lambda v: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(v * bins / 256))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(a, lambda v: of(v) == b)) / F.size(a))


def bhattacharyya(p: Column, q: Column) -> Column:
    common = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - common))


def frame_scan(frames: DataFrame, width: int = WIDTH) -> DataFrame:
    """``stream, k, t`` and the scan's columns of every frame; steps to the frame before are 0 for a stream's first."""
    at = lambda i: F.get("a", i)
    lap = F.transform(_inner(width), lambda i: at(i - width) + at(i + width) + at(i - 1) + at(i + 1) - 4 * at(i))
    gx = lambda i: at(i - width + 1) + 2 * at(i + 1) + at(i + width + 1) - at(i - width - 1) - 2 * at(i - 1) - at(i + width - 1)
    gy = lambda i: at(i + width - 1) + 2 * at(i + width) + at(i + width + 1) - at(i - width - 1) - 2 * at(i - width) - at(i - width + 1)
    grad = F.transform(_inner(width), lambda i: F.sqrt(gx(i) * gx(i) + gy(i) * gy(i)))
    half = width * width // 2
    ordered = F.sort_array("a")
    bits = F.expr(f"aggregate(sequence(0, {width * width - 1}), 0L, (h, i) -> h | IF(a[i] > middle, shiftleft(1L, i), 0L))")
    own = frames.withColumn("grad", grad).withColumn("middle", (F.get(ordered, F.lit(half - 1)) + F.get(ordered, F.lit(half))) / 2)
    own = own.select(
        "stream", "k", "t", "a", _mean(F.col("a")).alias("luma_mean"), F.sqrt(_variance(F.col("a"))).alias("luma_std"), _variance(lap).alias("sharpness"), _mean(F.col("grad")).alias("grad_energy"),
        (F.size(F.filter("grad", lambda g: g > EDGE)) / F.size("grad")).alias("edge_frac"), bits.alias("hash"), histogram(F.col("a"), BINS).alias("hist"), histogram(F.col("a"), CUT_BINS).alias("hist16"),
    )
    return with_steps(own)


def with_steps(own: DataFrame) -> DataFrame:
    """The scan's table from frames' own statistics and their values ``a``, bits ``hash``, and histograms ``hist`` and ``hist16``."""
    w = Window.partitionBy("stream").orderBy("k")
    last = own.withColumns({f"last_{c}": F.lag(c).over(w) for c in ("a", "hash", "hist", "hist16")})
    step = lambda x: F.coalesce(x, F.lit(0.0))
    return last.select(
        "stream", "k", "t", "luma_mean", "luma_std", "sharpness", "grad_energy", "edge_frac", "hash",
        step(F.bit_count(F.col("hash").bitwiseXOR(F.col("last_hash"))).cast("double")).alias("hash_dist"),
        step(_mean(F.zip_with("a", "last_a", lambda x, y: F.abs(x - y)))).alias("frame_diff"),
        step(bhattacharyya(F.col("hist"), F.col("last_hist"))).alias("hist_dist"),
        step(bhattacharyya(F.col("hist16"), F.col("last_hist16"))).alias("hist16_dist"),
    )


def cut_scores(scan: DataFrame) -> DataFrame:
    """``stream, k, score``: the greater robust z of the hash distance and the frame difference."""
    z = with_robust_z(scan.select("stream", "k", "hash_dist", "frame_diff"), ["hash_dist", "frame_diff"], ["stream"])
    return z.select("stream", "k", F.greatest("z_hash_dist", "z_frame_diff").alias("score"))


def scan_cuts(scan: DataFrame) -> DataFrame:
    """``stream, k`` of the frames whose hash or histogram step is an outlier and above its floor."""
    z = with_robust_z(scan.select("stream", "k", "hash_dist", "hist_dist"), ["hash_dist", "hist_dist"], ["stream"])
    return z.where((F.col("z_hash_dist") > HASH_Z) & (F.col("hash_dist") > HASH_FLOOR) | (F.col("z_hist_dist") > HIST_Z) & (F.col("hist_dist") > HIST_FLOOR)).select("stream", "k")


def cuts_alone(scan: DataFrame) -> DataFrame:
    """``stream, k``: the same with the coarser histogram and its floor, over a stream's steps (its first frame has none), where
    there are enough of them."""
    steps = scan.where("k > 0").select("stream", "k", "hash_dist", "hist16_dist")
    steps = steps.withColumn("n", F.count("*").over(Window.partitionBy("stream"))).where(F.col("n") >= ALONE_STEPS)
    z = with_robust_z(steps, ["hash_dist", "hist16_dist"], ["stream"])
    return z.where((F.col("z_hash_dist") > HASH_Z) & (F.col("hash_dist") > HASH_FLOOR) | (F.col("z_hist16_dist") > HIST_Z) & (F.col("hist16_dist") > ALONE_FLOOR)).select("stream", "k")


def risk_parts(scan: DataFrame) -> DataFrame:
    """``stream, k, t`` and the six components before they are made comparable."""
    w = Window.partitionBy("stream").orderBy("k")
    lag, lead = lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    gap = zero(F.col("sharpness") - 0.5 * (lag("sharpness") + lead("sharpness")))
    trend = lambda c: F.sum(c).over(w.rowsBetween(-2, 2)) / 5
    s = scan.withColumn("signed", F.when(F.col("k") % 2 == 0, gap).otherwise(-gap))
    return s.select(
        "stream", "k", "t",
        F.abs(F.sum("signed").over(w.rowsBetween(-4, 4)) / 9).alias("parity_gap"),
        zero(F.abs(F.col("edge_frac") - lag("edge_frac"))).alias("edge_flicker"),
        F.greatest(trend("sharpness") - F.col("sharpness"), F.lit(0.0)).alias("sharpness_dip"),
        F.greatest(trend("grad_energy") - F.col("grad_energy"), F.lit(0.0)).alias("grad_drop"),
        zero(F.abs(lead("luma_mean") - 2 * F.col("luma_mean") + lag("luma_mean"))).alias("luma_flash"),
        zero(F.abs(F.col("frame_diff") - lag("frame_diff"))).alias("motion_jump"),
    )


def risk(scan: DataFrame) -> DataFrame:
    """``stream, k, t, risk``: the weighted positive robust z of the six components, damped where the cut score is high."""
    z = with_robust_z(risk_parts(scan), list(RISK_WEIGHTS), ["stream"])
    total = sum((F.greatest(F.col(f"z_{n}"), F.lit(0.0)) * weight for n, weight in RISK_WEIGHTS.items()), F.lit(0.0))
    return z.join(cut_scores(scan), ["stream", "k"]).select("stream", "k", "t", F.when(F.col("score") > CUT_SCORE, total * DAMPED).otherwise(total).alias("risk"))


def global_parity(scan: DataFrame) -> DataFrame:
    """``stream`` and alternation energy, its largest block and the parity gap of sharpness, gradients and edges."""
    columns = {"sharp": "sharpness", "grad": "grad_energy", "edge": "edge_frac"}
    n = F.count("*").over(Window.partitionBy("stream"))
    blocks = scan.withColumn("block", F.floor(F.col("k") / BLOCK)).withColumn("blocks", F.greatest(F.lit(1), F.floor(n / BLOCK))).where("block < blocks")
    each = blocks.groupBy("stream", "block").agg(*(alternation(F.col(c), F.col("k")).alias(p) for p, c in columns.items()))
    most = each.groupBy("stream").agg(*(F.max(p).alias(f"parity_{p}_e_pi_block_max") for p in columns))
    whole = scan.groupBy("stream").agg(*(x for p, c in columns.items() for x in (alternation(F.col(c), F.col("k")).alias(f"parity_{p}_e_pi"), parity_mean_gap(F.col(c), F.col("k")).alias(f"parity_{p}_mean_gap"))))
    return whole.join(most, "stream")


def global_technical(scan: DataFrame) -> DataFrame:
    """``stream`` and median and tenth percentile of sharpness, its odd/even ratio, and the deviation of the mean's steps."""
    d = scan.withColumn("d", F.col("luma_mean") - F.lag("luma_mean").over(Window.partitionBy("stream").orderBy("k")))
    odd, even = (F.avg(F.when(F.col("k") % 2 == p, F.col("sharpness"))) for p in (1, 0))
    return d.groupBy("stream").agg(
        F.percentile("sharpness", F.lit(0.5)).alias("gtq_global_sharp_p50"), F.percentile("sharpness", F.lit(0.1)).alias("gtq_global_sharp_p10"),
        (odd / F.greatest(even, F.lit(1e-6))).alias("gtq_global_odd_even_sharp"), F.stddev_pop("d").alias("gtq_global_luma_flicker"),
    )


def select_windows(pairs: DataFrame, cut_pairs: DataFrame, risks: DataFrame, uniform: int, picks: int, reach: int = 2, cap: int = MAX_WINDOWS, gap: float = GAP_S) -> DataFrame:
    """``stream, centre, pair, risk, source``: of the generated frames (``stream, k, pair``) whose pair isn't cut and that have
    ``reach`` frames either side (all, if none has), evenly spread ones and the riskiest, at most ``cap`` by their order."""
    from .windows import temporal_nms

    n = risks.groupBy("stream").agg(F.count("*").alias("frames"))
    centres = pairs.where("pair IS NOT NULL").select("stream", "k", "pair").join(cut_pairs, ["stream", "pair"], "left_anti").join(n, "stream")
    whole = (F.col("k") >= reach) & (F.col("k") < F.col("frames") - reach)
    centres = centres.withColumn("whole", whole).withColumn("any", F.max(whole).over(Window.partitionBy("stream"))).where("whole OR NOT any")
    centres = centres.join(risks, ["stream", "k"])
    w = Window.partitionBy("stream")
    c = centres.withColumn("pos", F.row_number().over(w.orderBy("k")) - 1).withColumn("n", F.count("*").over(w))
    m = F.least(F.lit(uniform), F.col("n"))
    # Centre p is the j-th of m spread ones if that one's place, rounded down, is p.
    step = (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))
    j = F.ceil(F.col("pos") / F.greatest(step, F.lit(1e-9)))
    spread = (F.col("pos") == 0) | (m > 1) & ((F.col("pos") == F.col("n") - 1) | (j < m - 1) & (F.floor(j * step) == F.col("pos")))
    picked = temporal_nms(centres.select("stream", "k", "t", "risk"), picks, gap).select("stream", "k", F.lit(True).alias("risky"))
    both = c.withColumn("even", spread).join(picked, ["stream", "k"], "left").where("even OR risky")
    source = F.when(F.col("even") & F.col("risky"), "uniform+risk").when(F.col("even"), "uniform").otherwise("risk")
    both = both.withColumn("r", F.row_number().over(w.orderBy("k"))).where(F.col("r") <= cap)
    return both.select("stream", F.col("k").alias("centre"), F.col("pair").cast("long").alias("pair"), "risk", source.alias("source"))


def clamped_times(windows: DataFrame, frames: DataFrame, reach: int = 2) -> DataFrame:
    """``stream, centre, start, end``: times of a window's first and last frame, of the stream's where the window reaches beyond."""
    ends = frames.groupBy("stream").agg(F.max("k").alias("last"))
    w = windows.select("stream", "centre").join(ends, "stream")
    w = w.select("stream", "centre", F.greatest(F.col("centre") - reach, F.lit(0)).alias("k0"), F.least(F.col("centre") + reach, F.col("last")).alias("k1"))
    t = frames.select("stream", "k", "t")
    first = t.select("stream", F.col("k").alias("k0"), F.col("t").alias("start"))
    final = t.select("stream", F.col("k").alias("k1"), F.col("t").alias("end"))
    return w.join(first, ["stream", "k0"]).join(final, ["stream", "k1"]).select("stream", "centre", "start", "end")
