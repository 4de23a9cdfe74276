"""Image operators on pixel rows (``frame, scene, y, x, v``): small frames as relations, whole-stage code, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

_SIZE = 8


def _row() -> WindowSpec:
    return Window.partitionBy("frame", "y").orderBy("x")


def _col() -> WindowSpec:
    return Window.partitionBy("frame", "x").orderBy("y")


def with_next(p: DataFrame, step: int = 1) -> DataFrame:
    """``w``: the value at the same place ``step`` frames on; the last frames have no partner and go."""
    later = p.select((F.col("frame") - step).alias("frame"), "y", "x", F.col("v").alias("w"))
    return p.join(later, ["frame", "y", "x"])


def luma_l1(p: DataFrame) -> DataFrame:
    return with_next(p).groupBy("frame").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("l1"))


def psnr(p: DataFrame, peak: float = 1.0) -> DataFrame:
    mse = F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))
    return with_next(p).groupBy("frame").agg((10.0 * F.log10(F.lit(peak * peak) / F.greatest(mse, F.lit(1e-9)))).alias("psnr"))


def laplacian(p: DataFrame) -> DataFrame:
    """``l``: the four-neighbour Laplacian of inner pixels."""
    up, down, left, right = F.lag("v").over(_col()), F.lead("v").over(_col()), F.lag("v").over(_row()), F.lead("v").over(_row())
    return p.withColumn("l", up + down + left + right - 4 * F.col("v")).where("l IS NOT NULL")


def sharpness(p: DataFrame) -> DataFrame:
    return laplacian(p).groupBy("frame").agg(F.var_pop("l").alias("sharpness"))


def noise_sigma(p: DataFrame) -> DataFrame:
    """MAD of the Laplacian / 0.6745 / sqrt(20)."""
    lap = laplacian(p)
    med = lap.groupBy("frame").agg(F.percentile("l", F.lit(0.5)).alias("m"))
    return lap.join(med, "frame").groupBy("frame").agg((F.percentile(F.abs(F.col("l") - F.col("m")), F.lit(0.5)) / 0.6745 / (20.0**0.5)).alias("sigma"))


def gradient_energy(p: DataFrame) -> DataFrame:
    g = p.withColumn("gx", F.lead("v").over(_row()) - F.col("v")).withColumn("gy", F.lead("v").over(_col()) - F.col("v")).where("gx IS NOT NULL AND gy IS NOT NULL")
    return g.groupBy("frame").agg(F.avg(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("energy"))


def blockiness(p: DataFrame, block: int = 4) -> DataFrame:
    """The mean step across block borders over the mean step elsewhere, horizontally."""
    d = p.withColumn("d", F.abs(F.col("v") - F.lag("v").over(_row()))).where("d IS NOT NULL")
    border = F.col("x") % block == 0
    return d.groupBy("frame").agg((F.avg(F.when(border, F.col("d"))) / (F.avg(F.when(~border, F.col("d"))) + 1e-6)).alias("blockiness"))


def histogram(p: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """``frame, bin, share``."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / ((high - low) / bins)))).cast("long")
    h = p.groupBy("frame", b.alias("bin")).agg(F.count("*").alias("n"))
    return h.select("frame", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("frame"))).alias("share"))


def bhattacharyya(p: DataFrame, bins: int = 8, low: float = -0.4, high: float = 0.4) -> DataFrame:
    """``frame, distance`` of each frame's histogram from the next frame's: sqrt(max(0, 1 - sum of sqrt(a b)))."""
    h = histogram(p, bins, low, high)
    later = h.select((F.col("frame") - 1).alias("frame"), "bin", F.col("share").alias("other"))
    common = h.join(later, ["frame", "bin"], "left").groupBy("frame").agg(F.sum(F.sqrt(F.col("share") * F.coalesce("other", F.lit(0.0)))).alias("c"))
    known = later.select("frame").distinct()
    return common.join(known, "frame").select("frame", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("c"))).alias("distance"))


def median_hash(p: DataFrame) -> DataFrame:
    """``frame, hash``: a bit for each pixel above the frame's median, pixel 0 lowest, as a signed long."""
    med = p.groupBy("frame").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    bit = F.expr(f"CASE WHEN v > m THEN shiftleft(1L, CAST(y * {_SIZE} + x AS INT)) ELSE 0L END")
    return p.join(med, "frame").withColumn("bit", bit).groupBy("frame").agg(F.bit_or("bit").alias("hash"))


def hash_distance(p: DataFrame) -> DataFrame:
    h = median_hash(p)
    later = h.select((F.col("frame") - 1).alias("frame"), F.col("hash").alias("other"))
    return h.join(later, "frame").select("frame", F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))).cast("long").alias("bits"))


def alpha_blend(p: DataFrame) -> DataFrame:
    """Each frame as a blend of its neighbours: the least-squares share of the next one, within 0 to 1, and the mean residual."""
    three = with_next(p).join(p.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("u")), ["frame", "y", "x"])
    d, m = F.col("w") - F.col("u"), F.col("v") - F.col("u")
    fit = three.groupBy("frame").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(m * d) / (F.sum(d * d) + 1e-6))).alias("alpha"))
    rest = F.avg(F.abs(F.col("v") - ((1 - F.col("alpha")) * F.col("u") + F.col("alpha") * F.col("w"))))
    return three.join(fit, "frame").groupBy("frame", "alpha").agg(rest.alias("residual"))


def masked_residual(p: DataFrame, tau: float = 0.05, least: int = 16, visible: float = 0.25) -> DataFrame:
    """Charbonnier residuals to the next frame over pixels within ``visible`` of 0: mean, p50, p90; null under ``least`` pixels."""
    r = F.sqrt((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")) + tau * tau) - tau
    seen = F.when(F.abs(F.col("v")) < visible, r)
    q = F.percentile(seen, F.array(F.lit(0.5), F.lit(0.9)))
    out = with_next(p).groupBy("frame").agg(F.count(seen).alias("n"), F.avg(seen).alias("mean"), q[0].alias("p50"), q[1].alias("p90"))
    return out.select("frame", "n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("mean", "p50", "p90")))


def _shifted(dx: float, dy: float, size: int) -> list[tuple[int, int, float]]:
    x0, y0 = int(dx // 1), int(dy // 1)
    fx, fy = dx - x0, dy - y0
    return [(y0 + j, x0 + i, (fx if i else 1 - fx) * (fy if j else 1 - fy)) for j in (0, 1) for i in (0, 1) if (fx if i else 1 - fx) * (fy if j else 1 - fy) > 0]


def forward_splat(p: DataFrame, dx: float, dy: float, size: int = _SIZE) -> DataFrame:
    """Bilinear scatter by a constant motion: each pixel lands on up to four, normalised by what landed."""
    to = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(w).alias("w")) for j, i, w in _shifted(dx, dy, size)))
    land = p.select("frame", "y", "x", "v", F.explode(to).alias("s")).select("frame", (F.col("y") + F.col("s.j")).alias("y"), (F.col("x") + F.col("s.i")).alias("x"), "v", F.col("s.w").alias("w"))
    land = land.where(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1))
    return land.groupBy("frame", "y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("coverage"))


def backward_warp(p: DataFrame, dx: float, dy: float, size: int = _SIZE) -> DataFrame:
    """Bilinear gather at (x + dx, y + dy), mirrored at the borders without repeating the edge."""
    from_ = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(w).alias("w")) for j, i, w in _shifted(dx, dy, size)))

    def mirror(c: Column) -> Column:
        c = F.abs(c)
        return F.when(c > size - 1, 2 * (size - 1) - c).otherwise(c)

    want = p.select("frame", "y", "x", F.explode(from_).alias("s"))
    want = want.select("frame", "y", "x", mirror(F.col("y") + F.col("s.j")).alias("sy"), mirror(F.col("x") + F.col("s.i")).alias("sx"), F.col("s.w").alias("w"))
    source = p.select("frame", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return want.join(source, ["frame", "sy", "sx"]).groupBy("frame", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def flow_geometry(p: DataFrame) -> DataFrame:
    """Even frames as the horizontal and the next frames as the vertical part of a flow: share of folds (determinant below 0), of
    low determinants (below 0.5), and the deviations of divergence and curl."""
    f = with_next(p).where(F.col("frame") % 2 == 0)

    def slope(c: str, w) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    f = f.select("frame", "y", "x", *(slope(c, w).alias(n) for n, c, w in (("ux", "v", _row()), ("uy", "v", _col()), ("vx", "w", _row()), ("vy", "w", _col()))))
    det = (1 + F.col("ux")) * (1 + F.col("vy")) - F.col("uy") * F.col("vx")
    f = f.withColumn("det", det)
    share = lambda c: F.avg(c.cast("double"))
    return f.groupBy("frame").agg(share(F.col("det") < 0).alias("fold"), share(F.col("det") < 0.5).alias("low"), F.stddev_pop(F.col("ux") + F.col("vy")).alias("div_std"), F.stddev_pop(F.col("vx") - F.col("uy")).alias("curl_std"))


def bounding_box(p: DataFrame, above: float) -> DataFrame:
    return p.where(F.col("v") > above).groupBy("frame").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))


def static_mask(p: DataFrame, below: float) -> DataFrame:
    """``scene, y, x, mad``: places whose median distance from their median over the scene's frames is below ``below``."""
    med = p.groupBy("scene", "y", "x").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    mad = p.join(med, ["scene", "y", "x"]).groupBy("scene", "y", "x").agg(F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5)).alias("mad"))
    return mad.where(F.col("mad") < below)


def linear_blend(p: DataFrame) -> DataFrame:
    """The frames at even numbers and the means of neighbours between them."""
    mid = with_next(p).select((2 * F.col("frame") + 1).alias("frame"), "y", "x", ((F.col("v") + F.col("w")) / 2).alias("v"))
    return p.select((2 * F.col("frame")).alias("frame"), "y", "x", "v").unionByName(mid)


def block_density(p: DataFrame, block: int = 4, above: float = 0.15, density: float = 0.12) -> DataFrame:
    """``frame, by, bx, share``: blocks where more than ``density`` of the horizontal steps exceed ``above``."""
    d = p.withColumn("d", F.abs(F.col("v") - F.lag("v").over(_row())))
    share = F.avg((F.coalesce("d", F.lit(0.0)) > above).cast("double"))
    return d.groupBy("frame", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(share.alias("share")).where(F.col("share") > density)


def defect_mid(p: DataFrame, kind: str) -> DataFrame:
    """Injected defects of the mid frame between a frame and the next: ghost, freeze, tear (left half, right half), or fill."""
    two = with_next(p)
    fill = F.percentile("v", F.lit(0.5)).over(Window.partitionBy("frame"))
    value = {
        "ghost": (F.col("v") + F.col("w")) / 2,
        "freeze": F.col("v"),
        "tear": F.when(F.col("x") < _SIZE // 2, F.col("v")).otherwise(F.col("w")),
        "fill": F.when(F.col("x") >= _SIZE - 2, fill).otherwise((F.col("v") + F.col("w")) / 2),
    }[kind]
    return two.select("frame", "y", "x", value.alias("v"))
