"""Evaluating candidate sequences against their source as one plan: scan, alignment, cuts, windows, kernels, global features, scores,
confidence, labels, ranking.

Frames are rows ``model, k, t, h, w, luma`` (bytes); source frames ``k, t, h, w, luma``; both may have ``source``. Only the frames of chosen windows and probes reach
the kernels. Without a source, a candidate's even frames are taken for it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import align, fusion, kernels, regions, report_rules, scan as scans, windows
from ..sources.frames import PatternSource
from ..sources.tables import written

#: Windows of the presets, (uniform, by risk), and those that measure regions too.
PRESETS = {"fast": (8, 8), "standard": (16, 32), "audit": (24, 48)}
WITH_REGIONS = ("standard", "audit")
#: Anchors that are compared with the source, and of those the ones whose neighbours are; how much better and how bad
#: an anchor must be to count as shifted; most of the worst windows, and seconds between them.
PROBES, SHIFTED, BETTER, BAD, WORST, WORST_GAP = 12, 4, 0.6, 3.0, 12, 0.5
#: Windows without these features aren't valid.
CORE_FEATURES = ("comp_mean", "mct_lag1_mean", "edge_recall")
THUMB = 32
DEFECTS = ("good", "ghost", "freeze", "blur")


def image(luma: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(luma, np.uint8).reshape(h, w).astype(np.float64)


def scan(frames: DataFrame) -> DataFrame:
    """The scan's table (``operators.scan``) of each model; frame differences are those of ``THUMB`` x ``THUMB`` block means."""
    columns = ["stream", "k", "t", "a", "luma_mean", "luma_std", "sharpness", "grad_energy", "edge_frac", "hash", "hist", "hist16"]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for luma, h, w in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                i = image(luma, h, w)
                gx, gy = kernels.sobel(i)
                g = np.hypot(gx, gy)
                hist = [(np.bincount(np.minimum(i.astype(int) * n // 256, n - 1).ravel(), minlength=n) / i.size).tolist() for n in (scans.BINS, scans.CUT_BINS)]
                rows.append((kernels.shrink(i, THUMB).ravel().tolist(), i.mean(), i.std(), kernels.laplacian(i).var(), g.mean(), (g > scans.EDGE).mean(), kernels.phash(i), *hist))
            own = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.list_(pa.float64()), *[pa.float64()] * 5, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, kind) for c, kind in zip(own, kinds, strict=True))], columns)

    schema = "stream string, k long, t double, a array<double>, luma_mean double, luma_std double, sharpness double, grad_energy double, edge_frac double, hash long, hist array<double>, hist16 array<double>"
    return scans.with_steps(frames.select(F.col("model").cast("string"), F.col("k").cast("long"), F.col("t").cast("double"), "luma", "h", "w").mapInArrow(stats, schema))


def window_features(frames: DataFrame, centres: DataFrame, with_regions: bool = False) -> DataFrame:
    """``model, window, feature, value``: the kernels' features of each window, long; NaN as null.

    The windows' frames are joined before they are gathered, five rows to a group."""
    at = centres.select(F.col("stream").alias("model"), F.col("k").alias("window"), F.explode(F.sequence(F.col("k") - 2, F.col("k") + 2)).alias("k"))
    five = at.join(frames.select("model", "k", "h", "w", "luma"), ["model", "k"])

    def run(five: pa.Table) -> pa.Table:
        five = five.sort_by("k")
        images = [image(luma, h, w) for luma, h, w in zip(*(five[c].to_pylist() for c in ("luma", "h", "w")), strict=True)]
        found = kernels.window_features(images) if len(images) == 5 else {}
        if found and with_regions:
            found |= regions.region_features(images)
        n = len(found)
        return pa.table({"model": pa.array(five["model"].to_pylist()[:1] * n, pa.string()), "window": pa.array(five["window"].to_pylist()[:1] * n, pa.int64()), "feature": pa.array(list(found), pa.string()), "value": pa.array(list(map(float, found.values())), pa.float64())})

    out = five.groupBy("model", "window").applyInArrow(run, "model string, window long, feature string, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@dataclass
class Evaluation:
    """Tables of a run, one row for each candidate or window: ``ranking`` (model, overall, relative, rank, confidence, status,
    warnings), ``windows`` (model, centre, pair, risk, source, start, end), ``worst`` (model, centre, start, end, labels, severity), ``features``
    (model, window or null, feature, value) and ``alignment``."""

    ranking: DataFrame
    windows: DataFrame
    worst: DataFrame
    features: DataFrame
    alignment: DataFrame


def anchor_features(frames: DataFrame, source: DataFrame, pairs: DataFrame) -> DataFrame:
    """``stream`` and the anchors' errors against the source at evenly spread probes: median and 90th percentile, and the share
    of probes whose neighbour fits clearly better. Frames meet by joins; only the probes' pixels are compared."""
    w = Window.partitionBy("stream")
    anchors = pairs.where("anchor IS NOT NULL").withColumn("pos", F.row_number().over(w.orderBy("k")) - 1).withColumn("n", F.count("*").over(w))
    m = F.least(F.lit(PROBES), F.col("n"))
    step = (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))
    j = F.ceil(F.col("pos") / F.greatest(step, F.lit(1e-9)))
    spread = (F.col("pos") == 0) | (m > 1) & ((F.col("pos") == F.col("n") - 1) | (j < m - 1) & (F.floor(j * step) == F.col("pos")))
    probes = anchors.where(spread).withColumn("probe", F.row_number().over(w.orderBy("k")))
    shifts = F.when(F.col("probe") <= SHIFTED, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    tries = probes.select("stream", "anchor", "probe", "k", F.explode(shifts).alias("shift")).withColumn("k", F.col("k") + F.col("shift"))
    own = frames.select(F.col("model").alias("stream"), "k", "luma")
    theirs = source.select("stream", F.col("i").alias("anchor"), F.col("luma").alias("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = [float(np.abs(np.frombuffer(x, np.uint8).astype(float) - np.frombuffer(y, np.uint8)).mean()) if len(x) == len(y) else None for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(errors, pa.float64())], ["stream", "probe", "shift", "e"])

    found = tries.join(own, ["stream", "k"]).join(theirs, ["stream", "anchor"]).select("stream", "probe", F.col("shift").cast("long"), "luma", "other")
    each = found.mapInArrow(compare, "stream string, probe int, shift long, e double").groupBy("stream", "probe").agg(F.max(F.when(F.col("shift") == 0, F.col("e"))).alias("e"), F.min("e").alias("best"))
    better = (F.col("probe") <= SHIFTED) & (F.col("best") < BETTER * F.col("e")) & (F.col("e") > BAD)
    p = F.percentile("e", F.array(F.lit(0.5), F.lit(0.9)))
    return each.groupBy("stream").agg(p[0].alias("anchor_y_l1_p50"), p[1].alias("anchor_y_l1_p90"), F.avg(better.cast("double")).alias("anchor_shift_better_frac"))


def _unpivot(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "stream"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names)))
    return df.select(F.col("stream").alias("model"), cells.alias("c")).select("model", "c.feature", "c.value")


def evaluation(frames: DataFrame, source: DataFrame | None = None, preset: str = "fast") -> Evaluation:
    """The whole run; the scan, the pairs, the windows and the features are written, as several tables use them."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    spark = frames.sparkSession
    uniform, by_risk = PRESETS[preset]
    frames = frames.withColumn("k", F.col("k").cast("long"))
    scanned = written(scan(frames), "scan")
    candidate = scanned.select("stream", "k", "t")
    if source is None:
        originals = frames.where(F.col("k") % 2 == 0).select(F.col("model").alias("stream"), F.floor(F.col("k") / 2).alias("i"), "t", "luma")
    else:
        # Candidates name their source in a column ``source``, where there are several.
        named = lambda df: df if "source" in df.columns else df.withColumn("source", F.lit("source"))
        models = named(frames).select("source", F.col("model").alias("stream")).distinct()
        originals = named(source).join(models, "source").select("stream", F.col("k").cast("long").alias("i"), "t", "luma")
    times = originals.select("stream", "i", "t")
    offsets = align.best_offset(align.offset_errors(times, candidate))
    offsets = written(offsets, "offsets")
    pairs = written(align.anchor_pairs(candidate, offsets, times), "pairs")
    cuts = align.cut_pairs(scans.scan_cuts(scanned), pairs)
    chosen = scans.select_windows(pairs.select("stream", "k", "pair"), cuts, scans.risk(scanned), uniform, by_risk)
    chosen = written(chosen, "windows")
    local = window_features(frames, chosen.select("stream", F.col("centre").alias("k")), preset in WITH_REGIONS)
    local = written(local, "features")
    anchors = written(anchor_features(frames, originals, pairs), "anchors")
    overall = _unpivot(scans.global_parity(scanned)).unionByName(_unpivot(scans.global_technical(scanned))).unionByName(_unpivot(anchors))

    dim = fusion.feature_dim(spark)
    errors, global_errors = fusion.normalise(local, dim), fusion.normalise(overall, dim)
    categories = fusion.aggregate_categories(fusion.category_errors(errors, ["model"], global_errors), ["model"])
    report = report_rules.alignment_report(times, candidate, offsets)

    core = [F.max(F.when(F.col("feature") == f, F.col("value"))) for f in CORE_FEATURES]
    whole = F.lit(True)
    for x in core:
        whole &= x.isNotNull()
    pick = lambda name: F.max(F.when(F.col("feature") == name, F.col("value")))
    each = local.groupBy("model", "window").agg(whole.alias("valid"), F.count("value").alias("keys"), pick("comp_visible_fraction").alias("visible"), pick("event_ambiguity").alias("ambiguity"))
    trust = each.groupBy("model").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.avg("visible").alias("visible"), F.avg("keys").alias("keys"), F.avg("ambiguity").alias("ambiguity"))
    n = scanned.groupBy(F.col("stream").alias("model")).agg(F.count("*").alias("frames"))
    said = report.select(F.col("stream").alias("model"), "warnings")
    trust = n.join(trust, "model", "left").fillna(0, ["total", "valid"]).join(anchors.select(F.col("stream").alias("model"), F.col("anchor_y_l1_p50").alias("anchor_error")), "model", "left").join(said, "model", "left")
    trust = trust.withColumn("said", F.coalesce("warnings", F.lit(""))).withColumn("warnings", F.when(F.col("said") == "", 0).otherwise(F.size(F.split("said", "\\+"))))
    trust = trust.withColumn("windows_per_frame", F.col("total") / F.col("frames"))
    trust = trust.select("model", "total", "valid", F.col("said").alias("warnings"), fusion.confidence(trust).alias("confidence"))

    scores = n.select("model").join(fusion.overall_scores(categories, ["model"]), "model", "left")
    ranking = fusion.rank_models(scores, "model").join(trust, "model")
    failed = F.col("overall").isNull() | (F.col("valid") == 0)
    status = F.when(failed, "failed").when(F.col("valid") < F.col("total"), "degraded").otherwise("ok")
    ranking = ranking.select("model", F.when(~failed, F.col("overall")).alias("overall"), "relative", "rank", "confidence", status.alias("status"), "warnings")
    timed = chosen.join(scans.clamped_times(chosen, candidate), ["stream", "centre"]).withColumnRenamed("stream", "model")
    return Evaluation(ranking, timed, _worst(local, errors, chosen, candidate), local.unionByName(overall.select("model", F.lit(None).cast("long").alias("window"), "feature", "value")), report)


def _worst(local: DataFrame, errors: DataFrame, chosen: DataFrame, candidate: DataFrame) -> DataFrame:
    """The labelled windows by severity, apart by more than ``WORST_GAP`` seconds, ``WORST`` of a model at most."""
    wanted = ["card_flip_err", "freeze_copy_score", "flow_fold_frac", "char_leak_mean", "char_ring_edge_frac", "weapon_dev_p90", "event_ghost_frac"]
    value = lambda name: F.max(F.when(F.col("feature") == name, F.col("value"))).alias(name)
    error = lambda name: F.max(F.when(F.col("feature") == name, F.col("error"))).alias(f"{name}_error")
    features = errors.groupBy("model", "window").agg(*map(value, wanted), error("parity_window_sharp_gap"), error("text_edge_f"))
    trigger = fusion.trigger_errors(errors, ["model", "window"])
    by_category = trigger.groupBy("model", "window").agg(*(F.coalesce(F.max(F.when(F.col("category") == c, F.col("error"))), F.lit(0.0)).alias(f"{c}_") for c in report_rules.LABEL_FROM))
    rows = features.join(by_category, ["model", "window"])
    labelled = report_rules.window_labels(rows, lambda c: F.col(f"{c}_"), F.col, F.col("parity_window_sharp_gap_error"), F.col("text_edge_f_error"))
    spans = scans.clamped_times(chosen, candidate)
    timed = labelled.select(F.col("model").alias("stream"), F.col("window").alias("centre"), "labels", "severity").join(spans, ["stream", "centre"])
    kept = windows.dedupe_worst(timed.select("stream", F.col("centre").alias("k"), F.col("start").alias("t"), "severity"), WORST_GAP, WORST)
    return timed.join(kept.select("stream", F.col("k").alias("centre")), ["stream", "centre"]).withColumnRenamed("stream", "model")


def evaluate(frames: DataFrame, preset: str = "fast", source: DataFrame | None = None) -> DataFrame:
    """``model, overall, relative, rank, confidence, status, warnings`` of each candidate."""
    return evaluation(frames, source, preset).ranking


def candidates(spark: SparkSession, frames: int = 64, size: int = 48, speed: float = 4.0) -> DataFrame:
    """A moving texture whose odd frames are true, blended, frozen or blurred."""
    spark.dataSource.register(PatternSource)
    base = spark.read.format("pattern").option("frames", str(frames)).option("size", str(size)).option("speed", str(speed)).load()
    order = Window.partitionBy("g").orderBy("frame_idx")  # the neighbours of a generated test sequence
    near = base.withColumn("g", F.lit(0)).withColumn("before", F.lag("luma").over(order)).withColumn("after", F.lead("luma").over(order)).drop("g")

    def damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                for kind in DEFECTS:
                    luma = r.luma
                    if r.frame_idx % 2 and r.before is not None and r.after is not None:
                        one, two = image(r.before, r.h, r.w), image(r.after, r.h, r.w)
                        if kind == "ghost":
                            luma = ((one + two) / 2).round().astype(np.uint8).tobytes()
                        elif kind == "freeze":
                            luma = r.before
                        elif kind == "blur":
                            luma = kernels.box(kernels.box(image(r.luma, r.h, r.w), 2), 2).round().astype(np.uint8).tobytes()
                    rows.append((kind, r.frame_idx, r.pts, r.h, r.w, luma))
            yield pd.DataFrame(rows, columns=["model", "k", "t", "h", "w", "luma"])

    return near.mapInPandas(damage, "model string, k long, t double, h int, w int, luma binary")
