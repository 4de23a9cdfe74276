"""Does the score order candidates as the truth does, and do labels find defects? Runs over generated scenes."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import evaluate as measures, report_rules
from .plans.evaluate import evaluation
from .sources import scene as scenes


def full_reference(candidate: DataFrame, scene: scenes.Scene) -> DataFrame:
    """``model, psnr, luma``: mean PSNR and absolute error of the odd frames against the scene's true ones."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                truth = np.clip(scene.frame(r.k), 0, 255).round()
                d = np.frombuffer(r.luma, np.uint8).reshape(r.h, r.w) - truth
                rows.append((r.model, 10 * np.log10(255.0**2 / max(float((d * d).mean()), 0.01)), float(np.abs(d).mean())))
            yield pd.DataFrame(rows, columns=["model", "psnr", "luma"])

    each = candidate.where(F.col("k") % 2 == 1).mapInPandas(run, "model string, psnr double, luma double")
    return each.groupBy("model").agg(F.avg("psnr").alias("psnr"), F.avg("luma").alias("luma"))


def ranking_agreement(spark: SparkSession, candidates: Callable[[scenes.Scene], DataFrame], seeds: tuple[int, ...] = (7,), n: int = 48, preset: str = "fast") -> dict:
    """Correlations and pairwise accuracy of scores with PSNR over all candidates, within seeds too, and of the features."""
    rows, wide = None, None
    for seed in seeds:
        scene = scenes.Scene(n, seed=seed)
        frames = candidates(scene).persist()
        run = evaluation(frames, scenes.source_frames(spark, scene), preset)
        both = run.ranking.select("model", "overall").join(full_reference(frames, scene), "model").withColumn("seed", F.lit(seed))
        medians = run.features.groupBy("model").pivot("feature").agg(F.percentile("value", F.lit(0.5))).withColumn("seed", F.lit(seed))
        # A row for each candidate comes to the driver.
        rows = pd.concat([rows, both.toPandas()]) if rows is not None else both.toPandas()
        wide = pd.concat([wide, medians.toPandas()]) if wide is not None else medians.toPandas()
        frames.unpersist()
    table = spark.createDataFrame(rows).withColumn("all", F.lit(1)).withColumn("id", F.monotonically_increasing_id())
    total = measures.correlations(table, "overall", "psnr", "all").first()
    pairs = measures.pairwise_accuracy(table, "id", "overall", "psnr", "all").first()
    within = measures.pairwise_accuracy(table, "id", "overall", "psnr", "seed").agg(F.sum(F.col("pairs") * F.col("accuracy")) / F.sum("pairs")).first()[0]
    merged = spark.createDataFrame(rows.merge(wide, on=["model", "seed"]).drop(columns=["seed"]).astype({"overall": float}))
    names = [c for c in merged.columns if c not in ("model", "overall", "psnr", "luma")]
    strongest = {r["feature"]: r["srcc"] for r in report_rules.feature_correlations(merged, "psnr", names).collect()}
    return {"srcc": total["srcc"], "plcc": total["plcc"], "pairwise": pairs["accuracy"], "within_seed": within, "features": strongest, "rows": rows.to_dict("records")}


def detection(spark: SparkSession, defects: tuple[str, ...] = tuple(scenes.TELLS), n: int = 64, preset: str = "standard", tolerance: float = 0.1) -> dict:
    """Each defect in a candidate of its own: is it labelled where it is (recall), and how many labelled windows tell of it (precision)."""
    scene = scenes.Scene(n)
    frames = None
    for d in defects:
        one = scenes.with_defects(spark, scene, (d,), d)
        frames = one if frames is None else frames.unionByName(one)
    run = evaluation(frames.persist(), scenes.source_frames(spark, scene), preset)
    place = {d: scenes.segments(scene.n // 2, (d,))[d] for d in defects}
    truth = spark.createDataFrame([(d, 0, (2 * a + 1) / 120.0, (2 * b + 1) / 120.0, sorted(scenes.TELLS[d])) for d, (a, b) in place.items()], "stream string, seg int, t0 double, t1 double, expected array<string>")
    from .operators.align import overlaps

    worst = run.worst.withColumnRenamed("model", "stream").persist()
    found = {r["stream"] for r in overlaps(worst, truth, tolerance).select("stream").distinct().collect()}
    fits = worst.join(truth.select("stream", "expected"), "stream").agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("labels", "expected")).alias("k")).first()
    recall, precision = len(found) / len(defects), fits["k"] / max(1, fits["n"])
    return {"recall": recall, "precision": precision, "f1": 2 * precision * recall / max(precision + recall, 1e-9), "detected": sorted(found), "windows": fits["n"]}


def benchmark(candidates: dict[str, DataFrame], source: DataFrame | None = None, preset: str = "fast") -> list[dict]:
    """Wall time of each candidate's evaluation, and the speed-up against the first."""
    out: list[dict] = []
    for name, frames in candidates.items():
        began = time.perf_counter()
        overall = evaluation(frames, source, preset).ranking.first()["overall"]
        spent = time.perf_counter() - began
        out.append({"model": name, "overall": overall, "seconds": spent, "speed_up": (out[0]["seconds"] if out else spent) / spent})
    return out
