"""Operators against plain Python, and their behaviour on nulls, ties, short and empty inputs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import align, evaluate, fusion, pixels, series, windows
from frameloom.sources.frames import PatternSource

SERIES = "stream long, k long, t double, x double"


def make(spark, xs, step=1.0, stream=1):
    return spark.createDataFrame([(stream, k, k * step, x) for k, x in enumerate(xs)], SERIES)


def median(v):
    v = sorted(v)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_robust_z(spark):
    rng = random.Random(1)
    x = [rng.random() for _ in range(51)]
    m = median(x)
    a = median([abs(v - m) for v in x])
    z = {r.k: r.z_x for r in series.with_robust_z(make(spark, x), ["x"], ["stream"]).collect()}
    assert all(abs(z[k] - (v - m) / (1.4826 * a + 1e-6)) < 1e-9 for k, v in enumerate(x))
    flat = series.with_robust_z(make(spark, [2.0] * 5 + [3.0]), ["x"], ["stream"]).where("k = 5").first().z_x
    assert flat == pytest.approx(1e6, rel=1e-6)


def test_alternation_tells_flicker_from_steady(spark):
    flicker = series.parity_summary(make(spark, [1.0, -1.0] * 40)).first()
    steady = series.parity_summary(make(spark, [1.0] * 80)).first()
    assert flicker.e_pi > 0.8 and steady.e_pi < 0.05 and steady.mean_gap == 0
    assert series.parity_summary(make(spark, [1.0, 2.0, 3.0])).first().mean_gap == 0


def test_series_of_one_and_none(spark):
    one = series.risk_timeline(make(spark, [5.0])).collect()
    assert [(r.k, r.risk) for r in one] == [(0, 0.0)]
    for f in (series.risk_timeline, series.lag_stats, series.parity_summary, series.scene_cuts, windows.uniform_centres):
        assert f(make(spark, [])).count() == 0


def test_nms_is_greedy(spark):
    rng = random.Random(2)
    v = [rng.choice([0.0, 1.0, 2.0, rng.random() * 3, -1.0]) for _ in range(120)]
    s = make(spark, v).withColumnRenamed("x", "risk")
    got = sorted(r.k for r in windows.temporal_nms(s, 7, 4.0).collect())
    taken = []
    for k in sorted((k for k in range(120) if v[k] > 0), key=lambda k: (-v[k], k)):
        if len(taken) < 7 and all(abs(k - o) >= 4 for o in taken):
            taken.append(k)
    assert got == sorted(taken)
    assert windows.temporal_nms(make(spark, [0.0, -1.0]).withColumnRenamed("x", "risk")).count() == 0


def test_windows_need_all_their_frames(spark):
    s = make(spark, [float(k) for k in range(20)])
    centres = windows.uniform_centres(s, 3)
    assert sorted(r.k for r in centres.collect()) == [3, 9, 17]
    missing = s.where("k <> 8")
    assert {r.centre for r in windows.explode_windows(centres, missing).collect()} == {3, 17}


def test_offsets(spark):
    source = spark.createDataFrame([(1, i, i / 60, 0.0) for i in range(20)], "stream long, i long, t double, x double")
    for off in (-1, 0, 2):
        candidate = spark.createDataFrame([(1, k, (k - off) / 120, 0.0) for k in range(40)], SERIES)
        best = align.best_offset(align.offset_errors(source, candidate)).first()
        assert best.off == off and best.err < 1e-9
        pairs = {r.k: (r.anchor, r.pair) for r in align.anchor_pairs(candidate, align.best_offset(align.offset_errors(source, candidate)), source).collect()}
        assert pairs[10 + off] == (5, None) and pairs[11 + off] == (None, 5)


def test_nearest_within(spark):
    left = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 5.0, 0.0), (1, 2, None, 0.0)], SERIES)
    right = spark.createDataFrame([(1, 0, 1.4), (1, 1, 0.6), (1, 2, 5.51), (2, 3, 5.0)], "stream long, i long, t double")
    assert [(r.k, r.match) for r in align.nearest_within(left, right, 0.5).collect()] == [(0, 0)]


def test_errors_and_scores(spark):
    dim = fusion.feature_dim(spark)
    f = spark.createDataFrame([("comp_mean", 0.18), ("edge_recall", 0.3), ("gtq_sharp_odd_even_ratio", 0.5), ("gtq_blockiness", 1.6), ("comp_mean", math.nan), ("comp_mean", None), ("no_such", 1.0)], "feature string, value double")
    e = [r.error for r in fusion.normalise(f, dim).orderBy(F.col("feature"), F.col("value").asc_nulls_last()).collect()]
    one = 1 - math.exp(-1)
    assert e[0] == pytest.approx(one) and e[1] is None and e[2] is None and e[3] == pytest.approx(1.0) and e[4] == pytest.approx(one) and e[5] == 1.5 and e[6] is None
    c = spark.createDataFrame([(1, "motion", 0.2), (1, "temporal", 0.4), (1, "structure", 0.1), (1, "character", 0.5), (1, "thin_weapon", 0.7), (2, "motion", 0.2)], "model long, category string, error double")
    got = {r.model: r.overall for r in fusion.overall_scores(c, ["model"]).collect()}
    assert got[1] == pytest.approx(fusion.score_formula({"motion": 0.2, "temporal": 0.4, "structure": 0.1, "character": 0.5, "thin_weapon": 0.7})) and got[2] is None
    assert math.isnan(fusion.score_formula({"motion": 0.1}))
    assert len(fusion.REGISTRY) == 66


def test_worse_errors_score_lower(spark):
    rows = [(m, w, "motion", m * 0.1 + 0.001 * w) for m in range(5) for w in range(10)]
    rows += [(m, w, c, 0.1) for m in range(5) for w in range(10) for c in ("temporal", "structure")]
    e = spark.createDataFrame(rows, "model long, window long, category string, error double")
    cats = fusion.aggregate_categories(fusion.category_errors(e, ["model"]), ["model"])
    scores = [r.overall for r in fusion.overall_scores(cats, ["model"]).orderBy("model").collect()]
    assert scores == sorted(scores, reverse=True)
    ranks = [r.model for r in fusion.rank_models(fusion.overall_scores(cats, ["model"]), "model").orderBy("rank").collect()]
    assert ranks == [0, 1, 2, 3, 4]


def test_validation(spark):
    d = spark.createDataFrame([(i, float(i), float(i * i), i % 2) for i in range(10)], "id long, a double, b double, g int")
    assert all(r.srcc == pytest.approx(1) for r in evaluate.correlations(d, "a", "b", "g").collect())
    acc = evaluate.pairwise_accuracy(spark.createDataFrame([(1, 1.0, 1, 0), (2, 2.0, 2, 0), (3, 2.0, 3, 0)], "id long, s double, q int, g int"), "id", "s", "q", "g").first()
    assert (acc.pairs, acc.accuracy) == (3, pytest.approx(2 / 3))
    none = evaluate.detection(spark.createDataFrame([(False, False, 1)], "p boolean, a boolean, g int"), "p", "a", "g").first()
    assert none.precision is None and none.f1 is None


def frames(spark, images):
    return spark.createDataFrame([(f, 0, y, x, float(v)) for f, im in enumerate(images) for y, row in enumerate(im) for x, v in enumerate(row)], "frame long, scene long, y long, x long, v double")


def test_warps_undo_each_other(spark):
    image = [[x + 8 * y for x in range(8)] for y in range(8)]
    moved = pixels.forward_splat(frames(spark, [image]), 2.0, 1.0)
    assert all(r.v == image[r.y - 1][r.x - 2] for r in moved.collect())
    back = {(r.y, r.x): r.v for r in pixels.backward_warp(moved.select("frame", F.lit(0).alias("scene"), "y", "x", "v").unionByName(frames(spark, [image]).where("x < 2 OR y < 1")), 2.0, 1.0).collect()}
    assert all(back[y, x] == image[y][x] for y in range(7) for x in range(6))


def test_pixel_statistics(spark):
    a, b = [[0.0] * 8 for _ in range(8)], [[0.5] * 8 for _ in range(8)]
    p = frames(spark, [a, b, a])
    assert [r.psnr for r in pixels.psnr(p).orderBy("frame").collect()] == [pytest.approx(10 * math.log10(4))] * 2
    assert pixels.alpha_blend(frames(spark, [a, [[0.25] * 8 for _ in range(8)], b])).first().alpha == pytest.approx(0.5, abs=1e-4)
    assert {r.sharpness for r in pixels.sharpness(p).collect()} == {0.0}
    assert pixels.psnr(frames(spark, [a])).count() == 0


def test_pattern_source(spark):
    spark.dataSource.register(PatternSource)
    df = spark.read.format("pattern").option("frames", "12").option("partitions", "3").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 12 and df.where("length(luma) = h * w").count() == 12
