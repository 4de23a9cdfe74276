"""Kernels against analytic cases, the evaluation plan on damaged sequences, streaming, calibration and reports."""

from __future__ import annotations

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from frameloom import report
from frameloom.operators import kernels
from frameloom.operators.calibrate import MonotonicCalibrator
from frameloom.plans import evaluate
from frameloom.streaming import scan


def moving(size=64, step=1.5, n=5, seed=0):
    texture = kernels.box(np.random.default_rng(seed).integers(40, 200, (size, 4 * size)).astype(float), 1) * 1.5

    def at(s):
        w = int(s)
        return (1 - s + w) * texture[:, w : w + size] + (s - w) * texture[:, w + 1 : w + size + 1]

    return at, [at(20 + step * i) for i in range(n)]


def test_warp_and_splat():
    image = np.add.outer(np.arange(12.0), 3 * np.arange(16.0))
    flow = np.zeros((12, 16, 2))
    flow[..., 0], flow[..., 1] = 1.5, 0.5
    inside = kernels.backward_warp(image, flow)[:-1, :-2]
    assert np.allclose(inside, (image + 0.5 + 4.5)[:-1, :-2])
    splat, weight = kernels.forward_splat(image, -flow)
    assert np.allclose(splat[2:-2, 2:-3], (image + 0.5 + 4.5)[2:-2, 2:-3]) and (weight >= 0).all()
    assert np.allclose(kernels.compose(flow, -flow), 0)


def test_flow_and_occlusion():
    at, _ = moving()
    flow = kernels.dense_flow(at(10), at(13))
    assert abs(np.median(flow[8:-8, 8:-8, 0]) + 3) < 0.1 and abs(np.median(flow[8:-8, 8:-8, 1])) < 0.1
    occluded, confidence = kernels.cycle_occlusion(flow, kernels.dense_flow(at(13), at(10)))
    assert occluded[8:-8, 8:-8].mean() < 0.1 and confidence[8:-8, 8:-8].mean() > 0.8


def test_distance_and_edges():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert np.allclose(kernels.distance(mask), np.hypot(*np.meshgrid(np.arange(-4, 5), np.arange(-4, 5))))
    image = np.zeros((20, 20))
    image[:, 10:] = 200
    assert set(np.flatnonzero(kernels.edges(image).any(axis=0))) <= {9, 10}
    assert not kernels.edges(np.zeros((20, 20))).any()


def test_defects_show_in_their_features():
    at, good = moving()
    mids = {"ghost": lambda i: (at(20 + 1.5 * (i - 1)) + at(20 + 1.5 * (i + 1))) / 2, "freeze": lambda i: at(20 + 1.5 * (i - 1)), "blur": lambda i: kernels.box(kernels.box(good[i], 2), 2)}
    features = {"good": kernels.window_features(good)}
    for kind, mid in mids.items():
        features[kind] = kernels.window_features([mid(i) if i % 2 == 0 else good[i] for i in range(5)])
    assert features["freeze"]["freeze_copy_score"] > 0.5 > features["good"]["freeze_copy_score"]
    assert features["freeze"]["comp_leg_ratio"] > 0.4 > features["good"]["comp_leg_ratio"]
    assert features["blur"]["parity_window_sharp_gap"] > 3 * features["good"]["parity_window_sharp_gap"]
    assert features["ghost"]["cycle_resid_mean"] > 3 * features["good"]["cycle_resid_mean"]
    assert features["blur"]["edge_recall"] < features["ghost"]["edge_recall"] < features["good"]["edge_recall"]


def test_good_candidate_wins(spark):
    frames = evaluate.candidates(spark, frames=40).persist()
    rows = {r.model: r for r in evaluate.evaluate(frames).collect()}
    assert rows["good"].rank == 1 and all(rows[k].overall < rows["good"].overall - 3 for k in ("freeze", "blur", "ghost"))
    assert all(r.status == "ok" and 0.05 <= r.confidence <= 1 for r in rows.values())
    with pytest.raises(ValueError, match="unknown preset"):
        evaluate.evaluate(frames, "no such")


def test_evaluation_against_a_source(spark):
    frames = evaluate.candidates(spark, frames=48).persist()
    source = frames.where("model = 'good' AND k % 2 = 0").select((F.col("k") / 2).cast("long").alias("k"), "t", "h", "w", "luma")
    late = frames.where("model = 'good'").select(F.lit("late").alias("model"), (F.col("k") + 1).alias("k"), "t", "h", "w", "luma").where("k < 48")
    late = late.withColumn("t", F.col("k") / 120.0)
    found = evaluate.evaluation(frames.unionByName(late), source)
    aligned = {r.stream: r for r in found.alignment.collect()}
    assert all(r.off == 0 and abs(r.ratio - 2) < 0.1 and r.warnings == "" for r in aligned.values())
    features = {(r.model, r.feature): r.value for r in found.features.where("window IS NULL").collect()}
    assert features["good", "anchor_y_l1_p90"] == 0 and features["late", "anchor_y_l1_p90"] > 3 and features["late", "anchor_shift_better_frac"] > 0
    assert features["blur", "parity_sharp_mean_gap"] > features["good", "parity_sharp_mean_gap"]
    rows = {r.model: r for r in found.ranking.collect()}
    assert rows["good"].rank == 1 and rows["late"].overall < rows["good"].overall
    assert {r.source for r in found.windows.collect()} <= {"uniform", "risk", "uniform+risk"}
    worst = found.worst.collect()
    labels = {m: {x for r in worst if r.model == m for x in r.labels} for m in rows}
    assert "freeze_copy" in labels["freeze"] and "freeze_copy" not in labels["good"]
    assert all(0 < r.severity <= 1 and 1 <= len(r.labels) <= 4 and r.start <= r.end for r in worst)


def test_command_line(spark, tmp_path, capsys):
    from frameloom import cli

    frames = evaluate.candidates(spark, frames=32).persist()
    frames.where("model = 'good'").drop("model").write.parquet(str(tmp_path / "one.parquet"))
    frames.where("model = 'freeze'").write.parquet(str(tmp_path / "two.parquet"))
    frames.where("model = 'good' AND k % 2 = 0").drop("model").withColumn("k", (F.col("k") / 2).cast("long")).write.parquet(str(tmp_path / "source.parquet"))
    paths = ["--candidate", str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet"), "--source", str(tmp_path / "source.parquet"), "--out", str(tmp_path / "out")]
    assert cli.main(["compare", *paths]) == 0
    ranking = json.loads((tmp_path / "out/ranking.json").read_text())["ranking"]
    assert [r["model"] for r in ranking] == ["one", "freeze"]
    assert cli.main(["evaluate", *paths, "--labels", "a", "b"]) == 0
    found = json.loads((tmp_path / "out/b/report.json").read_text())
    assert found["overall"] < 100 and any("freeze_copy" in w["type"] for w in found["worst_windows"]) and "comp_mean" in found["features"]
    assert (tmp_path / "out/a/timeline.md").read_text().startswith("| centre")
    with pytest.raises(SystemExit):
        cli.main(["compare", *paths, "--labels", "a"])


def test_evaluation_without_windows_fails_closed(spark):
    frames = evaluate.candidates(spark, frames=3).where("model = 'good'")
    row = evaluate.evaluate(frames).collect()[0]
    assert row.overall is None and row.status == "failed"


def test_streaming_matches_batch(spark, tmp_path):
    schema = "stream long, t double, x double"
    for i, part in enumerate([[(1, 0.0, 1.0), (1, 1.0, 3.0), (2, 0.5, 7.0)], [(1, 2.0, 2.0), (1, 1.5, 9.0), (1, 0.5, 8.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = scan.lag_stats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, i
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 0.5 comes too late for stream 1.
    assert got == {(1, 0, 0.0, 1.0, 0.0), (1, 1, 1.0, 3.0, 2.0), (2, 0, 0.5, 7.0, 0.0), (1, 2, 1.5, 9.0, 6.0), (1, 3, 2.0, 2.0, -7.0)}


def test_streaming_blocks_plan(spark):
    rate = spark.readStream.format("rate").load()
    assert scan.blocks(rate, "timestamp", "value", "1 minute", "30 seconds").isStreaming
    assert scan.sessions(rate, "timestamp", "value", "1 minute").isStreaming and scan.deduplicated(rate, "timestamp", ["value"]).isStreaming


def test_calibrator_is_monotone(tmp_path, spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 3))
    c = MonotonicCalibrator(["a", "b", "c"]).fit(x, 90 - 40 * x[:, 0] - 5 * x[:, 1] + 20 * x[:, 2])
    assert (c.weights <= 0).all() and abs(c.weights[0] + 40) < 4
    assert c.predict({"a": 0.9}) < c.predict({"a": 0.1})
    worse = np.clip(x + rng.random((200, 3)) * 0.3, 0, 2)
    p = MonotonicCalibrator(["a", "b", "c"]).fit_pairwise(x, worse)
    assert (p.weights <= 0).all() and p.predict({"a": 1.0}) < p.predict({}) == 50.0
    p.save(str(tmp_path / "c.json"))
    assert MonotonicCalibrator.load(str(tmp_path / "c.json")).predict({"a": 1.0}) == p.predict({"a": 1.0})


def test_reports(spark, tmp_path):
    report.write_json({"a": float("nan"), "b": [1.0, float("inf")], "c": {"d": 2}}, str(tmp_path / "x" / "r.json"))
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == {"a": None, "b": [1.0, None], "c": {"d": 2}}
    windows = spark.createDataFrame([(1, 3, 0.0, 0.5), (1, 9, 1.0, 1.5)], "stream long, centre long, start double, end double")
    worst = spark.createDataFrame([(1, 9, 1.0, 1.5, ["motion", "ui"], 0.7)], "stream long, centre long, start double, end double, labels array<string>, severity double")
    assert sorted(r.line for r in report.timeline(windows, worst).collect()) == ["| 3 | 0.00 | 0.50 |  |  |", "| 9 | 1.00 | 1.50 | motion, ui | 0.70 |"]
    frames = spark.createDataFrame([(1, k, k * 0.1) for k in range(30)], "stream long, k long, t double")
    assert [r.k for r in report.clip_frames(frames, worst).orderBy("new_k").collect()] == list(range(7, 19))
