"""The generated scene, its defects and sets, and whether scores and labels agree with what is known of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import validation
from frameloom.plans.evaluate import evaluation
from frameloom.sources import scene as scenes


@pytest.fixture(scope="module")
def scene():
    return scenes.Scene(40, 64, 96)


def test_frames_move_smoothly(scene):
    frames = [scene.frame(k) for k in range(6)]
    steps = [np.abs(a - b).mean() for a, b in zip(frames, frames[1:], strict=False)]
    assert min(steps) > 0.3 and max(steps) < 25 and frames[0].shape == (64, 96)
    assert np.array_equal(scenes.Scene(40, 64, 96).frame(3), scene.frame(3)) and not np.array_equal(scenes.Scene(40, 64, 96, seed=8).frame(3), scene.frame(3))


def test_each_defect_changes_its_place(scene):
    for d in scenes.DEFECTS:
        ks = [k for k in (9, 11) if np.abs(scenes.damaged(scene, k, d) - scene.frame(k)).max() > 3]
        assert ks == ([9, 11] if d != "sword_flicker" else [9]), d
    at = scene.layout(9)
    x0, y0, x1, y1 = at.panel
    change = np.abs(scenes.damaged(scene, 9, "ui_drift") - scene.frame(9)) > 1
    assert change.any() and not change[y1 + 1 :].any()
    head = np.argwhere(np.abs(scenes.damaged(scene, 9, "head_erase") - scene.frame(9)) > 1)
    assert np.abs(head.mean(axis=0) - (at.figure[1] - at.head, at.figure[0])).max() < 6
    assert np.array_equal(scenes.damaged(scene, 9, "freeze"), scene.frame(8))
    with pytest.raises(ValueError):
        scenes.damaged(scene, 9, "nothing")


def test_sets(spark, scene):
    assert scenes.segments(20, ("blur", "ghost")) == {"blur": (6, 10), "ghost": (12, 16)}
    bad = {r.k: r for r in scenes.with_defects(spark, scene, ("freeze",), "bad").collect()}
    clean = {r.k: r for r in scenes.good(spark, scene).collect()}
    a, b = scenes.segments(20, ("freeze",))["freeze"]
    assert {k for k in clean if bad[k].luma != clean[k].luma} == {2 * i + 1 for i in range(a, b)}
    source = {r.k: r for r in scenes.source_frames(spark, scene).collect()}
    assert len(source) == 20 and all(source[i].luma == clean[2 * i].luma and abs(source[i].t - clean[2 * i].t) < 1e-9 for i in source)
    gone = {r.k: r for r in scenes.dropped(spark, scene).collect()}
    assert len(gone) == 37 and gone[10].luma == clean[11].luma
    shifted = {r.k: r for r in scenes.late(spark, scene).collect()}
    assert shifted[0].luma == clean[0].luma and shifted[9].luma == clean[8].luma
    times = [r.t for r in scenes.alternating(spark, scene).orderBy("k").collect()]
    assert np.allclose(np.diff(times)[:4], [1 / 112, 1 / 130, 1 / 112, 1 / 130])
    other = scenes.Scene(40, 64, 96, seed=99)
    cut = {r.k: r for r in scenes.scene_cut(spark, scene, other).collect()}
    assert cut[5].luma == clean[5].luma and cut[30].luma == np.clip(other.frame(30), 0, 255).round().astype(np.uint8).tobytes()


def test_cut_pairs_have_no_windows(spark, scene):
    frames = scenes.scene_cut(spark, scene, scenes.Scene(40, 64, 96, seed=99)).persist()
    windows = evaluation(frames).windows.collect()
    assert windows and not any(r.centre in (19, 21) for r in windows)


def test_interpolators_are_ranked(spark):
    found = validation.ranking_agreement(spark, lambda s: scenes.interpolator_ladder(spark, s), seeds=(7,), n=32)
    score = {r["model"]: r["overall"] for r in found["rows"]}
    assert score["perfect"] > score["flow"] and score["perfect"] > score["linear"]
    assert found["pairwise"] >= 0.6 and found["srcc"] >= 0.5 and found["features"]


def test_defects_are_found(spark):
    found = validation.detection(spark, ("blur", "freeze", "ghost"), n=48, preset="fast")
    assert found["recall"] >= 0.6 and 0 <= found["precision"] <= 1 and found["f1"] >= 0.5


def test_benchmark(spark, scene):
    frames = scenes.good(spark, scenes.Scene(16, 32, 48)).persist()
    rows = validation.benchmark({"a": frames, "b": frames})
    assert [r["model"] for r in rows] == ["a", "b"] and rows[0]["speed_up"] == 1 and rows[1]["speed_up"] > 0
    assert frames.where(F.col("k") == 0).count() == 1
