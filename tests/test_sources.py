"""Frames as a video, the source cache and the backends, on small generated sequences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import models
from frameloom.operators import kernels
from frameloom.plans import evaluate
from frameloom.sources import cache, video


@pytest.fixture(scope="module")
def frames(spark):
    return evaluate.candidates(spark, frames=12, size=32).where("model = 'good'").drop("model").persist()


def test_open_and_scan(spark, frames):
    meta = video.open_video(frames)
    assert (meta.n_frames, meta.width, meta.height) == (12, 32, 32) and abs(meta.fps - 120) < 1e-6
    again = frames.unionByName(frames.where("k = 3"))
    assert video.open_video(again).n_frames == 12 and [r.k for r in video.pts_table(again).orderBy("k").collect()] == list(range(12))
    assert video.open_video(frames.withColumn("t", F.lit(None).cast("double"))).fps == pytest.approx(30)
    assert video.open_video(frames.where("k = 0")).fps == 30
    strided = video.iter_frames(frames, 5)
    assert sorted(r.k for r in strided.collect()) == [0, 5, 10]
    with pytest.raises(ValueError):
        video.iter_frames(frames, 0)


def test_widths(frames):
    whole = video.decode_all(frames)
    small = video.decode_all(frames, 16)
    assert small.shape == (12, 16, 16) and np.abs(small.astype(float) - whole.reshape(12, 16, 2, 16, 2).mean(axis=(2, 4))).max() <= 0.5
    assert video.decode_all(frames, 64).shape == (12, 32, 32)
    wide = frames.withColumn("h", F.lit(16)).withColumn("w", F.lit(64))
    assert video.decode_all(wide, 30).shape == (12, 8, 30)  # 7.5 rounds to 8
    assert video.area_resize(np.arange(9.0).reshape(3, 3), 1, 1) == pytest.approx(np.array([[4.0]]))
    assert video.area_resize(np.array([[0.0, 3.0, 6.0]]), 1, 2) == pytest.approx(np.array([[1.0, 5.0]]))


def test_random_access(spark, frames):
    wanted = spark.createDataFrame([(3,), (3,), (7,), (99,)], "k long")
    assert sorted(r.k for r in video.read_frames(frames, wanted).collect()) == [3, 7]
    got = video.read_indices(frames, [7, 3, 3, -1])
    assert [k for k, _ in got] == [3, 7] and np.array_equal(video.read_one(frames, 7), got[1][1])
    assert np.array_equal(video.decode_all(frames)[7], got[1][1])
    with pytest.raises(ValueError):
        video.read_indices(frames, [50])
    times = spark.createDataFrame([(3 / 120 + 0.002,), (5.0,), (0.0,)], "at double")
    assert {(round(r["at"], 6), r["k"]) for r in video.frames_at(frames, times, 120).collect()} == {(0.027, 3), (0.0, 0)}


def test_pairs_are_computed_once(spark, frames, tmp_path):
    store = cache.SourceCache(spark, str(tmp_path), "abc", 32)
    wanted = spark.range(4).withColumnRenamed("id", "pair")
    skip = spark.createDataFrame([(2,)], "pair long")
    assert store.ensure_pairs(frames, wanted, skip) == 3 and store.ensure_pairs(frames, wanted, skip) == 0
    assert sorted(r.pair for r in store.pairs().collect()) == [0, 1, 3]
    assert cache.SourceCache(spark, str(tmp_path), "abc", 32).ensure_pairs(frames, wanted) == 1
    pair = store.get_pair(frames, 1)
    images = video.decode_all(frames).astype(float)
    assert np.abs(pair["f01"] - kernels.dense_flow(images[1], images[2])).max() < 0.05
    occ, conf = kernels.cycle_occlusion(kernels.dense_flow(images[1], images[2]), kernels.dense_flow(images[2], images[1]))
    assert np.array_equal(pair["occ_ab"], occ) and np.abs(pair["conf_ab"] - conf).max() < 0.01 and pair["camera"].shape == (6,)
    assert store.get_pair(frames, 2)["f10"].shape == (32, 32, 2)
    with pytest.raises(KeyError):
        store.get_pair(frames, 11)
    assert cache.is_valid(store.folder) and not cache.is_valid(str(tmp_path)) and cache.read_meta(str(tmp_path)) is None


def test_edges_and_hashes(frames, tmp_path):
    rows = {r.k: r for r in cache.edge_table(frames).collect()}
    image = video.read_one(frames, 4).astype(float)
    assert np.array_equal(np.unpackbits(np.frombuffer(rows[4].edges, np.uint8)).reshape(32, 32).astype(bool), kernels.edges(image))
    path = tmp_path / "a.bin"
    path.write_bytes(b"one")
    first = cache.content_hash(str(path))
    path.write_bytes(b"more")
    assert len(first) == 16 and first != cache.content_hash(str(path))


def test_feature_store(tmp_path):
    store = cache.FeatureStore(str(tmp_path / "s"))
    store.put("a/b", np.arange(5))
    store.put("c", {"x": np.ones(2), "y": np.zeros(1)})
    store.put("d", {"n": 3})
    assert list(store.get("a/b")) == [0, 1, 2, 3, 4] and store.get("c")["x"].tolist() == [1, 1] and store.get("d") == {"n": 3}
    assert store.has("c") and not store.has("e")
    with pytest.raises(KeyError):
        store.get("e")


def test_backends():
    flow = models.get_flow_backend()
    assert flow is models.get_flow_backend()
    x = np.random.default_rng(0).random((32, 32)) * 255
    x = kernels.box(kernels.box(x, 2), 2)
    there, back = flow.flow_pair(x, np.roll(x, 1, 1))
    assert abs(np.median(there[8:-8, 8:-8, 0]) - 1) < 0.3 and abs(np.median(back[8:-8, 8:-8, 0]) + 1) < 0.3
    assert len(flow.flow_many([(x, x)])) == 1 and models.get_vqa_backend() is None
    assert callable(models.get_tracker_backend()) and callable(models.get_segmentation_backend())
    for get, name in ((models.get_flow_backend, "raft"), (models.get_tracker_backend, "cotracker"), (models.get_segmentation_backend, "sam"), (models.get_depth_backend, "auto"), (models.get_vqa_backend, "learned")):
        with pytest.raises(NotImplementedError):
            get(name)
        with pytest.raises(ValueError):
            get("nothing")
