"""A cache of what only depends on the source: motion both ways, hidden pixels and camera of each pair of neighbouring frames, and the
frames' edges, as Parquet tables that candidates share. Only missing pairs are computed, and pairs across cuts never.

A cache's folder is named by the source's identity, the working width, the flow backend and the version, so that neither another
backend nor another version finds its tables."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..models import get_flow_backend
from ..operators import kernels, regions

VERSION = 1
_META = "meta.json"


def content_hash(path: str) -> str:
    """Identity of a file or folder: sha1 of path, size and time of change, 16 digits; not of the content."""
    s = os.stat(path)
    return hashlib.sha1(f"{os.path.abspath(path)}|{s.st_size}|{s.st_mtime_ns}".encode()).hexdigest()[:16]


def read_meta(folder: str) -> dict | None:
    """The cache's description; null if there is none or it can't be read."""
    try:
        return json.loads(Path(folder, _META).read_text())
    except (OSError, ValueError):
        return None


def write_meta(folder: str, meta: dict) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, _META).write_text(json.dumps(meta | {"version": VERSION}))


def is_valid(folder: str) -> bool:
    return (read_meta(folder) or {}).get("version") == VERSION


class FeatureStore:
    """Arrays and JSON values by key, a file each; keys may hold slashes."""

    def __init__(self, root: str):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def _path(self, key: str, suffix: str) -> Path:
        return self.root / (key.replace("/", "__") + suffix)

    def put(self, key: str, value) -> None:
        if isinstance(value, np.ndarray):
            np.save(self._path(key, ".npy"), value)
        elif isinstance(value, dict) and value and all(isinstance(v, np.ndarray) for v in value.values()):
            np.savez_compressed(self._path(key, ".npz"), **value)
        else:
            self._path(key, ".json").write_text(json.dumps(value))

    def get(self, key: str):
        if (p := self._path(key, ".npy")).exists():
            return np.load(p, mmap_mode="r")
        if (p := self._path(key, ".npz")).exists():
            with np.load(p) as found:
                return dict(found)
        if (p := self._path(key, ".json")).exists():
            return json.loads(p.read_text())
        raise KeyError(key)

    def has(self, key: str) -> bool:
        return any(self._path(key, s).exists() for s in (".npy", ".npz", ".json"))


_PAIR = "pair long, h int, w int, f01 binary, f10 binary, occ_ab binary, occ_ba binary, conf_ab binary, conf_ba binary, camera array<double>"


def compute_pairs(frames: DataFrame, pairs: DataFrame, backend: str = "auto") -> DataFrame:
    """The pair table of ``pairs.pair``: each pair's two frames meet in a join and are worked on by themselves."""
    own = frames.select(F.col("k").alias("pair"), "h", "w", F.col("luma").alias("one"))
    after = frames.select((F.col("k") - 1).alias("pair"), F.col("luma").alias("two"))
    both = pairs.select("pair").distinct().join(own, "pair").join(after, "pair").select("pair", "h", "w", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = get_flow_backend(backend)
        for b in batches:
            rows = []
            for h, w, one, two in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                x, y = (np.frombuffer(v, np.uint8).reshape(h, w).astype(float) for v in (one, two))
                f01, f10 = flow.flow_pair(x, y)
                (occ_ab, conf_ab), (occ_ba, conf_ba) = kernels.cycle_occlusion(f01, f10), kernels.cycle_occlusion(f10, f01)
                camera = regions.camera_motion(x, y)[1]
                rows.append((f01.astype(np.float16).tobytes(), f10.astype(np.float16).tobytes(), np.packbits(occ_ab).tobytes(), np.packbits(occ_ba).tobytes(), conf_ab.astype(np.float16).tobytes(), conf_ba.astype(np.float16).tobytes(), np.asarray(camera, float).ravel().tolist()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, pa.binary()) for c in columns[:6]), pa.array(columns[6], pa.list_(pa.float64()))], [f.split()[0] for f in _PAIR.split(", ")])

    return both.mapInArrow(run, _PAIR)


class SourceCache:
    """The pair table of one source in ``root``, filled as pairs are asked for."""

    def __init__(self, spark: SparkSession, root: str, source_hash: str, width: int, backend: str = "auto"):
        self.spark, self.backend = spark, backend
        self.folder = f"{root.rstrip('/')}/{source_hash}-{width}-{get_flow_backend(backend).name}-v{VERSION}"
        if not is_valid(self.folder):
            write_meta(self.folder, {"source": source_hash, "width": width, "backend": get_flow_backend(backend).name})

    def pairs(self) -> DataFrame:
        """All pairs there are."""
        try:
            return self.spark.read.schema(_PAIR).parquet(f"{self.folder}/pairs")
        except AnalysisException:
            return self.spark.createDataFrame([], _PAIR)

    def ensure_pairs(self, frames: DataFrame, wanted: DataFrame, skip: DataFrame | None = None) -> int:
        """Compute the wanted pairs that are missing, without those of ``skip``; returns how many there were."""
        missing = wanted.select("pair").distinct()
        if skip is not None:
            missing = missing.join(skip, "pair", "left_anti")
        missing = missing.join(self.pairs().select("pair"), "pair", "left_anti").persist()
        n = missing.count()
        if n:
            compute_pairs(frames, missing, self.backend).write.mode("append").parquet(f"{self.folder}/pairs")
        missing.unpersist()
        return n

    def get_pair(self, frames: DataFrame, pair: int) -> dict[str, np.ndarray]:
        """One pair's arrays, computed if they are missing."""
        self.ensure_pairs(frames, self.spark.createDataFrame([(pair,)], "pair long"))
        r = self.pairs().where(F.col("pair") == pair).first()
        if r is None:
            raise KeyError(pair)
        shape = (r["h"], r["w"])
        out = {k: np.frombuffer(r[k], np.float16).reshape(*shape, 2).astype(float) for k in ("f01", "f10")}
        out |= {k: np.unpackbits(np.frombuffer(r[k], np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool) for k in ("occ_ab", "occ_ba")}
        return out | {k: np.frombuffer(r[k], np.float16).reshape(shape).astype(float) for k in ("conf_ab", "conf_ba")} | {"camera": np.array(r["camera"])}


def edge_table(frames: DataFrame) -> DataFrame:
    """``k, edges`` (bits) ``, gradient`` (mean) of each frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, means = [], []
            for h, w, luma in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                x = np.frombuffer(luma, np.uint8).reshape(h, w).astype(float)
                bits.append(np.packbits(kernels.edges(x)).tobytes())
                means.append(float(np.hypot(*kernels.sobel(x)).mean()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary()), pa.array(means)], ["k", "edges", "gradient"])

    return frames.select(F.col("k").cast("long"), "h", "w", "luma").mapInArrow(run, "k long, edges binary, gradient double")
