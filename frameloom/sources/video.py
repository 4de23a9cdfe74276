"""A sequence's frames as a table that is opened, scanned and looked up like a video: rows ``k, t, h, w, luma`` (bytes).

There is no decoder here: frames come from Parquet or from a generating source. Strides, widths and wanted frames are filters and
expressions before any pixel work, so that Spark reads only what is asked for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: The rate where it can't be told, digits of time stamps, and the share of a frame within which a time stamp fits.
DEFAULT_FPS, DIGITS, NEAR = 30.0, 9, 0.6


@dataclass
class VideoMeta:
    n_frames: int
    fps: float
    width: int
    height: int


def pts_table(frames: DataFrame) -> DataFrame:
    """``k, t``: distinct time stamps in order, rounded; frames without any get k / 30."""
    times = frames.select(F.round(F.coalesce(F.col("t").cast("double"), F.col("k") / DEFAULT_FPS), DIGITS).alias("t"), "k").groupBy("t").agg(F.min("k").alias("first"))
    # One row a frame of one sequence, two numbers each.
    return times.select((F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("k"), "t")


def open_video(frames: DataFrame) -> VideoMeta:
    """Number of frames, rate (of the whole span; 30 where it has none) and size, from one aggregate."""
    t = F.round(F.coalesce(F.col("t").cast("double"), F.col("k") / DEFAULT_FPS), DIGITS)
    r = frames.agg(F.countDistinct(t).alias("n"), F.min(t).alias("a"), F.max(t).alias("b"), F.max("w").alias("w"), F.max("h").alias("h")).first()
    return VideoMeta(r["n"], (r["n"] - 1) / (r["b"] - r["a"]) if r["n"] > 1 else DEFAULT_FPS, r["w"] or 0, r["h"] or 0)


def _small_size(h: Column, w: Column, width: int) -> tuple[Column, Column]:
    """Size at ``width``: only wider frames shrink; heights are rounded, and then even, 2 at least."""
    high = F.round(h * width / w).cast("int")
    high = F.greatest(F.lit(2), high - high % 2)
    return F.when(w > width, high).otherwise(h).cast("int"), F.when(w > width, width).otherwise(w).cast("int")


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means: each new pixel is the mean of what it covers, parts of pixels counted by their share."""

    def weights(n: int, m: int) -> np.ndarray:
        low, high = np.arange(m) * n / m, (np.arange(m) + 1) * n / m
        return np.clip(np.minimum(high[:, None], np.arange(1, n + 1)) - np.maximum(low[:, None], np.arange(n)), 0, None) * m / n

    return weights(image.shape[0], h) @ image @ weights(image.shape[1], w).T


def iter_frames(frames: DataFrame, step: int = 1, width: int | None = None) -> DataFrame:
    """Every ``step``-th frame, no wider than ``width``. The stride is a filter that reaches the source."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    out = frames.where(F.col("k") % step == 0) if step > 1 else frames
    if width is None:
        return out
    high, wide = _small_size(F.col("h"), F.col("w"), width)
    out = out.withColumn("h_", high).withColumn("w_", wide)
    names = frames.columns

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate([*names, "h_", "w_"])}
            pixels = []
            for luma, h, w, h2, w2 in zip(col["luma"], col["h"], col["w"], col["h_"], col["w_"], strict=True):
                if (h, w) != (h2, w2):
                    luma = area_resize(np.frombuffer(luma, np.uint8).reshape(h, w).astype(float), h2, w2).round().astype(np.uint8).tobytes()
                pixels.append(luma)
            new = {"luma": pa.array(pixels, pa.binary()), "h": pa.array(col["h_"], pa.int32()), "w": pa.array(col["w_"], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for i, n in enumerate(names)], names)

    fields = ", ".join(f"`{f.name}` {'int' if f.name in ('h', 'w') else f.dataType.simpleString()}" for f in frames.schema.fields)
    return out.select(*names, "h_", "w_").mapInArrow(resize, fields)


def read_frames(frames: DataFrame, wanted: DataFrame, width: int | None = None) -> DataFrame:
    """The frames of ``wanted.k``, each once; numbers that no frame has give none. A semi join, whichever side is larger."""
    return iter_frames(frames.join(wanted.select("k").distinct(), "k", "left_semi"), 1, width)


def read_indices(frames: DataFrame, indices: Iterable[int], width: int | None = None) -> list[tuple[int, np.ndarray]]:
    """Some frames on the driver, in order; an error if there is none of them."""
    asked = sorted(set(indices))
    rows = iter_frames(frames.where(F.col("k").isin(asked)), 1, width).select("k", "h", "w", "luma").orderBy("k").collect()
    if not rows:
        raise ValueError(f"none of the frames {asked[:5]} can be read")
    return [(r["k"], np.frombuffer(r["luma"], np.uint8).reshape(r["h"], r["w"])) for r in rows]


def read_one(frames: DataFrame, index: int, width: int | None = None) -> np.ndarray:
    return read_indices(frames, [index], width)[0][1]


def decode_all(frames: DataFrame, width: int | None = None) -> np.ndarray:
    """All frames as one array, for tests and short clips."""
    rows = iter_frames(frames, 1, width).select("k", "h", "w", "luma").orderBy("k").collect()
    return np.stack([np.frombuffer(r["luma"], np.uint8).reshape(r["h"], r["w"]) for r in rows])


def frames_at(frames: DataFrame, times: DataFrame, fps: float) -> DataFrame:
    """``at`` and the frame (``k, t``) nearest to each time of ``times.at`` within 0.6 of a frame; none gives no row.

    An equi join on time buckets of that width; each time looks in three."""
    near = NEAR / fps
    bucket = F.floor(F.col("at") / near)
    asked = times.select("at").distinct().withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    there = frames.select("k", "t").withColumn("b", F.floor(F.col("t") / near))
    hit = asked.join(there, "b").withColumn("d", F.abs(F.col("t") - F.col("at"))).where(F.col("d") <= near)
    return hit.groupBy("at").agg(F.min(F.struct("d", "k", "t")).alias("m")).select("at", "m.k", "m.t")
