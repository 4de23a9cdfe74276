"""Frame sequences as DataFrames: one row for each frame of a stream, numbered from 0 in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_series(rows: DataFrame, stream: str, time: str, value: str, tie: str) -> DataFrame:
    """``stream, k, t, x``: frames numbered by time (then ``tie``) within each stream; ``t`` in seconds."""
    order = Window.partitionBy(stream).orderBy(time, tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / F.lit(1e6)
    return rows.select(F.col(stream).alias("stream"), (F.row_number().over(order) - 1).cast("long").alias("k"), seconds.alias("t"), F.col(value).alias("x"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_series(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")


def pixel_frames(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """``frame, scene, y, x, v``: the embeddings as small luma frames, one row for each pixel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").cast("long").alias("scene"), F.posexplode("embedding").alias("p", "v"))
    return e.select("frame", "scene", F.floor(F.col("p") / width).cast("long").alias("y"), (F.col("p") % width).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


class _Segment(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _PatternReader(DataSourceReader):
    def __init__(self, options: dict):
        self.frames, self.size, self.seed = int(options.get("frames", 48)), int(options.get("size", 16)), int(options.get("seed", 0))
        self.parts, self.speed = int(options.get("partitions", 4)), float(options.get("speed", 1.0))

    def partitions(self):
        step = max(1, -(-self.frames // self.parts))
        return [_Segment(i, min(self.frames, i + step)) for i in range(0, self.frames, step)]

    def read(self, partition: _Segment):
        import numpy as np

        texture = np.random.default_rng(self.seed).integers(0, 256, (self.size, 4 * self.size)).astype(np.float64)
        for axis in (0, 1, 0, 1):
            texture = (np.roll(texture, 1, axis) + texture + np.roll(texture, -1, axis)) / 3
        texture = np.clip((texture - texture.mean()) * 3 + 128, 0, 255)
        for i in range(partition.begin, partition.end):
            shift = i * self.speed / 2
            whole = int(shift)
            part = shift - whole
            cols = (np.arange(self.size) + whole) % texture.shape[1]
            frame = (1 - part) * texture[:, cols] + part * texture[:, (cols + 1) % texture.shape[1]]
            yield i, i / 120.0, self.size, self.size, frame.round().astype(np.uint8).tobytes()


class PatternSource(DataSource):
    """``format("pattern")``: a texture that moves sideways, a frame a row; partitions are runs of frames."""

    @classmethod
    def name(cls) -> str:
        return "pattern"

    def schema(self) -> str:
        return "frame_idx long, pts double, h int, w int, luma binary"

    def reader(self, schema) -> _PatternReader:
        return _PatternReader(self.options)
