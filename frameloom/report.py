"""Report sinks: JSON of a result, a Markdown timeline, a ranking; and the clips' frame ranges of worst windows."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F


def sanitised(x: Any) -> Any:
    """NaN and infinities as null, at any depth."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): sanitised(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [sanitised(v) for v in x]
    return x


def write_json(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(sanitised(report), indent=2))


def timeline(windows: DataFrame, worst: DataFrame) -> DataFrame:
    """``stream, centre, line``: a Markdown table row for each window, with the labels of those that are among the worst."""
    w = worst.select(F.col("stream").alias("s"), F.col("centre").alias("c"), "labels", "severity")
    text = F.format_string("| %d | %.2f | %.2f | %s | %s |", "centre", "start", "end", F.coalesce(F.array_join("labels", ", "), F.lit("")), F.when(F.col("severity").isNotNull(), F.format_string("%.2f", "severity")).otherwise(""))
    return windows.join(w, (F.col("stream") == F.col("s")) & (F.col("centre") == F.col("c")), "left").select("stream", "centre", text.alias("line"))


def clip_frames(frames: DataFrame, worst: DataFrame, pad: float = 0.35, top: int = 12) -> DataFrame:
    """``stream, centre, k, new_k``: the frames of the worst windows' clips, ``pad`` seconds wider, numbered from 0 in each."""
    rank = F.row_number().over(Window.partitionBy("stream").orderBy(F.col("severity").desc(), "centre"))
    chosen = worst.withColumn("r", rank).where(F.col("r") <= top).select(F.col("stream").alias("s"), "centre", (F.col("start") - pad).alias("a"), (F.col("end") + pad).alias("b"))
    cut = frames.join(chosen, (F.col("stream") == F.col("s")) & (F.col("t") >= F.col("a") - 1e-3) & (F.col("t") <= F.col("b")))
    return cut.select("stream", "centre", "k", (F.row_number().over(Window.partitionBy("stream", "centre").orderBy("k")) - 1).alias("new_k"))
