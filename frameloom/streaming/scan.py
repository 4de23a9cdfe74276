"""Structured Streaming variants of the series operators.

A robust z needs a whole stream's median and isn't incremental; these keep what is: differences to the frame before (a state
of one frame for each stream), and event-time blocks, sliding windows and sessions with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAG_SCHEMA = "stream long, k long, t double, x double, dx double"


def lag_stats(frames: DataFrame) -> DataFrame:
    """``stream, k, t, x, dx`` of a stream of ``stream, t, x``: frames are numbered as they come, by time within a batch; a
    frame that is older than one already numbered is late and left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_t, last_x = state.get if state.exists else (0, float("-inf"), 0.0)
        rows = pd.concat(list(batches)).sort_values("t")
        rows = rows[rows["t"] > last_t].drop_duplicates("t")
        if len(rows):
            before = rows["x"].shift(1)
            before.iloc[0] = last_x if n else rows["x"].iloc[0]
            yield pd.DataFrame({"stream": key[0], "k": range(n, n + len(rows)), "t": rows["t"], "x": rows["x"], "dx": rows["x"] - before})
            n, last_t, last_x = n + len(rows), float(rows["t"].iloc[-1]), float(rows["x"].iloc[-1])
        state.update((n, last_t, last_x))

    return frames.groupBy("stream").applyInPandasWithState(run, LAG_SCHEMA, "n long, t double, x double", "append", GroupStateTimeout.NoTimeout)


def blocks(events: DataFrame, time: str, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean of tumbling (or, with ``slide``, sliding) windows; rows later than ``late`` are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("w.start", "n", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with no gap of ``gap`` or more."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
