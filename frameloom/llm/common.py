"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import shared_dir, written


__all__ = ["fresh", "materialise", "release", "row_key", "shared_dir", "small", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``written``. Where the driver's heap has grown beyond half of its limit, its garbage is collected then: plans, broadcasts
    and shuffles of earlier steps, which many small steps leave behind, and the heap shrinks."""
    found = written(df, name)
    jvm = df.sparkSession.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    return found


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` wrote for this application; results that read them must have been taken before."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, otherwise unchanged; pass a materialised ``df``."""
    fits = df.limit(max_rows + 1).count() <= max_rows if max_rows < 1 << 16 else df.count() <= max_rows
    return (F.broadcast(df) if fits else df), fits


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while base in have:
        base += "_"
    return base


def row_key(text: Column) -> Column:
    """Tells rows of the same id and different texts apart; rows with both equal get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
