"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of ``edges(u, v)``; loops and null ends are left out.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Each round's links are written to the shared folder;
    only a count and a checksum reach the driver. A node with very many links is a group of an aggregate and of a join that
    Spark can split."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        out = pairs.join(least, "n")
        if large:
            return out.where("m > n").select(F.col("low").alias("u"), F.col("m").alias("v"))
        moved = out.select(F.col("low").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select(F.col("low").alias("u"), F.col("n").alias("v"))).where("u <> v")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(r)

    now = materialise(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    was = state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        spread = star(both(now), True).distinct()
        now = materialise(star(spread.select(F.col("v").alias("n"), F.col("u").alias("m")), False).distinct(), "links")
        if (is_ := state(now)) == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
