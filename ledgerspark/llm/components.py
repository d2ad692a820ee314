"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour or itself, joined to its edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _least(edges.where("u > v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node with an edge but the roots.

    ``edges``: columns u, v (bigint). Each round is a table in the shared folder;
    rounds end when one changes nothing. Nothing comes to the driver but a count
    and a checksum. Loops and repeated edges are harmless.
    """

    def sorted_pairs(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def written(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        """The table, and its count and checksum, taken while it is written."""
        seen = Observation()
        table = scratch.write(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), f"{name}-{k}")
        return table, (seen.get["n"], seen.get["sum"])

    k = 0
    now, before = written(sorted_pairs(edges), k)
    while before[0]:
        k += 1
        now, after = written(sorted_pairs(_small_star(sorted_pairs(_large_star(now)))), k)
        scratch.drop(f"{name}-{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
