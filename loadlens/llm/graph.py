"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import discard, materialize


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every u and its smaller neighbours are hung below the smallest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Self loops, repeated edges and both directions are accepted; a null end makes the edge void; an
    empty table gives an empty table. Each round is written to the shared folder, so neither lineage
    nor driver memory grows; the rounds number about the logarithm of the longest path.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v").distinct()
    now, last = materialize(now, "edges"), None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        flipped = _large_star(now).where("u > v").distinct()
        after = materialize(_small_star(flipped).where("u > v").distinct(), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
