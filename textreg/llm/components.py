"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex of its neighbourhood."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of long ids to ``(id, root)``: the smallest id that each linked id reaches; roots themselves are left out.

    Each round keeps one edge per vertex and smaller neighbourhood, so the table never exceeds the number of
    edges. A round is written to the shared folder; only its row count and checksum reach the driver. Hub
    vertices are reduced before the shuffle by the minimum, and Spark splits their side of the join. Null ids and
    self links are dropped; an empty table gives an empty one.
    """
    now = stage(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = mark
        now = stage(_small_star(_large_star(now)).distinct(), "edges")
