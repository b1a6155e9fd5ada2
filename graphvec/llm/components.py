"""Connected components of links by alternating star contraction, one written table a round.

Each round hangs every vertex's larger neighbours, then its smaller ones, on its smallest; depth
halves at least. Minima are partial aggregates and the joins are plain equi-joins, which adaptive
execution splits for a hub. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.session import write_table


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star, over (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every vertex of ``edges (a, b)``; the component is its smallest
    vertex. Self links and repeated links are harmless; no links give no rows."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")]
    now, seen = write_table(now, "links"), None
    while True:
        mark = tuple(now.agg(*sums).first())
        if mark == seen or not mark[0]:
            break
        seen, now = mark, write_table(_star(now), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
