"""Vertex-visit statistics over walks: counts, count-of-counts histogram,
and the log-log points and decade ticks of its plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the plot axis: a -0.1 tick, then decades 10**i for i in
# 0..14 that are below the axis maximum.
FIRST_TICK = -0.1
MAX_DECADE = 14


def visit_counts(walks: DataFrame) -> DataFrame:
    """``(vertex, visits)``: occurrences of each vertex over all walks.
    Partial aggregation happens before the shuffle, so a hub is cheap."""
    return (
        walks.select(F.explode("walk").alias("vertex"))
        .groupBy("vertex")
        .agg(F.count(F.lit(1)).alias("visits"))
    )


def visit_histogram(walks: DataFrame) -> DataFrame:
    """``(number_of_visits, number_of_vertices)``; unvisited vertices absent."""
    return (
        visit_counts(walks)
        .groupBy(F.col("visits").alias("number_of_visits"))
        .agg(F.count(F.lit(1)).alias("number_of_vertices"))
    )


def visit_loglog(hist: DataFrame) -> DataFrame:
    """``(log_visits, log_vertices)`` base-10 logs of the histogram points."""
    return hist.select(
        F.log10(F.col("number_of_visits").cast("double")).alias("log_visits"),
        F.log10(F.col("number_of_vertices").cast("double")).alias("log_vertices"),
    )


def visit_ticks(hist: DataFrame) -> DataFrame:
    """``(axis, tick)`` for axes ``visits`` and ``vertices``: ``-0.1`` plus
    every decade exponent ``i`` in 0..14 with ``10**i`` below the axis max."""
    mx = hist.agg(
        F.max("number_of_visits").alias("visits"), F.max("number_of_vertices").alias("vertices")
    )
    axes = mx.select(
        F.explode(
            F.array(
                F.struct(F.lit("visits").alias("axis"), F.col("visits").alias("mx")),
                F.struct(F.lit("vertices").alias("axis"), F.col("vertices").alias("mx")),
            )
        ).alias("a")
    ).select("a.axis", "a.mx")
    cand = F.array_union(
        F.array(F.lit(FIRST_TICK)),
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(MAX_DECADE)), lambda i: i.cast("double")),
            lambda i: F.pow(F.lit(10.0), i) < F.col("mx").cast("double"),
        ),
    )
    return axes.where(F.col("mx").isNotNull()).select("axis", F.explode(cand).alias("tick"))
