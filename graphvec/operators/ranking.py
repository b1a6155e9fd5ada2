"""Skew-safe positional numbering.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends a whole key group
to one task; a hub vertex holding a third of all edges would then be sorted
by a single core. Here the rows are range-partitioned on the full sort key,
so a hot key is spread over as many tasks as its size needs. Each task
numbers its rows locally (``monotonically_increasing_id`` after the sort),
and a tiny table of per-(partition, key) counts supplies the offsets.

The sort key ``(key, *order)`` should be unique for the spread to be perfect
(identical sort keys cannot be split by a range partitioner); callers with
duplicate rows add a duplicate counter first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphvec.session import drop_table, write_table

_PID, _MID, _CNT, _FIRST, _OFF = "_gv_pid", "_gv_mid", "_gv_cnt", "_gv_first", "_gv_off"


# Catalyst's size estimate a range partition may stand for; a floor on top of
# spark.sql.shuffle.partitions, so that a small setting cannot make one task
# sort hundreds of GB. Sizing only: the numbers do not depend on it.
BYTES_PER_PARTITION = 256 * 1024 * 1024
MAX_PARTITIONS = 100_000


_NARROW = {"Project", "Filter"}


def _scan_only(df: DataFrame) -> bool:
    """Is ``df`` a filter or projection of files?"""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in _NARROW:
        node = node.children().head()
    return node.children().isEmpty() and "Relation" in node.nodeName()


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Partitions for a frame that reads files: Catalyst's estimate is then the files' size. (Over a
    join it is the product of both sides.)"""
    if num_partitions:
        return int(num_partitions)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, min(MAX_PARTITIONS, -(-size // BYTES_PER_PARTITION)))


def index_within(
    df: DataFrame,
    key: str | None,
    order: Sequence[str],
    *,
    out: str = "idx",
    size_out: str | None = None,
    num_partitions: int | None = None,
    forget: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the 0-based position of each row in its ``key`` group
    (whole frame if ``key`` is None) when sorted by ``order`` ascending.
    Optionally add ``size_out``: the size of the row's group. Columns of
    ``order`` in ``forget`` sort only; they are not in the result.

    The sorted, tagged rows are written to the checkpoint folder before
    numbering, so the partition ids the numbering relies on cannot change on
    a retry.
    """
    keys = [key] if key else []
    made = not _scan_only(df)
    if made:
        # A range partitioner reads its input twice (sample, sort), and only files have a known size.
        df = write_table(df, "unranked")
    n = _partitions(df, num_partitions)
    sort_cols = [*keys, *order]
    tagged = write_table(
        df.repartitionByRange(n, *sort_cols)
        .sortWithinPartitions(*sort_cols)
        .drop(*forget)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id()),
        "ranked",
    )
    if made:
        drop_table(df)
    blocks = tagged.groupBy(_PID, *keys).agg(
        F.count(F.lit(1)).alias(_CNT), F.min(_MID).alias(_FIRST)
    )
    # One row per (task, key): at most partitions + distinct keys rows, and a
    # key's window holds at most `n` rows however hot the key is.
    w = Window.partitionBy(*keys).orderBy(_PID) if keys else Window.orderBy(_PID)
    offs = [
        F.coalesce(
            F.sum(_CNT).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias(_OFF)
    ]
    if size_out:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        offs.append(F.sum(_CNT).over(whole).alias(size_out))
    blocks = blocks.select(_PID, *keys, _FIRST, *offs)
    if not keys:
        # at most `n` rows: a proven bound, safe to broadcast
        blocks = F.broadcast(blocks)
    joined = tagged.join(blocks, [_PID, *keys])
    cols = [c for c in df.columns if c not in forget]
    extra = [F.col(size_out)] if size_out else []
    return joined.select(
        *cols,
        (F.col(_OFF) + F.col(_MID) - F.col(_FIRST)).cast("bigint").alias(out),
        *extra,
    )


def running_total(df: DataFrame, order: Sequence[str], value: str, *, out: str = "before") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``order`` (unique). Range partitions add up
    their own rows; their totals, one row for each partition, give the offsets."""
    made = not _scan_only(df)
    df = write_table(df, "unranked") if made else df
    n = _partitions(df, None)
    tagged = write_table(df.repartitionByRange(n, *order).withColumn(_PID, F.spark_partition_id()), "ranked")
    if made:
        drop_table(df)
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(_PID).agg(F.sum(value).alias(_CNT))
    totals = totals.select(_PID, F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    inside = Window.partitionBy(_PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = tagged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(F.broadcast(totals), _PID)  # at most ``n`` rows
    return joined.select(*df.columns, (F.col(out) + F.col(_OFF)).cast("bigint").alias(out))


def global_index(
    df: DataFrame, order: Sequence[str], *, out: str = "idx", num_partitions: int | None = None, forget: Sequence[str] = ()
) -> DataFrame:
    """0-based rank of every row in ``order`` (ascending; wrap names with
    a descending helper column to sort the other way) without a single-task
    global window."""
    return index_within(df, None, order, out=out, num_partitions=num_partitions, forget=forget)
