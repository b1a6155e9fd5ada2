"""Edge-table operators: symmetrize, canonical edges, degree, vertex set,
chunked adjacency and the indexed adjacency the walks join against.

An edge table is any DataFrame with BIGINT columns ``src`` and ``dst``.
Edges are unweighted; repeated rows are multi-edges and weight transitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.operators.ranking import global_index, index_within
from graphvec.session import drop_table, write_table


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) becomes (a, b) and (b, a) in a single scan; a
    self-loop therefore appears twice, multi-edges keep their count."""
    pair = F.explode(
        F.array(
            F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
            F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
        )
    ).alias("e")
    return edges.select(pair).select("e.src", "e.dst")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected drawing view: one row per pair with ``src <= dst`` and its
    multiplicity. On a symmetrized table a self-loop counts twice."""
    return (
        edges.where(F.col("src") <= F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("multiplicity"))
    )


def degree(edges: DataFrame) -> DataFrame:
    """Out-degree (multi-edges counted) of every vertex with an out-edge."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct union of both edge ends, from one scan."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


# Copies of one edge that one array may list before it is exploded.
_DUP_BLOCK = 4096
#: Numbers that the copies of an edge are spread by; tasks that it can lie in.
_SPREAD = 4096
#: Slots of a row of ``WalkGraph.blocks``.
BLOCK_SLOTS = 256


def _with_dup_counter(edges: DataFrame) -> DataFrame:
    """Collapse duplicates, then re-expand with a counter so every row has a
    unique sort key (a range partitioner can then split any hot vertex). The
    counter is expanded in two steps, so that an edge repeated m times needs
    arrays of m / _DUP_BLOCK and _DUP_BLOCK numbers."""
    size = F.lit(_DUP_BLOCK).cast("bigint")
    blocks = (
        edges.groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("_mult"))
        .select(
            "src", "dst", "_mult",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_mult - 1) div {_DUP_BLOCK}"))).alias("_b"),
        )
    )
    return blocks.select(
        "src", "dst",
        F.explode(
            F.sequence(F.col("_b") * size, F.least(F.col("_b") * size + size, F.col("_mult")) - 1)
        ).alias("_dup"),
    )


def indexed_neighbours(edges: DataFrame, *, num_partitions: int | None = None) -> DataFrame:
    """``(src, idx, dst, degree)``: neighbours of each vertex ordered by id
    (duplicates included) and numbered from 0, plus the vertex's out-degree.
    Materialized; numbering is skew-safe (see ``ranking``)."""
    ranked = index_within(
        _with_dup_counter(edges),
        "src",
        ["dst", "_dup"],
        out="idx",
        size_out="degree",
        num_partitions=num_partitions,
    )
    return ranked.select("src", "idx", "dst", "degree")


def adjacency(
    edges: DataFrame, *, chunk_size: int = 1024, num_partitions: int | None = None
) -> DataFrame:
    """Neighbour arrays ``(src, chunk, neighbors)``: neighbours ordered by id,
    cut into chunks of at most ``chunk_size`` so no row (and no task) has to
    hold the whole neighbourhood of a hub. Concatenating a vertex's chunks in
    ``chunk`` order gives its full sorted neighbour list."""
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive")
    nb = indexed_neighbours(edges, num_partitions=num_partitions)
    return (
        nb.groupBy("src", (F.col("idx") / chunk_size).cast("bigint").alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "dst"))).alias("_n"))
        .select("src", "chunk", F.transform("_n", lambda x: x["dst"]).alias("neighbors"))
    )


@dataclass(frozen=True)
class WalkGraph:
    """Everything a walk step joins against.

    ``edges``: ``(slot, src, dst)``, one row per directed edge. Edges are laid out in ``(src, dst)``
    order and numbered globally, so the neighbours of ``v`` occupy slots
    ``first(v) .. first(v)+degree(v)-1`` and a walker at ``v`` that draws ``k`` moves along slot
    ``first(v)+k``.

    ``blocks``: ``(block, lo, hi, dsts)``, the same edges packed: ``dsts`` are the neighbours on slots ``lo``
    to ``hi - 1``, all with ``slot div BLOCK_SLOTS = block``. A step that joins on ``block`` handles a row for
    ``BLOCK_SLOTS`` edges. (A block that lies in two tasks' rows has a row of each.)

    ``slots``: ``edges`` with ``dst_first``/``dst_degree`` (-1 and 0 for a sink). Joined when it is read.

    ``starts``: ``(vertex, first, degree)`` for every vertex with an out-edge.
    ``num_slots``: exact row count of ``edges`` (the broadcast size check).
    ``num_starts``: exact row count of ``starts`` (sizes the walker tables).
    """

    edges: DataFrame
    blocks: DataFrame
    starts: DataFrame
    num_slots: int
    num_starts: int

    @property
    def slots(self) -> DataFrame:
        target = self.starts.select(
            F.col("vertex").alias("dst"),
            F.col("first").alias("dst_first"),
            F.col("degree").alias("dst_degree"),
        )
        # A hub is a hot key on the edge side; AQE's skew join splits such partitions (a left
        # outer join may split its left side), and a small ``starts`` table is broadcast instead.
        return self.edges.join(target, "dst", "left").select(
            "slot",
            "src",
            "dst",
            F.coalesce("dst_first", F.lit(-1)).cast("bigint").alias("dst_first"),
            F.coalesce("dst_degree", F.lit(0)).cast("bigint").alias("dst_degree"),
        )


def _pack(block_slots: int):
    """mapInArrow body: rows ``(slot, dst)`` as blocks, cut where the slots are not consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column("slot").to_numpy()
            if not len(slot):
                continue
            cut = (slot[1:] != slot[:-1] + 1) | (slot[1:] % block_slots == 0)
            edge = np.r_[0, np.flatnonzero(cut) + 1, len(slot)]
            lo = slot[edge[:-1]]
            dsts = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), b.column("dst"))
            columns = [pa.array(lo // block_slots), pa.array(lo), pa.array(lo + np.diff(edge)), dsts]
            yield pa.RecordBatch.from_arrays(columns, ["block", "lo", "hi", "dsts"])

    return run


def walk_graph(edges: DataFrame, *, num_partitions: int | None = None) -> WalkGraph:
    """Build and write the walk tables. Rows of one edge are alike, so any small number (here of the read
    row) lets the range partitioner split a hot vertex or edge without another shuffle to count copies."""
    stored = write_table(edges.select("src", "dst"), "edges")
    spread = stored.withColumn("_row", F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)).cast("short"))
    ranked = global_index(spread, ["src", "dst", "_row"], out="slot", num_partitions=num_partitions, forget=["_row"]).select("slot", "src", "dst")
    drop_table(stored)
    starts = write_table(
        ranked.groupBy(F.col("src").alias("vertex")).agg(
            F.min("slot").alias("first"), F.count(F.lit(1)).alias("degree")
        ),
        "walk_starts",
    )
    packed = ranked.select("slot", "dst").mapInArrow(_pack(BLOCK_SLOTS), "block long, lo long, hi long, dsts array<long>")
    blocks = write_table(packed, "walk_blocks")
    sums = starts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("slots")).first()
    return WalkGraph(edges=ranked, blocks=blocks, starts=starts, num_slots=int(sums["slots"]), num_starts=int(sums["n"]))


def indexed_edges(graph: WalkGraph) -> DataFrame:
    """``(src, idx, dst, dst_degree)``: neighbour ``idx`` (0-based, ordered by
    id, duplicates included) of every vertex, with the neighbour's degree.
    A view for inspection; walks never need it (they join on ``slot``)."""
    first = graph.starts.select(F.col("vertex").alias("src"), "first")
    return graph.slots.join(first, "src").select(
        "src", (F.col("slot") - F.col("first")).alias("idx"), "dst", "dst_degree"
    )
