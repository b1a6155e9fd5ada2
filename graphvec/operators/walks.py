"""Uniform random walks, one equi-join per step.

Model (same as the engine this re-creates):
  * every vertex with an out-edge starts ``walks_per_vertex`` walks;
  * a walk holds ``length`` vertices including its start;
  * each step moves to a neighbour drawn uniformly (multi-edges weigh more);
  * a walker standing on a vertex without out-edges before its last step
    disappears with its whole walk; reaching such a vertex on the last step
    is fine.

Design for scale:
  * the neighbour is chosen by a hash of ``(seed, start, walk_no, step)``:
    a retried task reproduces the same walk, and DuckDB can recompute it;
  * a walker at ``v`` drawing ``k`` joins on the single key
    ``slot = first(v) + k`` (see ``graph.WalkGraph``) or on its block: a hub's walkers
    spread over its slots, and a row holds a bounded part of its neighbours;
  * three plans, chosen by the caller; all give the same walks:
    - ``shuffle`` (default): walker state is four numbers plus the positions of
      the current chunk. Each step joins walkers and packed slots on the block of
      the slot, then (before another step) walkers and vertices for the next draw;
      the hash tables are built from blocks and vertices, the walkers stream through.
      Both sides are plain shuffles, so adaptive execution splits a busy key's
      walkers, and the shuffles of blocks and vertices are reused by the steps of a
      job. Every ``chunk_steps`` steps the walkers are written; a walk is assembled
      from its few chunk rows.
    - ``auto``: the same steps without a hint, so Spark broadcasts a table
      that its own estimate says is small enough and shuffles any other.
    - ``broadcast``: only on request and only if the slot table passes the size
      check. Steps are chained broadcast joins in one stage; every
      ``chunk_steps`` steps the walkers are written to bound plan size and
      recompute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.functions.hashing import uniform_index
from graphvec.operators.graph import BLOCK_SLOTS, WalkGraph
from graphvec.session import partitions_for, scratch_path, write_table

# In-memory size of one broadcast slot row (key + 3 longs + row overhead),
# used for the broadcast size check.
SLOT_ROW_BYTES = 64
DEFAULT_BROADCAST_LIMIT = 256 * 1024 * 1024


def walk_seeds(graph: WalkGraph, walks_per_vertex: int, *, num_partitions: int | None = None) -> DataFrame:
    """``(start, walk_no, first, deg)`` for every vertex with an out-edge.

    The vertices (not the walkers) are first dealt to ``num_partitions`` (default: shuffle
    partitions, at least one for ``ROWS_PER_PARTITION`` walkers): a vertex table in one small file
    would otherwise start every walk in one task, and where no step shuffles also end it there.
    """
    if walks_per_vertex <= 0:
        raise ValueError("walks_per_vertex must be positive")
    n = partitions_for(graph.starts.sparkSession, graph.num_starts * walks_per_vertex, num_partitions)
    return graph.starts.repartition(n, "vertex").select(
        F.col("vertex").alias("start"),
        F.explode(F.sequence(F.lit(0), F.lit(walks_per_vertex - 1))).alias("walk_no"),
        "first",
        F.col("degree").alias("deg"),
    )


def check_broadcast(graph: WalkGraph, limit_bytes: int) -> None:
    """Raise if the slot table is too large to broadcast."""
    size = graph.num_slots * SLOT_ROW_BYTES
    if size > limit_bytes:
        raise ValueError(f"slot table of about {size} bytes is over the broadcast limit of {limit_bytes}; use the shuffle plan")


def _step(
    cur: DataFrame, slots: DataFrame, seed: int, step: int, *, drop_dead: bool, carry: list[str]
) -> DataFrame:
    """Move every live walker one step; walkers on a sink drop out.

    A sink carries ``first = -1`` and degree 0, so its draw lands on slot -1,
    which does not exist: the inner join drops it without a filter. Leaving
    the filter out keeps Catalyst from inferring ``dst_degree > 0`` on the
    slot table, so every step broadcasts the identical relation and Spark
    reuses one broadcast for the whole chain. On the shuffle plan dead
    walkers are filtered first (``drop_dead``) so they never pile up on the
    single key -1. Three DataFrame calls per step keep driver-side analysis
    of long chains cheap.
    """
    draw = uniform_index(seed, F.greatest(F.col("deg"), F.lit(1)), "start", "walk_no", F.lit(step))
    if drop_dead:
        cur = cur.where(F.col("deg") > 0)
    walkers = cur.select(
        "start", "walk_no", *carry,
        F.coalesce(F.col("first") + draw, F.lit(-1).cast("bigint")).alias("slot"),
    )
    moved = walkers.join(slots, "slot")
    return moved, [
        F.col("start"), F.col("walk_no"),
        F.col("dst_first").alias("first"), F.col("dst_degree").alias("deg"),
    ]


def _broadcast_walks(
    graph: WalkGraph, length: int, walks_per_vertex: int, seed: int, chunk_steps: int
) -> DataFrame:
    slots = F.broadcast(graph.slots.select("slot", "dst", "dst_first", "dst_degree"))
    cur = walk_seeds(graph, walks_per_vertex).withColumn("walk", F.array("start"))
    for step in range(1, length):
        moved, keep = _step(cur, slots, seed, step, drop_dead=False, carry=["walk"])
        cur = moved.select(*keep, F.concat("walk", F.array("dst")).alias("walk"))
        if step % chunk_steps == 0 and step < length - 1:
            cur = write_table(cur, "walk_chunk")
    return write_table(cur.select("start", "walk_no", "walk"), "walks")


def along(walkers: DataFrame, graph: WalkGraph, *, hint: bool = True, how: str = "inner") -> DataFrame:
    """``walkers`` (with a column ``slot``, never null) with ``dst``, the vertex their slot leads to; ``slot`` is dropped.
    The hash table is built from the blocks, the walkers stream. ``how="left"`` keeps walkers on no slot, ``dst`` is null."""
    blocks = graph.blocks.withColumnRenamed("block", "_block")
    blocks = blocks.hint("shuffle_hash") if hint else blocks
    here = (F.expr(f"slot div {BLOCK_SLOTS}") == F.col("_block")) & (F.col("slot") >= F.col("lo")) & (F.col("slot") < F.col("hi"))
    keep = [c for c in walkers.columns if c != "slot"]
    return walkers.join(blocks, here, how).select(*keep, F.get("dsts", (F.col("slot") - F.col("lo")).cast("int")).alias("dst"))


def walk_chunks(
    graph: WalkGraph, *, length: int, walks_per_vertex: int, seed: int, chunk_steps: int = 20, hint: bool = True
) -> DataFrame:
    """Shuffle plan (without ``hint`` Spark chooses the joins): ``(start, walk_no, step0, path)``, a walker's positions from
    ``step0`` on, at most ``chunk_steps`` (plus the start) in a row.

    ``chunk_steps`` shuffled steps run in one job and each chunk is written once.
    A walker that stands on a sink before its last step has no row for that chunk; its walk is
    incomplete and dropped by ``random_walks``.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    spark = graph.starts.sparkSession
    base = scratch_path(spark, "walk_chunks")
    # the hash tables are built from blocks and vertices: few or unique keys, while walkers may pile up on one
    target = graph.starts.select(F.col("vertex").alias("dst"), "first", F.col("degree").alias("deg"))
    target = target.hint("shuffle_hash") if hint else target
    empty = F.array().cast("array<bigint>")

    def save(df: DataFrame, chunk: int) -> DataFrame:
        return write_table(df, "walk_chunks", path=f"{base}/chunk={chunk}")

    cur = walk_seeds(graph, walks_per_vertex).select("start", "walk_no", "first", "deg", F.array("start").alias("path"))
    chunk, step0 = 0, 0
    for step in range(1, length):
        draw = F.col("first") + uniform_index(seed, "deg", "start", "walk_no", F.lit(step))
        moved = along(cur.select("start", "walk_no", "path", draw.alias("slot")), graph, hint=hint)
        cur = moved.select("start", "walk_no", "dst", F.concat("path", F.array("dst")).alias("path"))
        if step < length - 1:  # a walker on a sink meets no row here
            cur = cur.join(target, "dst").drop("dst")
            if step % chunk_steps == 0:
                done = save(cur.withColumn("step0", F.lit(step0)), chunk)
                chunk, step0 = chunk + 1, step + 1
                cur = done.select("start", "walk_no", "first", "deg", empty.alias("path"))
    save(cur.select("start", "walk_no", F.lit(step0).alias("step0"), "path"), chunk)
    return spark.read.schema("start long, walk_no int, step0 int, path array<long>").parquet(base).select("start", "walk_no", "step0", "path")


def random_walks(
    graph: WalkGraph,
    *,
    length: int,
    walks_per_vertex: int = 1,
    seed: int = 0,
    strategy: str = "shuffle",
    broadcast_limit_bytes: int = DEFAULT_BROADCAST_LIMIT,
    chunk_steps: int = 20,
) -> DataFrame:
    """``(start, walk_no, walk ARRAY<BIGINT>)`` of full-length walks.

    ``graph`` comes from ``graph.walk_graph(edges)``. ``strategy`` is
    ``shuffle``, ``auto`` or ``broadcast`` (which raises over ``broadcast_limit_bytes``);
    all give the same walks for the same seed.
    """
    if length <= 0:
        raise ValueError("length must be positive")
    if walks_per_vertex <= 0:
        raise ValueError("walks_per_vertex must be positive")
    if chunk_steps <= 0:
        raise ValueError("chunk_steps must be positive")
    if strategy == "broadcast":
        check_broadcast(graph, broadcast_limit_bytes)
        return _broadcast_walks(graph, length, walks_per_vertex, seed, chunk_steps)
    if strategy not in ("shuffle", "auto"):
        raise ValueError(f"unknown strategy {strategy!r}")
    chunks = walk_chunks(
        graph, length=length, walks_per_vertex=walks_per_vertex, seed=seed, chunk_steps=chunk_steps,
        hint=strategy == "shuffle",
    )
    if length - 1 <= chunk_steps:  # one row is the whole walk
        return chunks.where(F.size("path") == length).select("start", "walk_no", F.col("path").alias("walk"))
    walk = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step0", "path"))), lambda x: x["path"]))
    return (
        chunks.groupBy("start", "walk_no").agg(walk.alias("walk")).where(F.size("walk") == length)
    )


def single_walks(graph: WalkGraph, *, length: int, seed: int = 0, **kw) -> DataFrame:
    """One walk per vertex (``walk_no`` is always 0)."""
    return random_walks(graph, length=length, walks_per_vertex=1, seed=seed, **kw)
