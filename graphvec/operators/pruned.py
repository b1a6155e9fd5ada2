"""Exact cosine neighbours that read only the files that can matter.

``build`` deals the unit vectors by their nearest pivot and their angle to it, and writes them in parts; for each
part it keeps the smallest and largest angle to every pivot. Angles on the sphere obey the triangle inequality: if a query
lies at angle a to a pivot and a part's vectors between lo and hi, none of them is nearer to the query than
max(lo - a, a - hi, 0), whichever pivot is taken. A block of queries first reads the part that promises most for
each of them, and then only parts whose bound still reaches the k-th similarity found by one of its queries. The result is that of a
full scan; where vectors have no structure every part is read, once.

Zero vectors have no direction: they lie in a part of their own whose bound is their similarity, 0. A zero query has similarity 0
to all and reads all parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphvec.functions.vectors import array_l2
from graphvec.operators.ranking import global_index
from graphvec.operators.similarity import PRODUCT_BYTES, _finite, _local_topk, _normalise
from graphvec.session import partitions_for, scratch_path, write_table

#: Vectors that angles are measured from, rows of a part, and queries of a block.
PIVOTS, PART_ROWS, BLOCK_QUERIES = 16, 50_000, 256
#: Angles and similarities are compared with this much to spare (the arc cosine of nearly parallel vectors has errors of 1e-8).
SPARE = 1e-6
_FIELDS = "id long, word string, vector array<double>, pivot int, angle double"


@dataclass(frozen=True)
class Index:
    """``parts``: (id, word, vector, part), stored by part. ``bounds``: one row for each part: part, lo and hi, arrays with an
    angle for each pivot. ``pivots``: unit vectors, a row each."""

    parts: DataFrame
    bounds: DataFrame
    pivots: np.ndarray


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(rows, -1)


def build(vectors: DataFrame, *, pivots: int = PIVOTS, part_rows: int = PART_ROWS) -> Index:
    """Index of ``vectors(word, vector)``. The pivots are the vectors of the words with the smallest hashes."""
    if pivots <= 0 or part_rows <= 0:
        raise ValueError("pivots and part_rows must be positive")
    _finite(vectors, "vectors")
    rows = global_index(vectors.select("word", F.col("vector").cast("array<double>").alias("vector")), ["word"], out="id")
    rows = write_table(rows, "numbered_words")
    some = rows.where(array_l2("vector") > 0).orderBy(F.xxhash64("word"), "word").limit(pivots).collect()
    chosen = _normalise(np.array([r["vector"] for r in some])) if some else np.zeros((0, 0))

    def place(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                unit = _normalise(_matrix(part.column("vector"), part.num_rows))
                zero = ~unit.any(axis=1)
                angles = _angles(unit, chosen) if len(chosen) else np.zeros((len(unit), 1))
                near = np.where(zero, -1, angles.argmin(axis=1)).astype(np.int32)
                columns = [part.column("id"), part.column("word"), part.column("vector"), pa.array(near), pa.array(angles.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "word", "vector", "pivot", "angle"])

    dealt = write_table(rows.select("id", "word", "vector").mapInArrow(place, _FIELDS), "angles")
    n = max(1, -(-dealt.count() // part_rows))
    dealt = dealt.where("pivot >= 0").repartitionByRange(n, "pivot", "angle").withColumn("part", F.spark_partition_id()).unionByName(
        dealt.where("pivot < 0").withColumn("part", F.lit(-1))
    )
    parts = write_table(dealt.select("id", "word", "vector", "part"), "parts", partition_by=["part"])

    def spread(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            part = b.column("part").to_numpy(zero_copy_only=False)
            angles = _angles(_normalise(_matrix(b.column("vector"), b.num_rows)), chosen)
            for p in np.unique(part):
                a = angles[part == p]
                lo, hi = found.get(int(p), (a[0], a[0]))
                found[int(p)] = np.minimum(lo, a.min(axis=0)), np.maximum(hi, a.max(axis=0))
        for p, (lo, hi) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([lo.tolist()]), pa.array([hi.tolist()])], ["part", "lo", "hi"])

    kinds = "part int, lo array<double>, hi array<double>"
    spans = parts.where("part >= 0").select("part", "vector").mapInArrow(spread, kinds) if len(chosen) else parts.sparkSession.createDataFrame([], kinds)
    least, most = ([f(F.get(c, i)).alias(f"{c}{i}") for i in range(len(chosen))] for f, c in ((F.min, "lo"), (F.max, "hi")))
    bounds = spans.groupBy("part").agg(F.count(F.lit(1)), *least, *most)
    bounds = bounds.select("part", *[F.array(*[F.col(f"{c}{i}") for i in range(len(chosen))]).alias(c) for c in ("lo", "hi")])
    return Index(parts, write_table(bounds, "bounds"), chosen)


def reachable(query_angles: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(query, part): no vector of the part is more similar to the query."""
    least = np.maximum(lo[None] - query_angles[:, None], query_angles[:, None] - hi[None]).max(axis=2)
    return np.cos(np.clip(least - SPARE, 0, np.pi))


def search(index: Index, queries: DataFrame, k: int, *, exclude_self: bool = False, block_queries: int = BLOCK_QUERIES, product_bytes: int = PRODUCT_BYTES) -> DataFrame:
    """``(query, word, similarity, rank)`` as ``similarity.nearest`` returns it, for ``queries(query, vector)``."""
    if k <= 0:
        raise ValueError("the number of neighbours must be positive")
    spark = index.parts.sparkSession
    _finite(queries, "queries")
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    own = F.lit(None).cast("long").alias("own")
    if exclude_self:
        asked = asked.join(index.parts.select(F.col("word").alias("query"), F.col("id").alias("own")), "query", "left")
    else:
        asked = asked.select("*", own)
    pivots = index.pivots

    def angle(batches):
        for b in batches:
            unit = _normalise(_matrix(b.column("vector"), b.num_rows))
            angles = _angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))], [*b.schema.names, "pivot", "angle"])

    placed = asked.mapInArrow(angle, "query string, vector array<double>, own long, pivot int, angle double")
    # queries of a block lie close together, so that they want the same parts
    asked = write_table(global_index(placed, ["pivot", "angle", "query"], out="qi"), "numbered_queries")
    spans = sorted(index.bounds.collect())  # one row for each part
    numbers = np.array([r["part"] for r in spans], int)
    lo, hi = (np.array([r[c] for r in spans]).reshape(len(spans), -1) for c in ("lo", "hi"))
    has_zeros = not index.parts.where("part = -1").isEmpty()
    base, total = scratch_path(spark, "neighbours"), asked.count()
    for start in range(0, max(total, 1), block_queries):
        rows = asked.where((F.col("qi") >= start) & (F.col("qi") < start + block_queries)).orderBy("qi").collect()
        qids = np.array([r["qi"] for r in rows], np.int64)
        unit = _normalise(np.array([r["vector"] for r in rows], np.float64)) if rows else np.zeros((0, 0))
        mine = np.array([-1 if r["own"] is None else r["own"] for r in rows], np.int64) if exclude_self else None

        def read(chosen: list[int], step: int) -> DataFrame:
            some = index.parts.where(F.col("part").isin(chosen)) if chosen and len(qids) else index.parts.limit(0)
            fn = _local_topk(qids, unit, mine, k, product_bytes) if len(qids) else _nothing
            path = f"{base}/start={start}/step={step}"
            some.select("id", "vector").mapInArrow(fn, "qi long, id long, similarity double").write.parquet(path)
            return spark.read.parquet(path)

        if not len(qids) or not len(numbers):
            read([-1] if has_zeros else [], 0)
            continue
        best = reachable(_angles(unit, pivots), lo, hi)
        best[~unit.any(axis=1)] = 0.0
        first = sorted({int(numbers[i]) for i in best.argmax(axis=1)})
        found = read(first, 0).groupBy("qi").agg(F.slice(F.array_sort(F.collect_list(-F.col("similarity"))), k, 1).alias("kth")).collect()
        reached = {r["qi"]: -r["kth"][0] for r in found if r["kth"]}
        need = np.array([reached.get(int(q), -2.0) for q in qids])
        rest = [int(numbers[i]) for i in np.flatnonzero((best >= need[:, None] - SPARE).any(axis=0)) if int(numbers[i]) not in first]
        read(rest + ([-1] if has_zeros and (need <= SPARE).any() else []), 1)
    order = Window.partitionBy("qi").orderBy(F.col("similarity").desc(), "id")
    top = spark.read.parquet(base).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = top.join(asked.select("qi", "query"), "qi").join(index.parts.select("id", "word"), "id")
    return named.select("query", "word", "similarity", "rank")


def _nothing(batches):
    for _ in batches:
        pass
    return iter(())
