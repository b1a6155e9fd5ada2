"""Nearest neighbours by inner product with a vantage-point tree in each shard.

A largest inner product is a nearest neighbour in Euclidean space once every candidate x gets one
more component ``sqrt(M^2 - |x|^2)`` (M: the largest norm) and the query a zero. Equal vectors are
one point that carries its smallest ids. Points are dealt by a hash of the vector to shards of
about ``shard_rows`` points; each shard's tree is built in one task and stored. Queries travel in
blocks; a (shard, block) pair is one bounded piece of work, in which all queries of the block walk
the tree together.

A subtree is skipped for a query if the triangle inequality keeps it further away than ``factor``
times the query's distance to its worst neighbour so far. Factor 1 is exact; below 1 more is skipped.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null vec_id. Vectors of different lengths never meet. Ties go to the
smaller vec_id. Rows repeated with one vec_id are one candidate at the best of their scores; a
query's own vec_id is never a candidate. Fewer than k candidates return all. Empty tables return
no rows; extra columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphvec.session import write_table

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16_384, 2_048, 128
#: Blocks of queries that one task takes against one shard.
BLOCKS_A_TASK = 4


def _usable(vec_id: Column, vec: Column) -> Column:
    zero, inf = F.lit(0.0), F.lit(float("inf"))
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False)))
    return vec_id.isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != zero)


def _vectors(b: pa.RecordBatch, kind: str) -> list[bytes]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), kind).tobytes() for x in b.column("vec")]


def _points(rows: DataFrame, kind: str, keep: int) -> DataFrame:
    """``(dim, h1, h2, vec, ids)``: distinct vectors with their ``keep`` smallest ids. Each batch
    is collapsed before the shuffle."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_of: dict[bytes, set[int]] = {}
            for vec_id, v in zip(b.column("vec_id").to_pylist(), _vectors(b, kind), strict=True):
                ids_of.setdefault(v, set()).add(vec_id)
            h = [xxhash.xxh3_128_intdigest(v) for v in ids_of]
            half = lambda s: np.array([x >> s & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64).view(np.int64)
            size = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) // size for v in ids_of], pa.int64()), pa.array(half(0)), pa.array(half(64)), pa.array(list(ids_of), pa.binary()),
                 pa.array([sorted(s)[:keep] for s in ids_of.values()], pa.list_(pa.int64()))],
                ["dim", "h1", "h2", "vec", "ids"],
            )

    part = rows.mapInArrow(collapse, "dim long, h1 long, h2 long, vec binary, ids array<long>")
    return part.groupBy("dim", "h1", "h2").agg(
        F.first("vec").alias("vec"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"),
    )


class Tree:
    """A vantage-point tree over the rows of ``points``, ordered by their smallest id."""

    def __init__(self, points: np.ndarray, norm: float, leaf: int = LEAF):
        self.points = points
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", points, points), 0.0))
        self.space = np.column_stack([points, rest])
        self.norm, self.leaf = norm, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        middle = self.space[at].mean(axis=0)
        far = at[np.argmax(((self.space[at] - middle) ** 2).sum(axis=1))]
        d = np.sqrt(((self.space[at] - self.space[far]) ** 2).sum(axis=1))
        mu = float(np.median(d))
        inside = d <= mu
        if inside.all():
            inside = d < mu
        if not inside.any():
            return at  # all at one distance: no vantage point can part them
        return far, mu, self._build(at[inside]), self._build(at[~inside])

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and rows of each query's k best points, best first; row -1 where there are fewer."""
        m = len(queries)
        self.q, self.k, self.factor = queries, k, factor
        self.q2 = np.einsum("ij,ij->i", queries, queries) + self.norm**2
        self.score = np.full((m, k), -np.inf)
        self.row = np.full((m, k), -1, np.int64)
        self._visit(self.root, np.arange(m))
        # Summed in the order of the components, so that equal pairs have equal scores anywhere.
        got = np.stack([np.cumsum(self.points[self.row[:, j]] * queries, axis=1)[:, -1] for j in range(k)], axis=1)
        got = np.where(self.row >= 0, got, -np.inf)
        order = np.lexsort((self.row, -got), axis=1)
        return np.take_along_axis(got, order, 1), np.take_along_axis(self.row, order, 1)

    def _worst(self, at: np.ndarray) -> np.ndarray:
        """Distance to the k-th neighbour so far, rounding errors allowed for."""
        s = self.score[at, -1]
        d2 = self.q2[at] - 2 * np.where(np.isfinite(s), s, 0.0)
        return np.where(np.isfinite(s), np.sqrt(np.maximum(d2, 0) + 1e-9 * self.q2[at]), np.inf)

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            s = self.q[at] @ self.points[node].T
            better = (s >= self.score[at, -1][:, None]).any(axis=1)
            if better.any():
                at, s = at[better], s[better]
                scores = np.concatenate([self.score[at], s], axis=1)
                rows = np.concatenate([self.row[at], np.broadcast_to(node, s.shape)], axis=1)
                best = np.lexsort((rows, -scores), axis=1)[:, : self.k]
                self.score[at], self.row[at] = np.take_along_axis(scores, best, 1), np.take_along_axis(rows, best, 1)
            return
        far, mu, inside, outside = node
        d2 = self.q2[at] - 2 * (self.q[at] @ self.points[far])
        d = np.sqrt(np.maximum(d2, 0))
        near = d <= mu
        self._visit(inside, at[near])
        self._visit(outside, at[~near])
        reach = self.factor * self._worst(at) + 1e-9 * np.sqrt(self.q2[at])
        self._visit(outside, at[near & (mu - d <= reach)])
        self._visit(inside, at[~near & (d - mu <= reach)])


def _arrays(blobs: pd.Series, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in blobs]).astype(np.float64)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, int, str]:
    """The written index ``(shard, dim, tree)`` over every usable row; the usable rows; the number of
    shards; and the stored kind of number."""
    element = vectors.schema[vec_col].dataType
    single = isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.where(_usable(F.col("vec_id"), F.col("vec")))
    points = write_table(_points(rows, kind, k + 1), "points")
    count = points.count()
    shards = max(1, -(-count // shard_rows))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [float(np.linalg.norm(np.frombuffer(x, kind).astype(np.float64))) for x in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("dim"), pa.array(n, pa.float64())], ["dim", "norm"])

    # one row for each vector length in the table
    longest = points.select("dim", "vec").mapInArrow(norms, "dim long, norm double").groupBy("dim").agg(F.max("norm").alias("norm"))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(low=[x[0] for x in part["ids"]]).sort_values("low", kind="stable")
        tree = Tree(_arrays(part["vec"], kind), float(part["norm"].iloc[0]) * (1 + 1e-12))
        blob = pickle.dumps((tree, [np.asarray(x, np.int64) for x in part["ids"]]), protocol=5)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [blob]})

    dealt = points.join(longest, "dim").withColumn("shard", F.pmod("h2", F.lit(shards)))
    index = dealt.groupBy("dim", "shard").applyInPandas(grow, "dim long, shard long, tree binary")
    return write_table(index, "vp_index"), rows, shards, kind


def search(vectors: DataFrame, queries: Column, *, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows that ``queries`` (a condition on
    ``vec_id``) chooses, against all rows."""
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    index, rows, shards, kind = build_index(vectors, id_col=id_col, vec_col=vec_col, k=k, shard_rows=shard_rows)
    asked = rows.where(queries).dropDuplicates(["vec_id", "vec"])
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        vec = np.stack([np.asarray(x, kind) for x in part["vec"]])
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [vec.tobytes()]})

    packed = (
        asked.withColumn("dim", F.size("vec").cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)))
        .groupBy("dim", "block")
        .applyInPandas(pack, "dim long, block long, ids binary, vecs binary")
    )
    parts = -(-blocks // BLOCKS_A_TASK)
    packed = packed.withColumn("part", F.expr(f"block div {BLOCKS_A_TASK}"))
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    trees = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def walk(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in held["tree"]:
            tree, ids_of = pickle.loads(blob)
            for dim, ids, vecs in zip(asks["dim"], asks["ids"], asks["vecs"], strict=True):
                own = np.frombuffer(ids, np.int64)
                q = np.frombuffer(vecs, kind).reshape(len(own), int(dim)).astype(np.float64)
                score, row = tree.search(q, k + 1, factor)
                for i, query in enumerate(own):
                    found = [(s, v) for s, r in zip(score[i], row[i], strict=True) if r >= 0 for v in ids_of[r] if v != query]
                    found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                    out.append(pd.DataFrame({"query_id": query, "qh": xxhash.xxh3_64_intdigest(q[i].tobytes()) >> 1, "vec_id": [v for _, v in found], "score": [s for s, _ in found]}))
        if not out:
            return pd.DataFrame({"query_id": [], "qh": [], "vec_id": [], "score": []})
        return pd.concat(out, ignore_index=True)

    near = packed.groupBy("dim", "shard", "part").cogroup(trees.groupBy("dim", "shard", "part")).applyInPandas(walk, "query_id long, qh long, vec_id long, score double")
    near = near.groupBy("query_id", "qh", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
