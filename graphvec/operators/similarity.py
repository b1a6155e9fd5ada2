"""Vector lookups, norms, per-key vector sums and exact top-k cosine search.

A vector table ("model") is any DataFrame ``(word STRING, vector
ARRAY<FLOAT|DOUBLE>)`` with unique words and one dimension; components must be finite.

Top-k search forms no cross join: words are numbered once in word order, the *queries* are
taken in batches whose size is bounded (``max_batch_bytes``), and each batch is sent to the
partitions of the vector table, multiplied there in numpy in pieces of a fixed size, and
written before the next batch is read. A partition keeps a running top-k for each query, so it
emits at most k rows for each; a window over these picks the final k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphvec.functions.vectors import array_l2
from graphvec.operators.ranking import global_index
from graphvec.session import scratch_path, write_table

DEFAULT_MAX_BATCH_BYTES = 64 * 1024 * 1024
#: Bytes of one product of queries and vectors in a task.
PRODUCT_BYTES = 32 * 1024 * 1024


class VocabularyError(KeyError):
    """A query word is not in the model."""


def vector_norms(vectors: DataFrame) -> DataFrame:
    """``(word, norm)``: L2 norm accumulated in double."""
    return vectors.select("word", array_l2("vector").alias("norm"))


def lookup(vectors: DataFrame, queries: DataFrame, *, strict: bool = True) -> DataFrame:
    """``(query, vector)`` for every row of ``queries(query)``. Strict mode
    raises ``VocabularyError`` if any query word is unknown; lax mode keeps
    the row with a null vector. Strict mode writes the join once and answers from it."""
    out = queries.select("query").join(
        vectors.select(F.col("word").alias("query"), "vector"), "query", "left"
    )
    if strict:
        out = write_table(out, "lookup")
        missing = out.where(F.col("vector").isNull()).select("query").limit(5).collect()
        if missing:
            raise VocabularyError(f"unknown words: {[r.query for r in missing]}")
    return out


def vector_sum(df: DataFrame, key: str, *, col: str = "vector", average: bool = False) -> DataFrame:
    """Element-wise sum (or mean) of the vectors of each key, in double, as a
    partial aggregate: a hot key costs one buffer for each task."""
    rows = df.select(key, array_to_vector(F.col(col).cast("array<double>")).alias("_v"))
    total = Summarizer.mean(F.col("_v")) if average else Summarizer.sum(F.col("_v"))
    return rows.groupBy(key).agg(vector_to_array(total).alias(col))


def _finite(vectors: DataFrame, what: str) -> None:
    """Raise on null vectors and on null, NaN or infinite components."""
    fine = F.col("vector").isNotNull() & F.forall(
        F.col("vector"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    bad = vectors.where(~F.coalesce(fine, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError(f"{what} hold null vectors or components that are no finite numbers")


_TOPK = "qi long, id long, similarity double"


def _local_topk(qids, qmat, own, keep, product_bytes):
    """mapInArrow body: a running top ``keep`` (similarity, then smaller id) per query over all
    rows of the partition."""

    def run(batches):
        nq, dim = qmat.shape
        best = np.full((nq, keep), -np.inf)
        who = np.full((nq, keep), -1, np.int64)
        piece = max(1, product_bytes // (8 * nq))
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(b.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64)
            if flat.size != b.num_rows * dim:
                raise ValueError("vectors must all have the query dimension")
            mat = flat.reshape(b.num_rows, dim)
            norms = np.sqrt(np.einsum("ij,ij->i", mat, mat))
            mat = np.divide(mat, norms[:, None], out=np.zeros_like(mat), where=norms[:, None] > 0)
            for at in range(0, b.num_rows, piece):
                sims = qmat @ mat[at : at + piece].T
                some = ids[at : at + piece]
                if own is not None:
                    hit, where = np.flatnonzero(np.isin(own, some)), np.argsort(some, kind="stable")
                    sims[hit, where[np.searchsorted(some[where], own[hit])]] = -np.inf
                rows = np.flatnonzero((sims >= best[:, -1][:, None]).any(axis=1))
                width = max(1, product_bytes // (16 * (keep + len(some))))
                for k in range(0, len(rows), width):
                    r = rows[k : k + width]
                    s = np.concatenate([best[r], sims[r]], axis=1)
                    w = np.concatenate([who[r], np.broadcast_to(some, (len(r), len(some)))], axis=1)
                    order = np.lexsort((w, -s), axis=1)[:, :keep]
                    best[r], who[r] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
        rows, cols = np.nonzero(np.isfinite(best))
        for at in range(0, len(rows), 100_000):
            r, c = rows[at : at + 100_000], cols[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[r]), pa.array(who[r, c]), pa.array(best[r, c])], ["qi", "id", "similarity"]
            )

    return run


def _normalise(mat: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(mat, axis=1)
    out = mat.copy()
    nz = norms > 0
    out[nz] = mat[nz] / norms[nz, None]
    out[~nz] = 0.0
    return out


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    exclude_self: bool = False,
    max_batch_bytes: int = DEFAULT_MAX_BATCH_BYTES,
    product_bytes: int = PRODUCT_BYTES,
) -> DataFrame:
    """``(query, word, similarity, rank)``: the ``k`` words of highest cosine
    similarity to each query vector (``queries(query, vector)``), ranked from
    1 by similarity descending then word. With ``exclude_self`` a query named
    like a word never returns that word. A zero vector scores 0. Vectors that are null or hold
    components that are no finite numbers raise. Queries of one name are told apart only by their vectors' order
    in the result; give each a name of its own."""
    if k <= 0:
        raise ValueError("the number of neighbours must be positive")
    spark = vectors.sparkSession
    _finite(vectors, "vectors")
    _finite(queries, "queries")
    words = global_index(vectors.select("word", F.col("vector").cast("array<double>").alias("vector")), ["word"], out="id")
    words = write_table(words, "numbered_words")
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    if exclude_self:
        asked = asked.join(words.select(F.col("word").alias("query"), F.col("id").alias("own")), "query", "left")
    else:
        asked = asked.withColumn("own", F.lit(None).cast("long"))
    asked = write_table(global_index(asked, ["query"], out="qi"), "numbered_queries")
    stats = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    nq, dim = int(stats["n"]), int(stats["d"] or 0)
    size = max(1, max_batch_bytes // (8 * dim + 32 * k + 64))
    base = scratch_path(spark, "neighbours")
    for n, start in enumerate(range(0, max(nq, 1), size)):
        # at most ``size`` rows; written before the next batch is read
        rows = asked.where((F.col("qi") >= start) & (F.col("qi") < start + size)).select("qi", "own", "vector").collect()
        qids = np.array([r["qi"] for r in rows], np.int64)
        qmat = _normalise(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), dim))
        own = np.array([-1 if r["own"] is None else r["own"] for r in rows], np.int64) if exclude_self else None
        found = words.select("id", "vector") if rows else words.select("id", "vector").limit(0)
        fn = _local_topk(qids, qmat, own, k, product_bytes) if rows else _nothing
        found.mapInArrow(fn, _TOPK).write.parquet(f"{base}/batch={n}")
    order = Window.partitionBy("qi").orderBy(F.col("similarity").desc(), "id")
    top = spark.read.parquet(base).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (
        top.join(asked.select("qi", "query"), "qi")
        .join(words.select("id", "word"), "id")
        .select("query", "word", "similarity", "rank")
    )


def _nothing(batches):
    for _ in batches:
        pass
    return iter(())


def nearest_by_word(
    vectors: DataFrame, words: DataFrame, k: int, *, strict: bool = True, **kw
) -> DataFrame:
    """Synonyms of each word in ``words(query)``, the word itself excluded."""
    q = lookup(vectors, words, strict=strict)
    return nearest(vectors, q, k, exclude_self=True, **kw)


def nearest_by_vector(vectors: DataFrame, queries: DataFrame, k: int, **kw) -> DataFrame:
    """Words nearest to arbitrary vectors ``queries(query, vector)``; no
    exclusion."""
    return nearest(vectors, queries, k, exclude_self=False, **kw)
