"""Logistic regression of many labels over many training sets at once.

A problem is a (cell, label): the rows of the cell against one label. A cell is a prefix of a seeded order of the
rows, so a row says by its positions which cells it trains. All problems of a block are fitted in the
same passes: a task adds up loss, gradient and curvature of its rows for each problem, the sums of all tasks
are added by Spark, and every problem takes a damped Newton step of its own. The number of jobs depends on the passes
only, not on labels, shares or shuffles. Blocks of labels are sized so that what a task holds fits ``block_bytes``.

The loss of a problem is the summed log loss of its rows plus half of ``penalty`` times the squared weights (the
intercept is free). A label that all or no rows of a cell have gets weights 0 and an intercept of +-``FIXED``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.operators.ranking import global_index
from graphvec.operators.similarity import vector_sum
from graphvec.session import scratch_path, write_table

BLOCK_BYTES = 32 * 1024 * 1024
#: Rows that a task multiplies at a time.
BATCH_ROWS = 4096
FIXED = 700.0
TOLERANCE = 1e-6
_MOST_HALVINGS = 30

_FITTED = "cell int, label int, coefficients array<double>, intercept double"


def _rows(batch: pa.RecordBatch, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors with a last column of ones, positions, ones at the labels) of some rows at a time."""
    for at in range(0, batch.num_rows, BATCH_ROWS):
        b = batch.slice(at, BATCH_ROWS)
        x = pc.list_flatten(b.column("vector")).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        x = np.concatenate([x, np.ones((b.num_rows, 1))], axis=1)
        positions = pc.list_flatten(b.column("positions")).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        row, label = (f(b.column("labels")).to_numpy(zero_copy_only=False) for f in (pc.list_parent_indices, pc.list_flatten))
        place = np.minimum(np.searchsorted(labels, label), max(len(labels) - 1, 0))
        hit = labels[place] == label if len(labels) else np.zeros(len(label), bool)
        y = np.zeros((b.num_rows, len(labels)))
        y[row[hit], place[hit]] = 1
        yield x, positions, y


def _partial_sums(labels: np.ndarray, cells: Sequence[tuple[int, int]], open_: np.ndarray, weights: np.ndarray):
    """mapInArrow body: (problem, sums) with sums = rows, positives, loss, gradient, upper curvature of the tasks's rows.
    ``weights`` has a row for each open problem; problems are numbered cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = weights.shape[1]
        upper = np.triu_indices(d)
        sums = np.zeros((len(open_), 3 + d + len(upper[0])))
        seen = False
        for batch in batches:
            for x, positions, y in _rows(batch, labels):
                seen = True
                for c, (shuffle, cut) in enumerate(cells):
                    mine = np.flatnonzero(open_ // len(labels) == c)
                    rows = positions[:, shuffle] < cut
                    if not len(mine) or not rows.any():
                        continue
                    xs, ys = x[rows], y[rows][:, open_[mine] % len(labels)]
                    z = xs @ weights[mine].T
                    p = 0.5 * (1 + np.tanh(0.5 * z))
                    sums[mine, 0] += len(xs)
                    sums[mine, 1] += ys.sum(axis=0)
                    sums[mine, 2] += (np.logaddexp(0, z) - ys * z).sum(axis=0)
                    sums[mine, 3 : 3 + d] += (p - ys).T @ xs
                    for k, i in enumerate(mine):
                        sums[i, 3 + d :] += ((xs * (p[:, k] * (1 - p[:, k]))[:, None]).T @ xs)[upper]
        if seen:
            for at in range(0, len(open_), 64):
                part = sums[at : at + 64]
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(open_[at : at + 64]), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["problem", "sums"])

    return run


def _fit_block(data: DataFrame, labels: np.ndarray, cells: Sequence[tuple[int, int]], d: int, penalty: float | None, max_iter: int, tolerance: float) -> np.ndarray:
    """Weights, (cell, label, d + 1), of a block of labels."""
    k = len(cells) * len(labels)
    w, step, loss = np.zeros((k, d + 1)), np.zeros((k, d + 1)), np.full(k, np.inf)
    halved, open_ = np.zeros(k, int), np.arange(k)
    upper = np.triu_indices(d + 1)
    for _ in range(max_iter + 1):
        if not len(open_):
            break
        tried = w[open_] + step[open_]
        part = data.mapInArrow(_partial_sums(labels, cells, open_, tried), "problem long, sums array<double>")
        found = {r["problem"]: np.array(r["sums"]) for r in vector_sum(part, "problem", col="sums").collect()}
        still = []
        for i, now in zip(open_.tolist(), tried, strict=True):
            if i not in found:
                continue  # a cell without rows keeps weights of 0
            n, positives, lost = found[i][:3]
            if positives in (0, n):
                w[i] = 0
                w[i, -1] = FIXED if positives else -FIXED
                continue
            ridge = np.full(d + 1, 1.0 if penalty is None else penalty * n)
            ridge[-1] = 0
            lost += 0.5 * float(ridge @ (now * now))
            if lost > loss[i] + 1e-12 * abs(loss[i]) and halved[i] < _MOST_HALVINGS:
                step[i] *= 0.5
                halved[i] += 1
                still.append(i)
                continue
            w[i], loss[i], halved[i] = now, lost, 0
            gradient = found[i][3 : 4 + d] + ridge * now
            if np.abs(gradient).max() < tolerance:
                continue
            curve = np.zeros((d + 1, d + 1))
            curve[upper] = found[i][4 + d :]
            curve = curve + np.triu(curve, 1).T + np.diag(ridge + 1e-12)
            step[i] = -np.linalg.solve(curve, gradient)
            still.append(i)
        open_ = np.array(still, int)
    return w.reshape(len(cells), len(labels), d + 1)


def fit_cells(
    data: DataFrame, universe: DataFrame, cells: Sequence[tuple[int, int]], *,
    reg_param: float | None = None, max_iter: int = 100, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(cell, label, coefficients, intercept)`` for every cell ``(number of the order, rows that train)`` and label of
    ``universe(label)``, from written ``data (vector, labels, positions ARRAY<BIGINT>)``. ``reg_param`` is the penalty
    for each row (default: 1 in all, an L2 penalty of strength C = 1 on the summed loss). ``max_iter`` bounds the passes."""
    spark = data.sparkSession
    d = data.agg(F.max(F.size("vector"))).first()[0] or 0
    data = data.select(F.col("vector").cast("array<double>").alias("vector"), F.col("labels").cast("array<int>").alias("labels"), F.col("positions").cast("array<bigint>").alias("positions"))
    numbered = write_table(global_index(universe.select(F.col("label").cast("int").alias("label")).distinct(), ["label"], out="i"), "labels")
    count = numbered.count()
    size = max(1, block_bytes // (8 * max(len(cells), 1) * ((d + 1) * (d + 4) // 2 + 3)))
    base = scratch_path(spark, "coefficients")
    for start in range(0, max(count, 1), size):
        block = numbered.where((F.col("i") >= start) & (F.col("i") < start + size)).collect()
        labels = np.array(sorted(r["label"] for r in block), np.int32)
        w = _fit_block(data, labels, cells, d, reg_param, max_iter, tolerance)
        rows = [(c, int(label), w[c, j, :-1].tolist(), float(w[c, j, -1])) for c in range(len(cells)) for j, label in enumerate(labels)]
        spark.createDataFrame(rows, _FITTED).coalesce(1).write.parquet(f"{base}/block={start}")
    return spark.read.parquet(base).select("cell", "label", "coefficients", "intercept")


def predict_cells(data: DataFrame, coefficients: DataFrame, cells: Sequence[tuple[int, int]], *, zero_k: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(cell, node, label, rank)``: for the rows of written ``data (node, vector, labels, positions)`` that a cell does not train
    the k best labels (ties by label), k being the row's number of labels. ``zero_k='all'`` predicts all for rows without any."""
    if zero_k not in ("none", "all"):
        raise ValueError("zero_k must be 'none' or 'all'")
    spark = data.sparkSession
    stored = write_table(global_index(coefficients, ["label", "cell"], out="i"), "coefficients")
    st = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("coefficients")).alias("d")).first()
    size = max(1, block_bytes // (8 * (int(st["d"] or 0) + 4)))
    rows = data.select("node", F.col("vector").cast("array<double>").alias("vector"), F.col("labels").cast("array<int>").alias("labels"), F.col("positions").cast("array<bigint>").alias("positions"))
    base = scratch_path(spark, "candidates")
    for start in range(0, max(int(st["n"]), 1), size):
        part = stored.where((F.col("i") >= start) & (F.col("i") < start + size)).orderBy("cell", "label").collect()
        model = {}
        for c in range(len(cells)):
            own = [r for r in part if r["cell"] == c]
            model[c] = (np.array([r["label"] for r in own], np.int32), np.array([[*r["coefficients"], r["intercept"]] for r in own]))
        rows.mapInArrow(_best(model, cells, zero_k == "all"), "cell int, node string, k int, label int, score double").write.parquet(f"{base}/block={start}")
    # a row's candidates: at most k for each block of labels
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))), F.lit(1), F.max("k"))
    found = spark.read.parquet(base).groupBy("cell", "node").agg(best.alias("best"))
    return found.select("cell", "node", F.posexplode("best").alias("i", "x")).select("cell", "node", "x.label", (F.col("i") + 1).alias("rank"))


def _best(model: dict, cells: Sequence[tuple[int, int]], all_for_none: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, positions, _ in _rows(batch, np.zeros(0, np.int32)):
                part = batch.slice(at, len(x))
                at += len(x)
                sizes = pc.fill_null(pc.list_value_length(part.column("labels")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if all_for_none:
                    sizes = np.where(sizes == 0, np.iinfo(np.int32).max, sizes)
                nodes = part.column("node")
                for c, (shuffle, cut) in enumerate(cells):
                    labels, w = model[c]
                    test = np.flatnonzero((positions[:, shuffle] >= cut) & (sizes > 0))
                    if not len(labels) or not len(test):
                        continue
                    score = 0.5 * (1 + np.tanh(0.5 * (x[test] @ w.T)))
                    order = np.argsort(-score, axis=1, kind="stable")  # labels are ascending: ties go to the smaller
                    taken = np.minimum(sizes[test], len(labels))
                    row = np.repeat(np.arange(len(test)), taken)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
                    pick = order[row, place]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), c, np.int32)), nodes.take(pa.array(test[row])), pa.array(sizes[test][row].astype(np.int32)), pa.array(labels[pick]), pa.array(score[row, pick])],
                        ["cell", "node", "k", "label", "score"],
                    )

    return run
