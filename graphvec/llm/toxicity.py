"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each model sees the words and the probabilities of
the earlier categories. In training these probabilities are out of fold: for every category
``FOLDS`` models are fitted on the rows outside a fold and predict that fold, and one model on all
rows serves prediction. So a later model learns from earlier probabilities as noisy as it
will meet.

A text's features are its distinct words and their beginnings of ``BEGINNINGS`` bytes, hashed to ``1 << BITS``
columns. Weights are logistic, on columns scaled by their smoothed log ratio between the classes.
Fitting takes a sample of the labelled rows, drawn by a hash, bounded by ``train_rows`` (expected); the models have a fixed
size. Everything else runs over all rows in one pass without a shuffle.

Categories of the registered query, in order: ``low_quality`` (the label quality is 0), ``toxic`` (the
label), ``severe``: the toxic rows whose out-of-fold toxic score is above the median of the toxic rows, a
weak label that the chain makes itself. A document is rejected when its toxic probability
exceeds ``THRESHOLD``.

Defined results: null or empty texts have no features, probability 0 everywhere, and are kept.
Labels that are null or have no document are not learned from; of a doc_id labelled twice the larger
labels count. With no rows of either class a category's probability is the share of its class. An empty table returns no rows. Repeated
rows are judged alike. Extra columns do not matter; ``filter_toxic`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphvec.llm.text import blobs, pieces
from graphvec.session import bounded_batches, write_table

BITS, FOLDS, TRAIN_ROWS, THRESHOLD = 18, 4, 16_000, 0.4
BEGINNINGS = (4, 6)
#: Columns that a model may use, and the fewest rows of a column.
MOST_COLUMNS, LEAST_ROWS = 5_000, 3
_FOLD_CASE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(blob: bytes) -> np.ndarray:
    """Sorted distinct columns of a text: ASCII letters and all other non-ASCII bytes make words."""
    tokens = set(blob.translate(_FOLD_CASE).split())
    tokens |= {w[:n] + b"-" for n in BEGINNINGS for w in tokens if len(w) > n}
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    return np.unique(h & np.uint64((1 << BITS) - 1)).astype(np.int32)


class Linear(NamedTuple):
    """Weights of the columns, of the earlier probabilities' logits, and the bias."""

    columns: np.ndarray
    earlier: np.ndarray
    bias: float

    def score(self, at: np.ndarray, earlier: Sequence[float]) -> float:
        if not len(at):
            return 0.0
        z = self.bias + float(self.columns[at].sum()) + float(np.dot(self.earlier, _logit(np.asarray(earlier))))
        return float(_sigmoid(z))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, *, steps: int = 200, penalty: float = 1.0) -> Linear:
    """Logistic regression (sum of losses and ``penalty / 2`` times the squared weights) by accelerated
    full-batch gradients, each weight with a step from a bound of its curvature."""
    size = 1 << BITS
    weights = np.zeros(size, np.float32)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    if not len(y) or y.min() == y.max():
        return Linear(weights, np.zeros(earlier.shape[1]), float(np.log(share / (1 - share))))
    blocks = [slice(k, k + 1000) for k in range(0, len(rows), 1000)]
    pos, neg = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for b in blocks:
        for r, label in zip(rows[b], y[b], strict=True):
            (pos if label > 0 else neg)[r] += 1
    ratio = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((y == 0).sum() + 1))
    worth = np.where(pos + neg >= LEAST_ROWS, np.abs(ratio) * np.sqrt(pos + neg), 0.0)
    used = np.sort(np.argsort(-worth, kind="stable")[:MOST_COLUMNS])
    used = used[worth[used] > 0]
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    x = np.clip(ratio[used], -3, 3)
    parts = []  # a block's rows and columns in few bytes: an executor's other memory stands beside this
    for b in blocks:
        here = rows[b]
        c = place[np.concatenate(here)]
        o = np.repeat(np.arange(len(here), dtype=np.uint16), [len(r) for r in here])
        parts.append((slice(b.start, b.start + len(here)), o[c >= 0], c[c >= 0].astype(np.min_scalar_type(len(used)))))

    def by_row(per_column: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(o, per_column[c], b.stop - b.start) for b, o, c in parts])

    def by_column(times: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used))
        for b, o, c in parts:
            np.add.at(out, c.astype(np.intp), times[c] * per_row[b][o])
        return out

    extra = _logit(earlier)
    w, v, b = np.zeros(len(used)), np.zeros(extra.shape[1]), np.log(share / (1 - share))
    spread = by_row(np.abs(x)) + np.abs(extra).sum(axis=1) + 1
    rw = 1 / (by_column(np.abs(x), spread) / 4 + penalty)
    rv = 1 / (np.abs(extra).T @ spread / 4 + penalty)
    rb = 1 / (spread.sum() / 4)
    pw, pv, pb, run = w.copy(), v.copy(), b, 0
    for _ in range(steps):
        m, run = run / (run + 3), run + 1
        aw, av, ab = w + m * (w - pw), v + m * (v - pv), b + m * (b - pb)
        z = by_row(x * aw) + extra @ av + ab
        g = _sigmoid(z) - y
        pw, pv, pb = w, v, b
        w = aw - rw * (by_column(x, g) + penalty * aw)
        v = av - rv * (extra.T @ g + penalty * av)
        b = ab - rb * g.sum()
        if np.dot((aw - w) / rw, w - pw) > 0:
            run = 0  # the momentum points uphill
    weights[used] = w * x
    return Linear(weights, v, float(b))


class Chain(NamedTuple):
    names: list[str]
    models: list[Linear]

    def predict(self, blob: bytes) -> list[float]:
        at, out = features(blob), []
        for model in self.models:
            out.append(model.score(at, out))
        return out


def _label(c: str) -> Column:
    return F.max(F.when(F.col(c) == 1, 1.0).when(F.col(c) == 0, 0.0))


def training_rows(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A written sample ``(rid, fold, at, low_quality, toxic)`` of labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((1.0 - F.min(F.when(F.col("quality").isin(0, 1), F.col("quality")))).alias("low_quality"), _label("toxic").alias("toxic"))
    known = write_table(known.where(F.col("low_quality").isNotNull() & F.col("toxic").isNotNull()), "labelled")
    n = known.count()
    if n > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            at = [features(x).tobytes() for x in blobs(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at, pa.binary()), b.column("low_quality"), b.column("toxic")], ["rid", "at", "low_quality", "toxic"])

    out = rows.mapInArrow(run, "rid long, at binary, low_quality double, toxic double")
    return write_table(out.withColumn("fold", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(FOLDS)).cast("int")), "training")


def _fit_category(name: str, done: list[str]):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rid", "at"], kind="stable")
        out_of = int(key[0])
        rows = [np.frombuffer(x, np.int32) for x in part["at"]]
        y = part[name].to_numpy(np.float64)
        earlier = part[done].to_numpy(np.float64).reshape(len(part), len(done))
        learn = (part["fold"] != out_of).to_numpy()
        model = fit([r for r, x in zip(rows, learn, strict=True) if x], y[learn], earlier[learn])
        rest = np.flatnonzero(~learn)
        if out_of < FOLDS:
            p = [model.score(rows[i], earlier[i]) for i in rest]
            return pd.DataFrame({"rid": part["rid"].to_numpy()[rest], "p": p, "model": None})
        blob = model.columns.astype("<f4").tobytes() + np.asarray([*model.earlier, model.bias], "<f8").tobytes()
        return pd.DataFrame({"rid": [None], "p": [None], "model": [blob]})

    return run


def learn(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Chain:
    """The chain. A model is 1 MB; each fold's fit is one task over the bounded sample."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, train_rows=train_rows)
    done: list[str] = []
    models: list[Linear] = []
    for name in ("low_quality", "toxic", "severe"):
        if name == "severe":
            toxic = rows.where("toxic = 1").agg(F.expr("percentile(p_toxic, 0.5)").alias("m")).first()["m"]
            rows = rows.withColumn("severe", F.when((F.col("toxic") == 1) & (F.col("p_toxic") > F.lit(toxic)), 1.0).otherwise(0.0))
        tasks = rows.select("rid", "fold", "at", name, *done).withColumn("out_of", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        found = tasks.groupBy("out_of").applyInPandas(_fit_category(name, done), "rid long, p double, model binary")
        found = write_table(found, "fitted")
        model = found.where(F.col("model").isNotNull()).first()
        if model is None:
            return Chain([], [])
        cut = 4 << BITS
        tail = np.frombuffer(model["model"][cut:], "<f8")
        models.append(Linear(np.frombuffer(model["model"][:cut], "<f4"), tail[:-1], float(tail[-1])))
        fold = found.where(F.col("rid").isNotNull()).select("rid", F.col("p").alias(f"p_{name}")).dropDuplicates(["rid"])
        rows = write_table(rows.join(fold, "rid"), "training")
        done.append(f"p_{name}")
    return Chain(["low_quality", "toxic", "severe"], models)


def predict(docs: DataFrame, chain: Chain, *, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, p_low_quality, p_toxic, p_severe, toxic)`` of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", "p_low_quality", "p_toxic", "p_severe", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            p = np.array([shared.value.predict(x) or [0.0] * 3 for x in blobs(b.column("text"))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, i]) for i in range(3)), pa.array(p[:, 1] > threshold)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, p_severe double, toxic boolean")


def filter_toxic(docs: DataFrame, chain: Chain, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            p = [(shared.value.predict(x) or [0.0] * 3)[1] for x in blobs(b.column("text"))]
            yield b.filter(pa.array([x <= threshold for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
