"""Multi-label evaluation of embeddings: label sets, multi-hot coding, an
exact seeded train/test split, per-node top-k labels, micro/macro F1, and a
one-vs-rest logistic-regression scorer.

Labels are long form ``(node STRING, label INT)``. Multi-hot codes are the positions of a node's
labels in the ordered label universe, which stays a table. A node's scores are compared with all
labels inside its row, in blocks of labels of bounded size, and only its best k leave the row; predictions and
truth are compared as ``(node, label)`` pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.functions.hashing import HASH_BITS, hash_int60
from graphvec.operators.logistic import fit_cells, predict_cells
from graphvec.operators.ranking import global_index, index_within
from graphvec.session import write_table

#: Leading bits of a key that a selection counts at a time, and rows that it sorts in the end.
SELECT_BITS, SELECT_ROWS = 12, 10_000
#: Bytes of one block of coefficients sent to the tasks, and of one product there.
BLOCK_BYTES = 16 * 1024 * 1024


def label_sets(labels: DataFrame) -> DataFrame:
    """``(node, labels ARRAY<INT>)`` sorted, duplicates removed."""
    return labels.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def label_universe(labels: DataFrame) -> DataFrame:
    """Distinct labels ``(label)``."""
    return labels.select("label").distinct()


def label_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("label").alias("num_labels"))


def nodes_with_features(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Graph vertices that have a vector: ``nodes(vertex)`` semi-joined with
    the model on the string id (no contiguous-id assumption)."""
    return nodes.select(F.col("vertex").cast("string").alias("node")).join(
        vectors.select(F.col("word").alias("node")), "node", "left_semi"
    )


def features_with_labels(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, vector, labels)``: every node with a vector; nodes without a
    label row get an empty label set."""
    ls = label_sets(labels)
    return vectors.select(F.col("word").alias("node"), "vector").join(ls, "node", "left").select(
        "node", "vector", F.coalesce("labels", F.array().cast("array<int>")).alias("labels")
    )


def label_positions(labels: DataFrame) -> DataFrame:
    """``(label, pos)``: the label universe in order, numbered from 0."""
    return write_table(global_index(label_universe(labels), ["label"], out="pos"), "label_positions")


def multi_hot(labels: DataFrame, positions: DataFrame) -> DataFrame:
    """``(node, ones ARRAY<BIGINT>)``: the positions, ascending, at which the node's multi-hot
    vector holds a 1."""
    coded = labels.select("node", "label").join(positions, "label")
    return coded.groupBy("node").agg(F.array_sort(F.collect_set("pos")).alias("ones"))


def multi_hot_decode(coded: DataFrame, positions: DataFrame) -> DataFrame:
    """Back from ``(node, ones)`` to ``(node, labels)``; a node without ones has no labels."""
    pairs = coded.select("node", F.explode_outer("ones").alias("pos")).join(positions, "pos", "left")
    return pairs.groupBy("node").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def shuffle_order(nodes: DataFrame, *, seed: int = 500, shuffle_no: int = 0) -> DataFrame:
    """``(node, pos)``: the nodes in the seeded order ``md5(seed|shuffle_no|node)`` (ties by
    node), numbered from 0. One distributed sort serves every training share."""
    keyed = nodes.select("node").withColumn("_key", hash_int60(seed, F.lit(shuffle_no), "node"))
    return global_index(keyed, ["_key", "node"], out="pos").select("node", "pos")


def split_nodes(
    nodes: DataFrame, train_fraction: float, *, seed: int = 500, shuffle_no: int = 0
) -> DataFrame:
    """``(node, is_train)``: the first ``int(train_fraction * n)`` nodes of the shuffle train, the rest test (``node`` is
    unique). Nothing is sorted: the key of the first test node is selected by counts."""
    if not 0.0 <= train_fraction <= 1.0:
        raise ValueError("train_fraction must be in [0, 1]")
    keyed = nodes.select("node", hash_int60(seed, F.lit(shuffle_no), "node").alias("_key"))
    n = keyed.count()
    first = select_row(keyed, int(train_fraction * n)) if int(train_fraction * n) < n else None
    if first is None:
        return keyed.select("node", F.lit(True).alias("is_train"))
    key, node = first
    before = (F.col("_key") < F.lit(key)) | ((F.col("_key") == F.lit(key)) & (F.col("node") < F.lit(node)))
    return keyed.select("node", before.alias("is_train"))


def select_row(keyed: DataFrame, rank: int) -> tuple[int, str]:
    """The row ``(_key, node)`` with ``rank`` rows before it in that order. A histogram of the keys' leading bits names the bin
    that holds it, one of the bin's next bits a narrower one, until the bin's few rows can be sorted: two or three passes
    that return ``2**SELECT_BITS`` counts each."""
    low, width = 0, HASH_BITS
    while True:
        inside = keyed.where(F.col("_key").between(low, low + (1 << width) - 1))
        if width == 0:
            break
        width = max(0, width - SELECT_BITS)
        bins = inside.groupBy(F.shiftright(F.col("_key") - F.lit(low).cast("long"), width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(bins.collect()):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low += r["bin"] << width
        if r["n"] <= SELECT_ROWS:
            inside = keyed.where(F.col("_key").between(low, low + (1 << width) - 1))
            break
    r = inside.orderBy("_key", "node").limit(rank + 1).collect()[-1]
    return r["_key"], r["node"]


def topk_labels(
    scores: DataFrame, k_per_node: DataFrame, *, zero_k: str = "none"
) -> DataFrame:
    """``(node, label, rank)``: each node's ``k`` best labels by score (ties by label) from
    ``scores(node, scores ARRAY<STRUCT<label, score>>)``, sorted in the row. ``k_per_node(node, k)``;
    nodes missing there predict nothing. ``zero_k='all'`` makes k=0 predict every label (the
    quirk of a ``[-0:]`` slice); the default predicts none."""
    if zero_k not in ("none", "all"):
        raise ValueError("zero_k must be 'none' or 'all'")
    s = scores.select("node", "scores").join(k_per_node.select("node", "k"), "node")
    ranked = F.array_sort(F.transform("scores", lambda x: F.struct((-x["score"]).alias("s"), x["label"].alias("label"))))
    k = F.when(F.col("k") > 0, F.col("k")).otherwise(F.size("scores") if zero_k == "all" else F.lit(0))
    best = F.slice(ranked, F.lit(1), k.cast("int"))
    return s.select("node", F.posexplode(best).alias("_i", "x")).select("node", "x.label", (F.col("_i") + 1).alias("rank"))


def f1_scores(truth: DataFrame, pred: DataFrame, universe: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, micro_f1, macro_f1, tp, fp, fn)``, one row for each value of ``by`` found in truth or prediction (one row
    if ``by`` is empty). Micro pools all labels; macro averages per-label F1 over the whole
    ``universe(label)``, labels never seen in truth or prediction counting 0."""
    by = list(by)
    t = truth.select(*by, "node", "label").distinct().withColumn("_t", F.lit(1))
    p = pred.select(*by, "node", "label").distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [*by, "node", "label"], "full_outer")
    hit, miss = F.col("_t").isNotNull(), F.col("_p").isNotNull()
    per_label = both.groupBy(*by, "label").agg(
        F.sum((hit & miss).cast("bigint")).alias("tp"),
        F.sum((~hit & miss).cast("bigint")).alias("fp"),
        F.sum((hit & ~miss).cast("bigint")).alias("fn"),
    )
    n = universe.select("label").distinct().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    known = per_label.join(universe.select("label").distinct().withColumn("_u", F.lit(1)), "label", "left")
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    known = known.where(F.col("_u").isNotNull()).withColumn("f1", F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / den))
    agg = known.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
        (F.coalesce(F.sum("f1"), F.lit(0.0)) / F.lit(float(max(n, 1)))).alias("macro_f1"),
    )
    return agg.select(*by, F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / den).alias("micro_f1"), "macro_f1", "tp", "fp", "fn")


def f1_mean(results: DataFrame) -> DataFrame:
    """Mean of each metric per training share over shuffles."""
    return results.groupBy("train_percent").agg(
        F.avg("micro_f1").alias("micro_f1"), F.avg("macro_f1").alias("macro_f1"), F.count(F.lit(1)).alias("shuffles")
    )


# ---------------------------------------------------------------- classifier

def label_means(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, coefficients, intercept)``: each label's mean vector as a scorer's weights."""
    rows = labels.select(F.col("node").alias("word"), "label").join(vectors, "word")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>"))))
    return rows.groupBy("label").agg(mean.alias("coefficients")).withColumn("intercept", F.lit(0.0))


def fit_one_vs_rest(train: DataFrame, universe: DataFrame, *, reg_param: float | None = None, max_iter: int = 100, **settings) -> DataFrame:
    """``(label, coefficients, intercept)``: one binary logistic regression for each label of ``universe(label)`` on
    ``train(node, vector, labels)``, all fitted in the same passes (``logistic``). ``reg_param`` is the penalty for each row; it
    defaults to ``1/n`` (an L2 penalty of strength C=1 on the summed loss). A label that all or no rows have scores by that."""
    data = write_table(train.select("vector", "labels", F.array(F.lit(0)).alias("positions")), "training_rows")
    return fit_cells(data, universe, [(0, 1)], reg_param=reg_param, max_iter=max_iter, **settings).drop("cell")


def predict_topk(nodes: DataFrame, coefficients: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(node, scores ARRAY<STRUCT<label, score>>)``: for ``nodes(node, vector, k)`` the probabilities
    ``1 / (1 + exp(-(w x + b)))`` of the node's ``k`` best labels (ties by label), best first.

    The coefficients are taken in blocks of bounded size, in the order of labels. Each block is one narrow
    pass over the nodes, which carry their best so far, and is written before the next is read."""
    coefficients = write_table(global_index(coefficients, ["label"], out="i"), "coefficients")
    st = coefficients.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("coefficients")).alias("d")).first()
    count, dim = int(st["n"]), int(st["d"] or 0)
    size = max(1, block_bytes // (8 * (dim + 4)))
    best = F.array().cast("array<struct<label:int,score:double>>")
    now = nodes.select("node", F.col("vector").cast("array<double>").alias("vector"), F.col("k").cast("int").alias("k"), best.alias("scores"))
    schema = "node string, vector array<double>, k int, scores array<struct<label:int,score:double>>"
    for start in range(0, count, size):
        rows = coefficients.where((F.col("i") >= start) & (F.col("i") < start + size)).orderBy("i").collect()
        labels = np.array([r["label"] for r in rows], np.int32)
        w = np.array([r["coefficients"] for r in rows], np.float64)
        b = np.array([r["intercept"] for r in rows], np.float64)
        now = write_table(now.mapInArrow(_scorer(labels, w, b, block_bytes), schema), "scored")
    return now.select("node", "scores")


def _scorer(labels: np.ndarray, w: np.ndarray, b: np.ndarray, budget: int):
    def run(batches):
        kind = pa.list_(pa.struct([("label", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            piece = max(1, budget // (8 * len(labels)))
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                x = pc.list_flatten(part.column("vector")).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(x @ w.T + b)))
                out = []
                for row, k, had in zip(p, part.column("k").to_pylist(), part.column("scores").to_pylist(), strict=True):
                    ids = np.concatenate([np.array([h["label"] for h in had], np.int32), labels])
                    s = np.concatenate([np.array([h["score"] for h in had], np.float64), row])
                    top = np.lexsort((ids, -s))[: k or 0]
                    out.append([{"label": int(i), "score": float(v)} for i, v in zip(ids[top], s[top], strict=True)])
                cols = [part.column("node"), part.column("vector"), part.column("k"), pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "vector", "k", "scores"])

    return run


def shuffle_positions(nodes: DataFrame, num_shuffles: int, *, seed: int = 500) -> DataFrame:
    """``(node, positions ARRAY<BIGINT>)``: the place of each node in each of the seeded shuffles, from one
    numbering of all of them."""
    every = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(num_shuffles - 1))).alias("shuffle"))
    keyed = every.withColumn("_key", hash_int60(seed, "shuffle", "node"))
    ranked = index_within(keyed, "shuffle", ["_key", "node"], out="pos")
    return ranked.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("shuffle", "pos"))), lambda x: x["pos"]).alias("positions"))


def evaluate_split(vectors: DataFrame, labels: DataFrame, train_fraction: float, *, seed: int = 500, **settings) -> DataFrame:
    """Train on the first share of the first seeded shuffle, predict each test node's ``k`` = (its true label count) best
    labels, score micro/macro F1."""
    return evaluation_grid(vectors, labels, train_percents=[train_fraction], num_shuffles=1, seed=seed, **settings)


def evaluation_grid(
    vectors: DataFrame,
    labels: DataFrame,
    *,
    train_percents: Sequence[float] = (0.1, 0.5, 0.9),
    num_shuffles: int = 1,
    seed: int = 500,
    zero_k: str = "none",
    **fit_kw,
) -> DataFrame:
    """Every (share, shuffle) result (means: ``f1_mean``), all fitted, predicted and scored in the same jobs. ``zero_k`` as
    in ``topk_labels``."""
    data = features_with_labels(vectors, labels)
    data = write_table(data.join(shuffle_positions(data.select("node"), num_shuffles, seed=seed), "node"), "evaluated_rows")
    uni = write_table(label_universe(labels), "labels")
    n = data.count()
    grid = [(float(p), s, int(p * n)) for s in range(num_shuffles) for p in train_percents]
    cells = [(s, cut) for _, s, cut in grid]
    pred = predict_cells(data, fit_cells(data, uni, cells, **fit_kw), cells, zero_k=zero_k)
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(s).alias("shuffle"), F.lit(cut).cast("long").alias("cut")) for i, (s, cut) in enumerate(cells)])).alias("c")
    tested = data.select("node", "labels", "positions", cell).where(F.element_at("positions", F.col("c.shuffle") + 1) >= F.col("c.cut"))
    truth = tested.select("c.cell", "node", F.explode("labels").alias("label"))
    scored = f1_scores(truth, pred, uni, by=["cell"])
    named = vectors.sparkSession.createDataFrame([(i, *g, n - g[2]) for i, g in enumerate(grid)], "cell int, train_percent double, shuffle int, n_train long, n_test long")
    scored = named.join(scored, "cell", "left").na.fill(0)
    return scored.select(
        "train_percent", "shuffle", "micro_f1", "macro_f1", "n_train", "n_test",
        (F.col("tp") + F.col("fp")).alias("n_predicted"), (F.col("tp") + F.col("fn")).alias("n_true"),
    )
