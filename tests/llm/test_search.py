"""Vantage-point trees against a full scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphvec.llm import vptree


def brute(rows, k, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if q % every:
            continue
        best = {}
        for i, v in fine:
            if i != q and len(v) == len(x):
                best[i] = max(best.get(i, -np.inf), float(np.cumsum(v * x)[-1]))
        ranked = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
        out.setdefault(q, []).append([(q, r, i, s) for r, (i, s) in enumerate(ranked, 1)])
    return sorted(t for lists in out.values() for one in lists for t in one)


def vectors(n=400, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=dim) * rng.uniform(0.2, 3)).tolist()) for i in range(n)]
    hot = rows[7][1]
    rows += [(n + i, hot) for i in range(150)]  # equal vectors: ties go to the smaller id
    rows += [(3000, None), (3005, []), (3010, [0.0] * dim), (3015, [1.0] * (dim - 1) + [None]), (3020, [math.nan] * dim), (3025, [math.inf] + [1.0] * (dim - 1))]
    rows += [(3030, [1.0, 2.0]), (3035, [2.0, 1.0]), (None, hot), (-20, hot)]
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_factor_one_is_exact(spark, kind):
    rows = vectors()
    if kind == "float":
        rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label string, rank int").repartition(4)
    got = vptree.search(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 7, 5)


def test_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [2.0, 0.0]), (1, [0.5, 0.5]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vptree.search(df, F.col("vec_id") % 5 == 0, k=20).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 5, 0.0), (5, 1, 1, 0.5), (5, 2, 0, 0.0)]
    assert vptree.search(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_recall_with_a_smaller_factor(spark):
    rows = [(i, v) for i, v in vectors(3000, 8, 2) if i is not None and i < 3000]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = {(q, i) for q, _, i, _ in brute(rows, 10, 50)}
    recall = []
    for factor in (0.3, 0.8):
        got = vptree.search(df, F.col("vec_id") % 50 == 0, k=10, factor=factor, shard_rows=1500).collect()
        recall.append(len(want & {(r.query_id, r.vec_id) for r in got}) / len(want))
    assert recall[1] >= 0.9 and recall[0] <= recall[1]
    with pytest.raises(ValueError):
        vptree.search(df, F.col("vec_id") == 0, factor=1.5)


def test_smaller_factor_visits_less():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 3))
    tree = vptree.Tree(points, float(np.linalg.norm(points, axis=1).max()), leaf=16)
    visits = []
    for factor in (0.2, 1.0):
        seen = [0]
        plain = vptree.Tree._visit

        def count(self, node, at, seen=seen, plain=plain):
            seen[0] += len(at) if isinstance(node, np.ndarray) else 0
            plain(self, node, at)

        vptree.Tree._visit = count
        try:
            score, _ = tree.search(points[::40], 5, factor)
        finally:
            vptree.Tree._visit = plain
        visits.append(seen[0])
    assert visits[0] < visits[1] < 100 * 250  # and the tree prunes at factor one too
    np.testing.assert_allclose(score, -np.sort(-(points[::40] @ points.T), axis=1)[:, :5])
