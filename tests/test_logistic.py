import numpy as np
import pytest
from pyspark.sql import functions as F

from graphvec.operators import evaluate, logistic
from graphvec.session import write_table


def _data(spark, n=300, d=5, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    w = rng.normal(size=(labels, d)) * 2
    y = (x @ w.T + rng.logistic(size=(n, labels))) > 0.5
    y[:, 1] = False  # a label that nobody has
    y[:, 2] = True  # one that all have
    rows = [(str(i), x[i].tolist(), [10 * j for j in range(labels) if y[i, j]], [int(p) for p in (i, n - 1 - i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "node string, vector array<double>, labels array<int>, positions array<bigint>").repartition(5)
    uni = spark.createDataFrame([(10 * j,) for j in range(labels)], "label int")
    return write_table(df, "rows"), uni, x, y


def _plain(x, y, penalty=1.0):
    """Newton steps on one label, dense."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.r_[np.full(x.shape[1], penalty), 0]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (p - y) + ridge * w)
    return w


@pytest.mark.parametrize("block_bytes", [logistic.BLOCK_BYTES, 200])
def test_every_cell_and_label_against_a_plain_fit(spark, block_bytes):
    data, uni, x, y = _data(spark)
    cells = [(0, 100), (1, 50), (0, 300)]
    got = {(r.cell, r.label): np.array([*r.coefficients, r.intercept]) for r in logistic.fit_cells(data, uni, cells, block_bytes=block_bytes).collect()}
    assert len(got) == 12
    for c, rows in enumerate((slice(0, 100), slice(250, 300), slice(0, 300))):
        for j in (0, 3):
            assert np.allclose(got[c, 10 * j], _plain(x[rows], y[rows, j].astype(float)), atol=1e-5)
        assert got[c, 10][-1] == -logistic.FIXED and got[c, 20][-1] == logistic.FIXED


def test_penalty_by_row(spark):
    data, uni, x, y = _data(spark)
    fit = evaluate.fit_one_vs_rest(data, uni, reg_param=0.1).where("label = 30").first()
    assert np.allclose([*fit.coefficients, fit.intercept], _plain(x, y[:, 3].astype(float), 0.1 * len(x)), atol=1e-5)


def test_separable_rows_converge(spark):
    rows = [(str(i), [float(i)], [1] if i >= 10 else [], [i]) for i in range(20)]
    data = write_table(spark.createDataFrame(rows, "node string, vector array<double>, labels array<int>, positions array<bigint>"), "rows")
    fit = logistic.fit_cells(data, spark.createDataFrame([(1,)], "label int"), [(0, 20)]).first()
    assert np.allclose([*fit.coefficients, fit.intercept], _plain(np.arange(20.0)[:, None], np.arange(20) >= 10), atol=1e-4)


@pytest.mark.parametrize("zero_k", ["none", "all"])
@pytest.mark.parametrize("block_bytes", [logistic.BLOCK_BYTES, 200])
def test_predictions_against_plain(spark, zero_k, block_bytes):
    data, uni, x, y = _data(spark, n=80)
    data = write_table(data.withColumn("labels", F.when(F.col("node") == "70", F.array().cast("array<int>")).otherwise(F.col("labels"))), "rows")
    cells = [(0, 40), (1, 60)]
    fit = write_table(logistic.fit_cells(data, uni, cells), "fit")
    w = {(r.cell, r.label): np.array([*r.coefficients, r.intercept]) for r in fit.collect()}
    got = {(r.cell, r.node, r["rank"]): r.label for r in logistic.predict_cells(data, fit, cells, zero_k=zero_k, block_bytes=block_bytes).collect()}
    want = {}
    for c, (s, cut) in enumerate(cells):
        for i in range(80):
            if (i if s == 0 else 79 - i) < cut:
                continue
            k = int(y[i].sum()) if i != 70 else (4 if zero_k == "all" else 0)
            p = {j: 0.5 * (1 + np.tanh(0.5 * (np.r_[x[i], 1] @ w[c, j]))) for j in (0, 10, 20, 30)}
            for r, j in enumerate(sorted(p, key=lambda j: (-p[j], j))[:k]):
                want[c, str(i), r + 1] = j
    assert got == want


def test_jobs_do_not_grow_with_the_grid(spark):
    vec = spark.createDataFrame([(str(i), [float(i % 7), float(i % 3)]) for i in range(120)], "word string, vector array<double>")
    lab = spark.createDataFrame([(str(i), int(i % 7 > 3)) for i in range(120)], "node string, label int")
    tracker, group = spark.sparkContext.statusTracker(), []
    for name, shares, shuffles in (("small", (0.5,), 1), ("large", (0.2, 0.4, 0.6, 0.8), 4)):
        spark.sparkContext.setJobGroup(name, name)
        rows = evaluate.evaluation_grid(vec, lab, train_percents=shares, num_shuffles=shuffles, max_iter=6, tolerance=0.0).collect()
        assert len(rows) == len(shares) * shuffles and all(r.n_train + r.n_test == 120 for r in rows)
        group.append(len(tracker.getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert group[1] <= group[0] + 3, group


def test_positions_are_the_seeded_shuffles(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(50)], "node string")
    got = {r.node: r.positions for r in evaluate.shuffle_positions(nodes, 3, seed=7).collect()}
    for s in range(3):
        assert {n: p[s] for n, p in got.items()} == {r.node: r.pos for r in evaluate.shuffle_order(nodes, seed=7, shuffle_no=s).collect()}
