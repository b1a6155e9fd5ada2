import numpy as np
import pytest
from pyspark.sql import functions as F

from graphvec.operators import corpus, evaluate


def _corpus(spark):
    rows = [(1, 0, ["a", "b", "a", "c"]), (2, 0, ["a", "b", "d"]), (3, 0, ["x"])]
    return spark.createDataFrame(rows, "start bigint, walk_no int, tokens array<string>")


def test_vocabulary_encode_chunk(spark):
    c = _corpus(spark)
    v = corpus.vocabulary(c, min_count=2)
    assert sorted((r.word, r.cn, r.word_idx) for r in v.collect()) == [("a", 3, 0), ("b", 2, 1)]
    assert corpus.corpus_size(v).first().train_words == 5
    enc = {r.start: r.ids for r in corpus.encode(c, v).collect()}
    assert enc == {1: [0, 1, 0], 2: [0, 1]}  # OOV dropped, empty sentence gone
    ch = sorted((r.start, r.chunk, r.ids) for r in corpus.chunk(corpus.encode(c, v), max_len=2).collect())
    assert ch == [(1, 0, [0, 1]), (1, 1, [0]), (2, 0, [0, 1])]


def test_skipgram_pairs_within_window(spark):
    c = _corpus(spark)
    pairs = corpus.skipgram_pairs(c, window=2, seed=9).collect()
    assert pairs
    for r in pairs:
        assert 1 <= abs(r.ctx_pos - r.pos) <= 2
    co = {(r.input, r.target): r.weight for r in corpus.cooccurrence(c, window=2).collect()}
    # in "a b a c": (a,a) at distance 2 -> 2 * (2-2+1)/2 = 1.0
    assert co[("a", "a")] == pytest.approx(1.0)


def test_f1_perfect_and_absent_label(spark):
    truth = spark.createDataFrame([("1", 0), ("2", 1)], "node string, label int")
    uni = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    r = evaluate.f1_scores(truth, truth, uni).first()
    assert r.micro_f1 == 1.0
    assert r.macro_f1 == pytest.approx(2.0 / 3.0)  # label 2 never seen counts 0


def test_topk_zero_k(spark):
    rows = [("n", [(0, 0.9), (1, 0.5)]), ("m", [(0, 0.1), (1, 0.7)]), ("t", [(5, 0.2), (4, 0.2), (6, 0.2)])]
    scores = spark.createDataFrame(rows, "node string, scores array<struct<label:int,score:double>>")
    k = spark.createDataFrame([("n", 0), ("m", 1), ("t", 2)], "node string, k int")
    none = sorted((r.node, r.label, r.rank) for r in evaluate.topk_labels(scores, k).collect())
    assert none == [("m", 1, 1), ("t", 4, 1), ("t", 5, 2)]
    allk = sorted((r.node, r.label) for r in evaluate.topk_labels(scores, k, zero_k="all").collect())
    assert allk == [("m", 1), ("n", 0), ("n", 1), ("t", 4), ("t", 5)]


@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_predict_topk_against_numpy(spark, budget):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(30, 3)), rng.normal(size=(11, 3)), rng.normal(size=11)
    w[7] = w[3]
    b[7] = b[3]  # a tie
    nodes = spark.createDataFrame([(str(i), v.tolist(), i % 5) for i, v in enumerate(x)], "node string, vector array<double>, k int")
    coef = spark.createDataFrame([(int(i) * 2, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(w, b))], "label int, coefficients array<double>, intercept double")
    got = {r.node: [(s.label, s.score) for s in r.scores] for r in evaluate.predict_topk(nodes, coef, block_bytes=budget).collect()}
    p = 1 / (1 + np.exp(-(x @ w.T + b)))
    for i in range(30):
        want = sorted(range(11), key=lambda j: (-p[i, j], j))[: i % 5]
        assert [s for s, _ in got[str(i)]] == [2 * j for j in want]
        np.testing.assert_allclose([s for _, s in got[str(i)]], p[i, want])


def test_one_vs_rest_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), (rng.normal(size=2) + [4 * (i % 2), 0]).tolist(), [i % 2, 7]) for i in range(120)]
    data = spark.createDataFrame(rows, "node string, vector array<float>, labels array<int>")
    uni = spark.createDataFrame([(0,), (1,), (7,), (9,)], "label int")
    coef = evaluate.fit_one_vs_rest(data, uni, max_iter=50)
    assert sorted(r.label for r in coef.collect()) == [0, 1, 7, 9]
    best = evaluate.predict_topk(data.withColumn("k", F.lit(2)), coef).collect()
    right = [[s.label for s in r.scores] == [7, int(r.node) % 2] for r in best]
    assert np.mean(right) > 0.95


def test_grid_counts(spark):
    vec = spark.createDataFrame([(str(i), [float(i % 3), 1.0 + i % 3]) for i in range(40)], "word string, vector array<float>")
    lab = spark.createDataFrame([(str(i), i % 3) for i in range(40)] + [("1", 2)], "node string, label int")
    rows = evaluate.evaluation_grid(vec, lab, train_percents=(0.25, 0.5), num_shuffles=2, max_iter=10).collect()
    assert sorted((r.train_percent, r.shuffle, r.n_train, r.n_test) for r in rows) == [(0.25, 0, 10, 30), (0.25, 1, 10, 30), (0.5, 0, 20, 20), (0.5, 1, 20, 20)]
    assert all(r.n_predicted == r.n_true and 0 <= r.macro_f1 <= 1 for r in rows)


def test_split_exact_and_multi_hot(spark):
    nodes = spark.range(1000).select(F.col("id").cast("string").alias("node"))
    s = evaluate.split_nodes(nodes, 0.3, seed=500, shuffle_no=0)
    assert s.where("is_train").count() == 300
    s2 = evaluate.split_nodes(nodes, 0.3, seed=500, shuffle_no=1)
    a = {r.node for r in s.where("is_train").collect()}
    b = {r.node for r in s2.where("is_train").collect()}
    assert a != b
    labels = spark.createDataFrame([("1", 3), ("1", 5), ("2", 5)], "node string, label int")
    uni = spark.createDataFrame([("x", 3), ("x", 5), ("x", 7)], "node string, label int")
    positions = evaluate.label_positions(uni)
    mh = evaluate.multi_hot(labels, positions)
    assert {r.node: r.ones for r in mh.collect()} == {"1": [0, 1], "2": [1]}
    back = {r.node: r.labels for r in evaluate.multi_hot_decode(mh, positions).collect()}
    assert back == {"1": [3, 5], "2": [5]}
    none = spark.createDataFrame([("z", [])], "node string, ones array<bigint>")
    assert evaluate.multi_hot_decode(none, positions).first().labels == []


def test_node_without_labels_kept(spark):
    vec = spark.createDataFrame([("1", [1.0]), ("9", [2.0])], "word string, vector array<float>")
    labels = spark.createDataFrame([("1", 0)], "node string, label int")
    f = {r.node: r.labels for r in evaluate.features_with_labels(vec, labels).collect()}
    assert f == {"1": [0], "9": []}


def test_vocabulary_empty_after_min_count(spark):
    c = _corpus(spark)
    v = corpus.vocabulary(c, min_count=100)
    assert v.count() == 0
    assert corpus.corpus_size(v).first().train_words == 0
    assert corpus.encode(c, v).count() == 0
