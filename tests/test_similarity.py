import numpy as np
import pytest
from pyspark.sql import functions as F

from graphvec.operators import similarity
from graphvec.operators.embed import vectors_from_mapping


def _model(spark, n=60, d=8, seed=0):
    rng = np.random.default_rng(seed)
    m = {str(i): rng.normal(size=d).astype(np.float32).tolist() for i in range(n)}
    m["zero"] = [0.0] * d
    return m, vectors_from_mapping(spark, m)


def _brute(m, q, k, exclude):
    words = list(m)
    mat = np.array([m[w] for w in words], dtype=np.float64)
    qv = np.array(m[q], dtype=np.float64)
    out = []
    for w, v in zip(words, mat):
        if exclude and w == q:
            continue
        den = np.linalg.norm(v) * np.linalg.norm(qv)
        out.append((-(0.0 if den == 0 else float(v @ qv / den)), w))
    return [w for _, w in sorted(out)[:k]]


@pytest.mark.parametrize("batch_bytes", [64 * 1024 * 1024, 200])
def test_nearest_by_word_matches_brute_force(spark, batch_bytes):
    m, v = _model(spark)
    q = v.select(F.col("word").alias("query"))
    got = similarity.nearest_by_word(v, q, 4, max_batch_bytes=batch_bytes).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query, r.rank)):
        by.setdefault(r.query, []).append(r.word)
    for w in m:
        if w == "zero":
            continue
        assert by[w] == _brute(m, w, 4, True)


def test_self_similarity_and_zero_vector(spark):
    m, v = _model(spark)
    q = spark.createDataFrame([("self", m["3"]), ("z", m["zero"])], "query string, vector array<float>")
    got = similarity.nearest_by_vector(v, q, 1).collect()
    d = {r.query: r for r in got}
    assert d["self"].word == "3" and abs(d["self"].similarity - 1.0) < 1e-9
    assert d["z"].similarity == 0.0
    norms = {r.word: r.norm for r in similarity.vector_norms(v).collect()}
    assert norms["zero"] == 0.0


def test_oov_strict_and_lax(spark):
    _, v = _model(spark)
    q = spark.createDataFrame([("1",), ("nope",)], "query string")
    with pytest.raises(similarity.VocabularyError):
        similarity.nearest_by_word(v, q, 2)
    lax = {r.query: r.vector for r in similarity.lookup(v, q, strict=False).collect()}
    assert lax["nope"] is None and lax["1"] is not None
    with pytest.raises(ValueError):
        similarity.nearest(v, q.join(v.select(F.col("word").alias("query"), "vector"), "query"), 0)


def test_vector_sum(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [1.0, 1.0])], "k string, vector array<double>")
    s = {r.k: list(r.vector) for r in similarity.vector_sum(df, "k").collect()}
    assert s == {"a": [4.0, 6.0], "b": [1.0, 1.0]}
    a = {r.k: list(r.vector) for r in similarity.vector_sum(df, "k", average=True).collect()}
    assert a["a"] == [2.0, 3.0]


def test_zero_query_and_ties_stay_bounded(spark):
    rows = [(f"w{i:05d}", [1.0, 0.0]) for i in range(5000)]
    v = spark.createDataFrame(rows, "word string, vector array<float>").repartition(4)
    q = spark.createDataFrame([("zero", [0.0, 0.0]), ("tie", [2.0, 0.0])], "query string, vector array<float>")
    got = similarity.nearest_by_vector(v, q, 3, product_bytes=4096).collect()
    want = {(n, f"w{i:05d}", s, i + 1) for n, s in (("zero", 0.0), ("tie", 1.0)) for i in range(3)}
    assert {(r.query, r.word, r.similarity, r["rank"]) for r in got} == want
    ids = np.arange(5000)
    batches = [_batch(ids[a : a + 100], np.tile([1.0, 0.0], (100, 1))) for a in range(0, 5000, 100)]
    run = similarity._local_topk(np.array([0]), np.zeros((1, 2)), None, 3, 1 << 20)
    assert sum(b.num_rows for b in run(iter(batches))) == 3  # a running top-k, not one for each batch


def _batch(ids, mat):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mat.tolist(), pa.list_(pa.float64()))], ["id", "vector"])


def test_many_queries_in_little_memory():
    """200,000 queries against 2,000 vectors: products stay within the budget."""
    import tracemalloc

    rng = np.random.default_rng(0)
    q = rng.normal(size=(200_000, 4))
    run = similarity._local_topk(np.arange(len(q)), q, None, 2, 1 << 22)
    tracemalloc.start()
    rows = 0
    for b in run(iter([_batch(np.arange(2000), rng.normal(size=(2000, 4)))])):
        rows += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400_000 and peak < 80e6  # all products at once would take 3.2 GB


@pytest.mark.parametrize("bad", [None, [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]])
def test_vectors_that_are_no_numbers_raise(spark, bad):
    fine = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    odd = spark.createDataFrame([("b", bad)], "word string, vector array<float>")
    ask = fine.select(F.col("word").alias("query"), "vector")
    with pytest.raises(ValueError):
        similarity.nearest_by_vector(fine.unionByName(odd), ask, 1)
    with pytest.raises(ValueError):
        similarity.nearest_by_vector(fine, ask.unionByName(odd.select(F.col("word").alias("query"), "vector")), 1)


def test_no_queries(spark):
    _, v = _model(spark, n=5)
    assert similarity.nearest_by_vector(v, v.limit(0).select(F.col("word").alias("query"), "vector"), 3).count() == 0
