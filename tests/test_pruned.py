import numpy as np
import pytest

from graphvec.operators import pruned, similarity
from graphvec.session import write_table


def _table(spark, rows):
    return write_table(spark.createDataFrame([(w, [float(x) for x in v]) for w, v in rows], "word string, vector array<float>"), "vectors")


def clustered(n=600, d=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, d)) * 4
    return [(f"w{i}", middle[i % 12] + rng.normal(size=d) * 0.15) for i in range(n)]


def _same(a, b):
    one, two = ({(r.query, r["rank"]): (r.word, round(r.similarity, 9)) for r in x.collect()} for x in (a, b))
    assert one == two


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("rows", [clustered(), clustered(200, 3, 2)[:50] + [("zero", np.zeros(3)), ("zero2", np.zeros(3))]])
def test_equals_a_full_scan(spark, rows, exclude_self):
    vec = _table(spark, rows)
    index = pruned.build(vec, pivots=5, part_rows=40)
    asked = vec.selectExpr("word as query", "vector").where("pmod(hash(query), 7) = 0 or query like 'zero%'")
    got = pruned.search(index, asked, 8, exclude_self=exclude_self, block_queries=16)
    _same(got, similarity.nearest(vec, asked, 8, exclude_self=exclude_self))


def test_ties_repeated_vectors_and_few_words(spark):
    vec = _table(spark, [(f"t{i}", [1.0, 0.0] if i < 6 else [0.0, 1.0 + i]) for i in range(9)])
    asked = vec.selectExpr("word as query", "vector")
    index = pruned.build(vec, pivots=20, part_rows=2)
    _same(pruned.search(index, asked, 4, exclude_self=True), similarity.nearest(vec, asked, 4, exclude_self=True))
    _same(pruned.search(index, asked, 100, exclude_self=True), similarity.nearest(vec, asked, 100, exclude_self=True))


def test_files_that_cannot_matter_are_not_read(spark, monkeypatch):
    vec = _table(spark, clustered(1200))
    index = pruned.build(vec, pivots=12, part_rows=50)
    every = index.bounds.count()
    read = []
    real = pruned.F.col("part").__class__.isin

    def isin(self, *chosen):
        if chosen and isinstance(chosen[0], list):
            read.append(chosen[0])
        return real(self, *chosen)

    monkeypatch.setattr(pruned.F.col("part").__class__, "isin", isin)
    one = vec.where("word = 'w5'").selectExpr("word as query", "vector")
    got = pruned.search(index, one, 5, exclude_self=True).collect()
    monkeypatch.undo()
    parts = sorted({p for x in read for p in x})
    read_files, all_files = (x.select(pruned.F.input_file_name().alias("f")).distinct().count() for x in (index.parts.where(pruned.F.col("part").isin(parts)), index.parts))
    assert len(got) == 5 and every >= 20 and all_files >= 20
    assert 0 < read_files < 0.4 * all_files


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(300, 4))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, pivots = unit[:40], unit[40:46]
    part = unit[100:140]
    a = pruned._angles(part, pivots)
    best = pruned.reachable(pruned._angles(q, pivots), a.min(axis=0)[None], a.max(axis=0)[None])
    assert ((q @ part.T).max(axis=1) <= best[:, 0] + 1e-12).all()


def test_bad_input_and_empty_tables(spark):
    vec = _table(spark, clustered(30))
    with pytest.raises(ValueError):
        pruned.build(vec, pivots=0)
    index = pruned.build(vec)
    with pytest.raises(ValueError):
        pruned.search(index, vec.selectExpr("word as query", "vector"), 0)
    assert pruned.search(index, vec.selectExpr("word as query", "vector").limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        pruned.build(_table(spark, [("a", [float("nan"), 1.0])]))
