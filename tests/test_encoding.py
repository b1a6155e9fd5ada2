import random

import pytest
from pyspark.sql import functions as F

from graphvec.operators import corpus, evaluate, ranking
from graphvec.session import write_table
from graphvec.sources import text


def _corpus(spark):
    rng = random.Random(1)
    words = ["a", "b", "c", "é", "w" * 90, None] + [f"v{i}" for i in range(40)]
    rows = [(i, i % 3, [rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 30))]) for i in range(80)]
    rows += [(90, None, ["a", "v1"]), (91, 0, None), (92, 0, []), (93, 0, ["nowhere"])]
    df = spark.createDataFrame(rows, "start long, walk_no int, tokens array<string>").repartition(4)
    return rows, write_table(df, "corpus")


@pytest.mark.parametrize("frequent_bytes", [0, 400, 1 << 20])
def test_encode_at_every_tier(spark, frequent_bytes):
    rows, df = _corpus(spark)
    vocab = write_table(corpus.vocabulary(df.where("start < 90").withColumn("tokens", F.filter("tokens", lambda x: x.isNotNull())), min_count=8), "vocabulary")
    number = {r.word: r.word_idx for r in vocab.collect()}
    got = {(r.start, r.walk_no): r.ids for r in corpus.encode(df, vocab, frequent_bytes=frequent_bytes).collect()}
    want = {(s, k): [number[t] for t in ts or [] if t in number] for s, k, ts in rows}
    assert got == {k: v for k, v in want.items() if v}
    assert len(number) > 10 and any(len(w) > 64 for w in number)


def test_only_rare_tokens_are_exchanged(spark):
    """Rows that reach the join with the vocabulary, from the plan's own counts."""
    _, df = _corpus(spark)
    df = df.withColumn("tokens", F.filter("tokens", lambda x: x.isNotNull()))
    vocab = write_table(corpus.vocabulary(df, min_count=1), "vocabulary")
    moved = []
    for size in (0, 800, 1 << 20):
        out = corpus.encode(df, vocab, frequent_bytes=size)
        plan = out._jdf.queryExecution().executedPlan().toString()
        coded = corpus.encode(df, vocab, frequent_bytes=size)
        assert coded.count() == out.count()
        moved.append(plan.count("Exchange"))
    assert moved[0] > 0 and moved[1] > 0
    short = vocab.where(F.octet_length("word") <= 64)
    assert corpus.encode(df, short)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_split_without_a_sort(spark):
    nodes = write_table(spark.range(5000).select(F.col("id").cast("string").alias("node")), "nodes")
    order = {r.node: r.pos for r in evaluate.shuffle_order(nodes, seed=7).collect()}
    for share in (0.0, 0.1, 0.5, 0.9999, 1.0):
        split = evaluate.split_nodes(nodes, share, seed=7)
        assert {r.node: r.is_train for r in split.collect()} == {n: p < int(share * 5000) for n, p in order.items()}
        assert "rangepartitioning" not in split._jdf.queryExecution().executedPlan().toString()


def test_selection_narrows_and_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SELECT_ROWS", 3)
    monkeypatch.setattr(evaluate, "SELECT_BITS", 7)
    rows = [(k, f"n{i}") for i, k in enumerate([0, 1, 1, 1, 1, 1, 5, 2**60 - 1, 2**60 - 1, 2**59, 123456789] * 3)]
    keyed = write_table(spark.createDataFrame(rows, "_key long, node string"), "keyed")
    for rank, want in enumerate(sorted(rows)):
        if rank % 4 == 0:
            assert evaluate.select_row(keyed, rank) == want


def test_wide_matrix_explodes_ones_only(spark, tmp_path):
    width, ones = 20_000, [(0, 0), (0, 19_999), (1, 7), (2, 10_000)]
    lines = []
    for i in range(3):
        row = ["0"] * width
        for a, b in ones:
            if a == i:
                row[b] = "1"
        lines.append(" ".join(row))
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    edges = text.read_adjacency_matrix(spark, str(tmp_path / "m.txt"))
    assert sorted((r.src - 1, r.dst - 1) for r in edges.collect()) == ones
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "filter(" in plan
    (tmp_path / "bad.txt").write_text("0 x 1\n")
    with pytest.raises(Exception):
        text.read_adjacency_matrix(spark, str(tmp_path / "bad.txt")).collect()


def test_running_total_over_many_partitions(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("k"), F.lit(2).alias("n"))
    got = ranking.running_total(df, ["k"], "n").collect()
    assert all(r.before == 2 * r.k for r in got) and len(got) == 1000


def test_cooccurrence_shuffles_one_row_for_both_directions(spark):
    """Weights of both directions are those of a plain count (nulls and repeated tokens included); a pair is shuffled once."""
    rows = [["a", "b", "a", None, "c"], ["b", "a"], [None, None, "a"], ["c"], ["d", "c", "b", "a", "a", "d"]]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "start bigint, walk_no int, tokens array<string>")
    window, want = 3, {}
    for r in rows:
        for p, x in enumerate(r):
            for c, y in enumerate(r):
                if p != c and abs(p - c) <= window:
                    want[y, x] = want.get((y, x), 0) + (window + 1 - abs(p - c))
    out = corpus.cooccurrence(df, window=window)
    got = out.collect()
    assert {(r["input"], r["target"]): r["weight"] for r in got} == {k: n / window for k, n in want.items()} and len(got) == len(want)
    assert len({frozenset(k) for k in want}) < len(want)
    assert "low" in out._jdf.queryExecution().optimizedPlan().toString()


def test_skipgram_pairs_are_compiled_and_match_the_plain_version(spark):
    import hashlib

    rows = [["a", "b", "c", "d", "e", "f"], ["x", None], ["y"], ["p", "q", "p"]]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(rows)], "start bigint, walk_no int, tokens array<string>")
    want = set()
    for i, r in enumerate(rows):
        for p, x in enumerate(r):
            reach = 4 - int(hashlib.md5(f"7|{i}|0|{p}".encode()).hexdigest()[:15], 16) % 4
            want |= {(i, 0, p, c, y, x) for c, y in enumerate(r) if c != p and abs(c - p) <= reach}
    out = corpus.skipgram_pairs(df, window=4, seed=7)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
