"""Jaccard join and substring dedup against brute force, components, repeated-value counts."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_plain import brute_components, brute_substring, sets

from graphvec.llm import jaccard, substring
from graphvec.llm.components import components
from graphvec.llm.repeats import find_repeats

def corpus(seed, n=60):
    """Copies, near copies, shared passages, a hot group, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(45)]
    rows, base = [], None
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.35:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[rng.randint(0, 12):]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
            if kind > 0.7:
                at = rng.randint(0, len(words))
                words[at:at] = passage[rng.randint(0, 10):]
            if len(words) > 60:
                base = words
        text = " ".join(words)
        rows.append((i * 3 - 20, text.upper() if rng.random() < 0.1 else text))
    rows += [(900 + i, "same text again and again " * 12) for i in range(25)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A b"), (1005, "a b c d e"), (1006, "a  b c d e f"), (1007, "b a"), (1008, "É é"), (1009, "é é")]
    rows += [rows[5], rows[5], (None, rows[8][1]), (None, rows[8][1]), (None, "alone in the world of words today")]
    rows += [(rows[9][0], rows[11][1])]  # one doc_id, another text
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(documents, seed):
    rows = corpus(seed)
    got = [tuple(r) for r in jaccard.join_components(documents(rows)).collect()]
    assert Counter(got) == Counter(brute_components(rows)[0])


def test_jaccard_keeps_one_of_each_group(documents):
    rows = corpus(4)
    root = brute_components(rows)[1]
    want, seen = Counter(), {}
    for (d, t), r in zip(rows, root):
        if not sets(t):
            want[d, t] += 1
        else:
            seen.setdefault(r, []).append((d is None, d, t))
    for group in seen.values():
        first = min(group, key=lambda x: (x[0], x[1] or 0))
        want[first[1], first[2]] += 1
    got = jaccard.keep_first(documents(rows))
    assert got.columns == documents(rows).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_jaccard_no_documents(documents):
    assert jaccard.join_components(documents([])).count() == 0
    assert jaccard.keep_first(documents([])).count() == 0
    only = documents([(1, None), (2, "")])
    assert sorted(tuple(r) for r in jaccard.join_components(only).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_jaccard_rejects_bad_similarity(documents):
    with pytest.raises(ValueError):
        jaccard.join_components(documents([(1, "a")]), similarity=0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring(documents, seed, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", 500)  # several chunks
    rows = corpus(seed) + [(2000, "der " * 500), (2001, "x " + "der " * 60)]
    got = [tuple(r) for r in substring.digests(documents(rows)).collect()]
    assert Counter(got) == Counter(brute_substring(rows))


def test_substring_texts(documents):
    rows = corpus(5)
    docs = documents(rows)
    got = substring.remove_repeats(docs)
    assert got.schema == docs.schema
    want = {(d, n, gone): sha for d, n, gone, sha in brute_substring(rows)}
    texts = {(d, t) for d, t in rows}
    for r in got.collect():
        if (r.doc_id, r.text) in texts:
            continue  # nothing removed: the text as it was
        assert r.n_chars == len(r.text)
        assert hashlib.sha256(r.text.encode()).hexdigest() in {v for k, v in want.items() if k[0] == r.doc_id}
    changed = sum(g > 0 for _, _, g, _ in brute_substring(rows))
    assert changed == sum((r.doc_id, r.text) not in texts for r in got.collect())


def test_substring_no_documents(documents):
    assert substring.digests(documents([])).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    got = substring.digests(documents([(1, None), (2, " ")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, empty), (2, 0, 0, empty)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 70)]
    star = [(500, 500 + i) for i in range(1, 60)]
    links = chain + star + [(3, 3), (900, 901), (901, 900)]
    names = {x: rng.randrange(10**9) for x in {y for e in links for y in e}}
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    groups = [{names[x] for e in part for x in e} for part in (chain, star, [(900, 901)])]
    assert got == {x: min(g) for g in groups for x in g}
    assert components(edges.limit(0)).count() == 0


def test_repeats_lose_none(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 20_000, dtype=np.int64)
    twice = values[:300]
    often = values[300:310]
    rows = np.concatenate([values, twice, np.repeat(often, 100)])
    df = spark.createDataFrame([(int(x),) for x in rng.permutation(rows)], "v long").repartition(5)

    def read(b: pa.RecordBatch):
        yield b.column("v").to_numpy().astype(np.uint64)

    seen = find_repeats(df, ["v"], read)
    assert seen.repeated(twice.astype(np.uint64)).all() and seen.repeated(often.astype(np.uint64)).all()
    assert seen.repeated(values[400:].astype(np.uint64)).mean() < 0.01
    assert (seen.level(often.astype(np.uint64)) >= 6).all()
    assert (seen.level(values[400:].astype(np.uint64)) == 0).mean() > 0.99


def test_similarity_links_against_all_pairs(documents):
    """Every linked pair, those inside a component too."""
    rng, rows = random.Random(11), []
    for family in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(60)] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "a  B"), (204, rows[0][1]), (None, rows[13][1] + " tail")]

    def brute(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    links, member = jaccard.similarity_links(documents(rows))
    sets = {i: brute(t) for i, t in rows}
    classes = {}
    for r in member.collect():
        assert r.n_shingles == len(sets[r.doc_id])
        assert classes.setdefault(r.node, sets[r.doc_id]) == sets[r.doc_id]
    live = {s for s in sets.values() if s}
    assert sorted(map(len, (s for s in classes.values() if s))) == sorted(map(len, live))
    got = [frozenset((classes[r.a], classes[r.b])) for r in links.collect()]
    want = {frozenset((x, y)) for x in live for y in live if x != y and 100 * len(x & y) >= 75 * len(x | y)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def near_copies(n=150, words=100):
    """Copies of one text with one or two words changed; the text itself is not among them."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for k, at in enumerate(rng.sample(range(5, words - 5), 1 + i % 3 // 2)):
            text[at] = f"x{i}k{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_near_copies_without_their_original_are_not_compared_in_pairs(documents, monkeypatch):
    rows, counts, real = near_copies(), [], jaccard.write_table

    def write(df, name):
        out = real(df, name)
        counts.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(jaccard, "write_table", write)
    got = [tuple(r) for r in jaccard.join_components(documents(rows)).collect()]
    assert Counter(got) == Counter(brute_components(rows)[0])
    assert max(counts) < 8 * len(rows)


def test_sketches_never_hide_a_link(spark):
    rng, t = np.random.default_rng(6), Fraction(3, 4)
    rows, linked = [], []
    for _ in range(300):
        size, away = int(rng.integers(1, 9_000)), rng.random(2) * 0.25
        whole = rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64)
        a, b = (whole[rng.random(size) >= x] for x in away)
        more = rng.integers(0, 1 << 63, (2, int(rng.integers(0, 1 + size // 20))), dtype=np.int64)  # shared with others, not with each other
        a, b = (np.concatenate([x, y.astype(np.uint64)]) for x, y in zip((a, b), more, strict=True))
        ka, kb = jaccard._sketch(a), jaccard._sketch(b)
        ones = [int(np.unpackbits(k.view(np.uint8)).sum()) for k in (ka, kb)]
        rows.append((len(rows), len(a), len(b), len(a), len(b), ka.tolist(), kb.tolist(), *ones))
        same = len(np.intersect1d(a, b))
        linked.append(same * 4 >= (len(a) + len(b) - same) * 3)
    df = spark.createDataFrame(rows, "i int, an long, bn long, am long, bm long, ak array<long>, bk array<long>, ac int, bc int")
    allowed = {r.i for r in df.where(jaccard._sketches_allow(t)).collect()}
    assert {i for i, x in enumerate(linked) if x} <= allowed and 50 < sum(linked) < 250
    assert len(allowed) < 290
    assert df.withColumn("ak", F.lit(None).cast("array<long>")).where(jaccard._sketches_allow(t)).count() == len(rows)
