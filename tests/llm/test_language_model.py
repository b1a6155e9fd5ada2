import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphvec.llm import language_model as lm

SMALL = lm.Sizes(classes=4, members=8, bands=3, hidden=6)


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]  # None: the end


def plain_base(rows):
    """doc -> (held_out, n_tokens, n_known, train_tokens, base_score), from the contract."""
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, out):
        c.update([] if h else plain_tokens(t))
    n, v = c.total(), len(c)
    found = []
    for (d, t), h in zip(rows, out):
        ts = plain_tokens(t)
        found.append((d, h, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts)))
    return found


def texts(seed=1, n=120):
    """Sentences in which a word tells the next ones, with rare, long and odd words."""
    rng = random.Random(seed)
    chains = {"a": "the Dog runs".split(), "b": "le chat dort".split(), "c": "der Hund schläft".split()}
    rows = []
    for i in range(n):
        words = [w for _ in range(rng.randint(1, 25)) for w in chains[rng.choice("abc")] * rng.randint(1, 2)]
        words += rng.sample(["É", "\u0085x", "x" * 90, "rare%d" % i, "shared%d" % (i % 9)], 2)
        rows.append((i, rng.choice([" ", "\n", "\v"]).join(words)))
    return rows + [(500, None), (501, ""), (502, "word " * 30_000), (None, "the dog"), (None, None)] + rows[:10]


def plain_score(m, v, counts, text):
    """Log10 probability token by token, one state, no lanes, no windows."""
    s, h, read, total = v.sizes, np.zeros(v.sizes.hidden), lm._end(v), 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    k = s.hidden
    found = lm.tokens((text or "").encode()) + [lm.END]
    for w in found:
        x, a = m["read"][read].astype(float), h @ m["keep"].astype(float)
        z, r = sig(x[:k] + a[:k]), sig(x[k : 2 * k] + a[k : 2 * k])
        c = np.tanh(x[2 * k :] + r * a[2 * k :])
        h = (1 - z) * c + z * h
        at = v.index.get(w, -1)
        symbol = int(v.symbol[at])
        softmax = lambda q: np.exp(q - q.max()) / np.exp(q - q.max()).sum()
        p = softmax(h @ m["to_class"] + m["class_bias"])
        if symbol < s.soft:
            cl = symbol // s.members
            total += math.log10(p[cl] * softmax(m["to_member"][cl] @ h + m["member_bias"][cl])[symbol % s.members])
        elif at >= 0:
            band = sum(int(n) for i, n in enumerate(v.counts) if v.symbol[i] == symbol)
            total += math.log10(p[symbol - s.soft + s.classes] * counts[w] / band)
        else:
            rest = [n for x, n in counts.items() if x not in v.index]
            total += math.log10(p[-1] * (counts.get(w, 0) + 0.1) / (sum(rest) + 0.1 * (len(rest) + 1)))
        read = symbol
    return total


def test_base_columns_and_scores_match_the_plain_version(documents, monkeypatch):
    rows = texts()
    docs = documents(rows).withColumns({c: F.lit(c) for c in ("word", "n", "row", "rare", "h", "symbols", "round", "held_out", "score", "base")})
    kept = {}
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda t, v, **kw: kept.setdefault("out", (real(t, v, **kw), v))[0])
    got = lm.score(docs, known=45, sizes=SMALL, share=0.8, rounds=2, replica_tokens=900).collect()
    (m, losses), v = kept["out"]
    assert len(losses) == 2 and len(got) == len(rows)
    want = plain_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=key)]
    assert np.allclose([r[5] for r in got], [r[5] for r in sorted(want, key=key)], rtol=1e-9)
    counts = Counter()
    for (_, t), w in zip(rows, want):
        counts.update([] if w[1] else lm.tokens((t or "").encode()) + [lm.END])
    assert v.total == counts.total() and 8 < len(v.index) <= 45 < len(counts)
    least = int(v.counts.min())
    assert set(v.index) == {w for w, n in counts.items() if n >= least} and sum(n >= least - 1 for n in counts.values()) > 45
    plain = sorted(((d, h, n, plain_score(m, v, counts, t)) for (d, t), (_, h, n, *_) in zip(rows, want)), key=key)
    assert np.allclose([r[6] for r in got], [r[3] for r in plain], rtol=2e-4)


def vocabulary(found, known=40):
    c = Counter(found)
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:known]
    return lm.Vocabulary(top, c.total(), len(c), SMALL)


def symbols(seed=3, n=30):
    rng = random.Random(seed)
    docs = [[b"w%d" % min(int(rng.expovariate(0.08)), 80) for _ in range(rng.randint(0, 40))] for _ in range(n)]
    v = vocabulary([w for d in docs for w in [*d, lm.END]])
    return v, [v.symbol[v.encode(d)].astype(np.int32) for d in docs]


def test_probabilities_sum_to_one():
    v, docs = symbols()
    m = lm.new_model(v)
    m, _, _ = lm.train_replica(m, SMALL, docs, lm._end(v), lanes=4, window=5)
    h = np.random.default_rng(1).normal(0, 1, (1, SMALL.hidden)).astype(np.float32)
    every = np.arange(SMALL.symbols)
    logs, _ = lm._output(m, SMALL, np.repeat(h, len(every), axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-5
    for band in set(v.symbol[SMALL.soft : len(v.counts)].tolist()):
        inside = (v.symbol == band) & (np.arange(len(v.symbol)) < len(v.counts))
        assert abs(np.exp(v.share[inside]).sum() - 1) < 1e-9


def test_starts_at_the_unigram_distribution():
    v, docs = symbols()
    m = lm.new_model(v)
    logs = lm.log_probabilities(m, SMALL, docs, lm._end(v))
    mass = v.mass / v.mass.sum()
    assert np.allclose(logs, [np.log(mass[d]).sum() for d in docs], rtol=1e-4)


def test_gradients_match_differences():
    v, docs = symbols(5, 6)
    m = {k: x.astype(np.float64) for k, x in lm.new_model(v).items()}
    rng = np.random.default_rng(2)
    m = {k: x + (0 if "bias" in k else rng.normal(0, 0.3, x.shape)) for k, x in m.items()}
    (read, want, fresh, _), *_ = lm.Lanes(docs, lm._end(v), 3, 12, even=True).windows()
    h = np.zeros((read.shape[1], SMALL.hidden))

    def loss(m):
        lost, n, *_ = lm._backward(m, SMALL, h, read, want, fresh)
        return lost / n

    g = lm._backward(m, SMALL, h, read, want, fresh)[2]
    for name in m:
        for at in [tuple(rng.integers(0, n) for n in m[name].shape) for _ in range(6)] + ([(int(read[1, 0]), 3)] if name == "read" else []):
            if m[name][at] < -1e6:
                continue
            near = {s: {**m, name: m[name].copy()} for s in (1, -1)}
            near[1][name][at] += 1e-2
            near[-1][name][at] -= 1e-2
            assert abs((loss(near[1]) - loss(near[-1])) / 2e-2 - g[name][at]) < 2e-3, name


@pytest.mark.parametrize("lanes,window", [(1, 7), (3, 4), (128, 32)])
def test_lanes_and_windows_do_not_change_scores(lanes, window):
    v, docs = symbols(7)
    m, _, _ = lm.train_replica(lm.new_model(v), SMALL, docs, lm._end(v), lanes=4)
    alone = [lm.log_probabilities(m, SMALL, [d], lm._end(v), lanes=1, window=10_000)[0] for d in docs]
    assert np.allclose(lm.log_probabilities(m, SMALL, docs, lm._end(v), lanes=lanes, window=window), alone, rtol=1e-4)


def test_learns_what_counts_cannot(documents):
    """Held-out texts whose words follow from each other score well above their base."""
    rows = [(i, " ".join((["the", "dog", "runs"] if i % 2 else ["le", "chat", "dort"]) * 12)) for i in range(900)]
    got = lm.score(documents(rows), sizes=SMALL, share=0.9, replica_tokens=20_000).where("held_out")
    r = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 30 and r.s > 0.5 * r.b


def test_empty_tables_and_no_training_rows(documents):
    assert lm.score(documents([(1, "x")]).limit(0), sizes=SMALL).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm.score(documents([(i, "some words") for i in held]), sizes=SMALL).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, abs(r.base_score) + abs(r.score)) for r in got] == [(3, 0, 0, 0.0)] * 3


def test_the_network_learns_from_every_training_row(documents, monkeypatch):
    rows = [(i, f"only{i} the same words again") for i in range(60)]
    seen, real = [], lm.write_table

    def write(df, name):
        seen.extend([df.count()] if name == "training_symbols" else [])
        return real(df, name)

    monkeypatch.setattr(lm, "write_table", write)
    got = lm.score(documents(rows), sizes=SMALL, rounds=1).collect()
    assert seen == [sum(not r["held_out"] for r in got)] and seen[0] > 40


def test_long_documents_do_not_cause_many_small_read_outs(monkeypatch):
    """One long document beside short ones: the states of its narrow steps are read out together."""
    v, docs = symbols(9)
    docs = [*docs, np.resize(np.concatenate(docs), 4_000)]
    sizes, real = [], lm._output
    monkeypatch.setattr(lm, "_output", lambda m, s, h, want, *rest: (sizes.append(len(want)), real(m, s, h, want, *rest))[1])
    logs = lm.log_probabilities(lm.new_model(v), SMALL, docs, lm._end(v), lanes=16, window=32)
    assert sum(sizes) == sum(map(len, docs)) and min(sizes[:-1]) >= 16 * 32
    mass = v.mass / v.mass.sum()
    assert np.allclose(logs, [np.log(mass[d]).sum() for d in docs], rtol=1e-4)


def test_sums_of_gradients_by_symbol():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.exponential(6, 700).astype(np.int32), 49)  # frequent and rare ones, some of none
    parts = [rng.normal(size=(700, 5)) for _ in range(3)]
    want = np.zeros((50, 15))
    np.add.at(want, ids, np.concatenate(parts, axis=1))
    assert np.allclose(lm._summed(parts, ids, 50, lm.Space()), want)


def test_logits_far_from_zero():
    h, place = np.array([[1.0], [-1.0]], np.float32), np.array([0, 1])
    with np.errstate(over="ignore"):
        logs, d = lm._softmax(h, np.array([[300.0, -300.0]], np.float32), np.zeros(2, np.float32), place, 1.0, lm.Space())
    assert np.allclose(logs, 0) and np.allclose(d, 0)


def test_texts_are_cut_into_words_once_for_training_and_scores(documents, monkeypatch):
    frames, real = {}, lm.write_table
    monkeypatch.setattr(lm, "write_table", lambda df, name: (frames.setdefault(name, df), real(df, name))[1])
    rows = [(i, f"only{i} the same words again") for i in range(40)]
    assert lm.score(documents(rows), sizes=SMALL, rounds=1).count() == 40
    reads_text = {k: "text" in df._jdf.queryExecution().optimizedPlan().toString() for k, df in frames.items()}
    assert {k for k, x in reads_text.items() if x} == {"word_counts", "coded"}
