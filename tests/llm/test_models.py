"""Language identification, quality rules, toxicity: against plain versions and held-out rows."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_plain import prose

from graphvec.llm import langid, quality, toxicity

def language_rows():
    rng = random.Random(2)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], [5, 3, 2], k=300))]
    rows += [(400, None, "en"), (401, "", "de"), (402, "12 + 34 !!", "en"), (403, "x", "en"), (None, prose(rng, "de"), "de"), (404, prose(rng, "fr"), None)]
    return rows + [rows[0], (405, prose(rng, "de", 40_000), "de")]


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [f" {w} "[i : i + n] for w in words for n in langid.SIZES for i in range(len(w) + 3 - n)]


def test_language_against_exact_sets(documents):
    """With exact sets instead of filters: the same language, nearly the same score."""
    rows = language_rows()
    known = [(i, t, lang) for i, t, lang in rows if i is not None and lang and t is not None and __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    count, total, docs = defaultdict(Counter), Counter(), Counter(lang for _, _, lang in known)
    for _, t, lang in known:
        for g in brute_grams(t):
            count[lang][g] += 1
            total[lang, len(g)] += 1
    held = {lang: {g for g, k in c.items() if k >= max(2, langid.MIN_SHARE * total[lang, len(g)])} for lang, c in count.items()}
    got = langid.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    for r in got:
        grams = brute_grams(texts[r.doc_id][0] or "")
        if not any(c.isalpha() for c in texts[r.doc_id][0] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        hits = {lang: sum(g in s for g in grams) for lang, s in held.items()}
        best = max(hits, key=lambda x: (hits[x], docs[x]))
        if sorted(hits.values())[-1] - sorted(hits.values())[-2] > 2:
            assert r.lang_pred == best
            assert abs(r.score - hits[best] / sum(hits.values())) < 0.05
        assert 0 <= r.score <= 1
    out = {r.doc_id: r for r in got if r.doc_id is not None}
    right = [out[i].lang_pred == lang for i, t, lang in rows if i is not None and lang and t and out[i].held_out and len(t) > 100]
    assert len(right) > 40 and np.mean(right) > 0.98


def test_language_corrects_chance_hits():
    """A crowded filter hits half of a text by chance; corrected, hardly anything is left."""
    rng = np.random.default_rng(0)
    slots = (rng.random((1, 1 << langid.SLOT_BITS)) < 0.8).astype(np.uint8)
    text = prose(random.Random(4), "de", 3000)
    grams = np.concatenate(list(langid.ngrams(text)))
    some = np.unique(grams)[::2]  # the real language holds half of the n-grams
    for i in range(langid.HASHES):
        at = (some + np.uint64(i) * ((some >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << langid.SLOT_BITS) - 1)
        slots[0, at.astype(np.int64)] |= 2
    full = langid.Model(["full", "real"], slots, np.array([0.8**langid.HASHES, 0.0]))
    raw = langid.Model(["full", "real"], slots, np.zeros(2))
    lang, score = full.predict(text)
    assert lang == "real" and score > raw.predict(text)[1] + 0.1


def test_language_more_than_64(documents):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": ["".join(rng.choices(letters, k=3)) for _ in range(6)] for k in range(70)}
    rows = [(k * 20 + j, " ".join("".join(rng.choices(own[lang], k=3)) for _ in range(60)), lang) for k, lang in enumerate(own) for j in range(12)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(rows)).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.99


def test_language_nothing_to_learn(documents):
    rows = langid.identify(documents([(1, "abc", None), (2, None, "en")])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in rows) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert langid.identify(documents([])).count() == 0


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def quality_rows():
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        lang, source = rng.choice(["en", "de"]), "hot" if rng.random() < 0.5 else f"s{rng.randrange(3)}"
        rows.append((i, prose(rng, lang, rng.randint(60, 200)), lang, source))
    for i in range(1200, 1240):
        junk = prose(rng, "en", 120)
        rows.append((i, junk.upper().replace(" ", "!! ") if i % 2 else junk.replace(" ", "### "), "en", "hot"))
    rows += [(2000, None, None, None), (2001, "", "en", "hot"), (2002, "a b c \x1cd " * 30, None, "s1"), (2003, "der " * 100, "de", None), rows[3], rows[3]]
    return rows + [(None, prose(rng, "en", 80), "en", "hot"), (2004, prose(rng, "de", 30_000), "de", "lonely")]


def test_quality_base_and_outliers(documents):
    rows = quality_rows()
    got = quality.verdicts(documents(rows)).collect()
    want = Counter((i, *brute_base(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    junk = [r.kept for r in got if r.doc_id is not None and 1200 <= r.doc_id < 1240]
    fine = [r.kept for r in got if r.doc_id is not None and (r.doc_id < 1200 or r.doc_id == 2004)]
    assert not any(junk) and np.mean(fine) > 0.995
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_repeated_lines_alone(documents):
    """A text whose lines are nearly all copies, of few words beside a long line, is an outlier by its lines alone."""
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", rng.randint(80, 200)), "en", "s") for i in range(400)]
    odd = prose(rng, "en", 6_000).replace("\n", " ") + "".join(f"\n{prose(rng, 'en', 1)}" for _ in range(2)) + f"\n{prose(rng, 'en', 1)}" * 300
    got = {r.doc_id: r for r in quality.verdicts(documents([*rows, (900, odd, "en", "s")])).collect()}
    assert got[900].n_dup_lines >= 299 and not got[900].base_failed and not got[900].kept
    assert np.mean([got[i].kept for i in range(400)]) > 0.995


@pytest.mark.parametrize("name", quality.VECTOR)
def test_quality_each_statistic_can_pass_the_cut(name):
    assert 1 / quality.VECTOR[name] ** 2 > quality.chi2_quantile(1 - quality.ALPHA, quality.P)


def test_quality_estimate_against_plain_steps(spark):
    """One group: the same concentration steps in numpy, on whole bins as documented."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality.P)) @ np.diag([0.3, 0.2, 0.2, 0.4, 0.1, 0.2]) + 1
    x[:300] += 6
    df = spark.createDataFrame([("a", "b", v) for v in x.tolist()], "lang string, source string, x array<double>").repartition(4)
    row = quality.estimate(df).where("level = 3").first()
    floor = np.diag(np.square(list(quality.VECTOR.values())))
    ranks = np.sort(np.floor(x * 256), axis=0)
    at = [ranks[math.ceil(q * 3000) - 1] for q in (0.25, 0.5, 0.75)]
    mean, cov = (at[1] + 0.5) / 256, np.diag(np.square((at[2] - at[0]) / 256 / 1.349)) + floor
    for _ in range(quality.STEPS):
        d = x - mean
        bins = np.floor(np.log2(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + 1e-6) * 16)
        core = x[bins <= np.sort(bins)[math.ceil(quality.CORE * 3000) - 1]]
        mean, cov = core.mean(axis=0), np.cov(core.T, bias=True) + floor
    np.testing.assert_allclose(row["mean"], mean, rtol=1e-6)
    np.testing.assert_allclose(np.array(row["inverse"]).reshape(quality.P, -1), np.linalg.inv(cov), rtol=1e-4, atol=1e-6)
    assert np.abs(mean - 1).max() < 0.1  # the far tenth does not pull


def test_quality_small_and_empty(documents):
    assert quality.verdicts(documents([])).count() == 0
    assert quality.filter_quality(documents([])).count() == 0
    few = documents([(1, "short", "en", "s"), (2, None, "en", "s")])
    assert [r.kept for r in quality.verdicts(few).collect()] == [False, False]
    one = documents([(1, prose(random.Random(1), "en", 90), "en", "s")]).withColumn("distance", F.lit("x")).withColumn("mean", F.lit(1))
    kept = quality.filter_quality(one)
    assert kept.columns == one.columns and kept.count() == 1


def test_chi_square_quantile():
    assert abs(quality.chi2_quantile(0.5, 6) - 5.348) < 0.02
    assert abs(quality.chi2_quantile(0.999, 6) / 22.458 - 1) < 0.015  # an approximation


BAD = ["grobian", "lowesch", "loweheit", "veqution"]


def toxic_rows(n=900, seed=7):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text, toxic, junk = prose(rng, rng.choice(["en", "de", "fr"]), 60).split(" "), 0, 0
        if i % 6 == 0:
            toxic = 1
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        elif i % 11 == 0:
            junk, text = 1, ["SPAM!!" if rng.random() < 0.3 else w for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, 1 - junk, toxic))
    return docs, labels


def test_toxicity_held_out(spark, documents):
    docs, labels = toxic_rows()
    odd = [(5000, None), (5001, ""), (5002, "12 34"), docs[0], (None, "grobian lowesch grobian veqution " + docs[1][1])]
    bad = [(None, 1, 1), (9999, 1, 0), (4, None, None), (12, 1, None), (12, 1, 1), (5000, 1, 1)]
    table = spark.createDataFrame([x for x in labels if x[0] // 6 % 3] + bad, "doc_id long, quality int, toxic int")
    frame = documents(docs + odd).withColumn("toxic", F.lit("clash"))
    chain = toxicity.learn(frame, table)
    got = toxicity.predict(frame, chain).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    unseen = [(r.toxic, truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id // 6 % 3 == 0]
    assert np.mean([p for p, t in unseen if t]) > 0.95 and np.mean([p for p, t in unseen if not t]) < 0.01
    by = {r.doc_id: r for r in got}
    assert not any(by[i].toxic for i in (5000, 5001, 5002)) and by[5000].p_toxic == 0.0 and by[None].toxic
    kept = toxicity.filter_toxic(frame, chain)
    assert kept.schema == frame.schema
    want = Counter(r.doc_id for r in got if not r.toxic)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_chain_feeds_earlier_probabilities():
    """A category that is the first one's negation is learned through the chain alone."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(600)]
    first = np.clip(rng.random(600), 0.01, 0.99)
    y = (first < 0.5).astype(float)
    model = toxicity.fit(rows, y, first[:, None])
    p = np.array([model.score(r, [f]) for r, f in zip(rows, first)])
    assert model.earlier[0] < 0 and np.mean((p > 0.5) == (y > 0)) > 0.9


def test_out_of_fold_scores(spark, documents):
    """A row's score in training comes from models that never saw its fold."""
    docs, labels = toxic_rows(200)
    rows = toxicity.training_rows(documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    tasks = rows.withColumn("out_of", F.explode(F.sequence(F.lit(0), F.lit(toxicity.FOLDS))))
    found = tasks.groupBy("out_of").applyInPandas(toxicity._fit_category("toxic", []), "rid long, p double, model binary").collect()
    part = rows.toPandas().sort_values(["rid", "at"], kind="stable")
    at = [np.frombuffer(x, np.int32) for x in part["at"]]
    for fold in range(toxicity.FOLDS):
        seen = (part["fold"] != fold).to_numpy()
        model = toxicity.fit([a for a, s in zip(at, seen) if s], part["toxic"].to_numpy()[seen], np.zeros((int(seen.sum()), 0)))
        want = {int(r): model.score(a, []) for r, a, s in zip(part["rid"], at, seen) if not s}
        for r in found:
            if r.rid in want:
                assert abs(r.p - want[r.rid]) < 1e-9
    assert Counter(r.rid for r in found if r.rid is not None) == Counter(int(r) for r in part["rid"])


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]])
def test_toxicity_one_class_or_none(spark, documents, labels):
    docs, _ = toxic_rows(12)
    chain = toxicity.learn(documents(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.predict(documents(docs), chain)
    assert got.count() == 12
    assert toxicity.predict(documents([]), chain).count() == 0
    if not any(t for *_, t in labels):
        assert got.where("toxic").count() == 0


def test_a_fit_takes_few_bytes_for_each_feature():
    """Rows and columns lie in blocks of small integers; nothing as long as all features is made of 8-byte numbers."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 900, 400)).astype(np.int32) for _ in range(5000)]
    y = np.array([float(r[0] == 0) for r in rows])
    tracemalloc.start()
    model = toxicity.fit(rows, y, np.zeros((len(rows), 0)), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(model.columns) == 900
    # the weights, counts and ranks of all 2^18 columns take up to 24 MB
    assert peak < (24 << 20) + 8 * sum(map(len, rows))
