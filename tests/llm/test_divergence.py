import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphvec.llm import divergence


def plain(rows, least=30, top=50):
    """The contract, word by word. Rows are (doc_id, text, lang, source)."""
    docs = [(d, (t or ""), g or "", s or "") for d, t, g, s in rows]
    found = [(g, s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)))) for _, t, g, s in docs]
    in_docs, group, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for g, s, c in found:
        in_docs[g].update(set(c))
        group[g, s].update(c)
        whole[g].update(c)
    out = set()
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for g, s in group:
        kept = [t for t, n in in_docs[g].items() if n >= least]
        v = len(kept)
        p = {(x, t): share(group[g, x][t], sum(group[g, x][k] for k in kept), v) for (h, x) in group if h == g for t in kept}
        q = {t: share(whole[g][t], sum(whole[g][k] for k in kept), v) for t in kept}
        parts = {
            "pair": [(x, sum(abs(p[s, t] - p[x, t]) for t in kept)) for (h, x) in group if h == g and x != s],
            "term": [(t, p[s, t] - q[t]) for t in kept if group[g, s][t] and p[s, t] > q[t]],
        }
        for part, items in parts.items():
            items.sort(key=lambda i: (-i[1], i[0].encode()))
            out |= {(g, s, part, item, value, r + 1) for r, (item, value) in enumerate(items) if part == "pair" or r < top}
    return out


def corpus(seed=1, n=220):
    rng = random.Random(seed)
    common = ["the", "The", "of", "ÉTÉ", "été", "naïve", "x", "日本", "ab1cd", "a_b", "don't", "\u0085", "Ǆ"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s1", "s2", "s3", "S1", "é", None, "z" * 40, ""])
        words = [rng.choice(common) for _ in range(rng.randint(0, 60))] + [f"w{rng.randint(0, 40)}{source}" for _ in range(9)]
        rows.append((rng.choice([i, None]), rng.choice([" ", "\n", "\x00", "-"]).join(words), lang, source))
    rows += [(1000, None, "fr", "s1"), (1001, "", "fr", None), (1002, "rare words only", "fr", "s9"), (1003, "word " * 70_000, "en", "s1")]
    return rows + rows[:20]  # repeated rows


@pytest.mark.parametrize("blocks", [{}, {"group_block": 2, "term_block": 3}])
def test_matches_the_plain_version(documents, blocks):
    rows = corpus()
    got = divergence.audit(documents([(d, t, g, s) for d, t, g, s in rows]), least_docs=10, top_terms=5, **blocks)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, 10, 5)


def test_ties_languages_without_terms_and_empty_tables(documents, spark):
    rows = [(i, "same words", "en", f"s{i % 3}") for i in range(9)]
    got = divergence.audit(documents(rows), least_docs=30).collect()
    assert [(r.source, r.item, r.value, r["rank"]) for r in sorted(got, key=tuple)][:2] == [("s0", "s1", 0, 1), ("s0", "s2", 0, 2)]
    assert len(got) == 6 and {r.part for r in got} == {"pair"}
    assert divergence.audit(documents(rows).limit(0)).count() == 0


def test_extra_columns_with_clashing_names(documents, spark):
    from pyspark.sql import functions as F

    rows = corpus(3, 60)
    docs = documents(rows).withColumns({c: F.lit(c) for c in ("term", "n", "docs", "tb", "gb", "value", "rank", "a", "b", "item", "part", "v", "x")})
    assert {tuple(r) for r in divergence.audit(docs, least_docs=5).collect()} == plain(rows, 5)


def test_shares_are_exact_at_any_count():
    whole = 9 * 10**15 - 7
    counts = np.array([0, 1, 10**12 + 3, whole - 5])
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]


def test_a_source_is_split_over_cells_and_no_cell_outgrows_its_blocks(documents):
    rows = corpus(5, 200)
    groups, widths, mine = divergence.prepare(documents(rows), least_docs=5, group_block=2, term_block=4)
    assert max(r.width for r in widths.collect()) <= 12  # hashed, four on average
    assert mine.where("source = 's1' and lang = 'en'").select("tb").distinct().count() > 3
    assert groups.select("lang", "gb").distinct().count() > groups.select("lang").distinct().count()
