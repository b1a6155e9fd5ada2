import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphvec.llm import alignment
from graphvec.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The contract, token by token, from the two libraries."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in byte_alphabet().items()}

    def groups(text):
        """(a ids, b ids) of each group; none for texts without tokens."""
        if not text:
            return []
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        spelt_a = [bytes(back[c] for c in one.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(spelt_a) != b" " + text.encode() or b"".join(spelt_b) != b" " + text.encode():
            return []
        out, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(spelt_a[i])
                now[0].append(a[i])
                i += 1
            else:
                at_b += len(spelt_b[j])
                now[1].append(b[j])
                j += 1
            if at_a == at_b:
                out.append(now)
                now = ([], [])
        return out

    def run(rows):
        found = [(d, groups(t)) for d, t in rows]
        count = Counter((x[-1], y[-1]) for _, g in found for x, y in g)
        most = Counter()
        for (_, y), n in count.items():
            most[y] = max(most[y], n)
        out = []
        for d, g in found:
            links = [(x[-1], y[-1]) for x, y in g]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((
                d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else "",
            ))
        return Counter(out), count

    return run


ODD = ["", None, " ", "  a", "a\0b", "▁x", "a ▁", "<|endoftext|> <s>x</s>", "<0x41>", "tab\tnew\r\nline x", "ﬁ é é", "한국 日本 👩‍👩‍👧", "﻿x", "x" * 3000, "\u0085 ", "Straße 123456 don't"]


def texts(seed=2, n=60):
    rng = random.Random(seed)
    words = "the and of naïve tokenization Wörter überall 12 3.14 email@x.org été \n\n # ## == don't".split(" ")
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "ing", "s", "…"]) for _ in range(rng.randint(1, 80)))) for i in range(n)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    return rows + rows[:15] + [(None, rows[3][1]), (None, None)] + [(500 + i, rows[5][1]) for i in range(300)]  # repeated, null, hot


@pytest.mark.parametrize("settings", [{}, {"broadcast_pairs": 0}])
def test_matches_the_libraries(documents, plain, settings):
    rows = texts()
    got, pairs = alignment.align(documents(rows), A, B, **settings)
    want, count = plain(rows)
    columns = ("doc_id", *alignment.MEASURES[:3], "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == count


def test_arbitrary_texts(plain):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    pair = alignment.load(A, B)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=60))
    def same(text):
        n_a, n_b, n_groups, digest, _ = pair.align(text)
        (row,) = plain([(1, text)])[0]
        assert (1, n_a, n_b, n_groups, digest) == (row[0], row[1], row[2], row[3], row[7])

    same()


def test_very_long_text_and_long_runs(documents, plain):
    rows = [(1, "word " * 60_000), (2, " " * 600_000 + "x"), (3, "ab" * 100_000)]
    got = alignment.align(documents(rows), A, B)[0].collect()
    want, _ = plain(rows)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_each_distinct_text_is_aligned_once(documents):
    rows = texts()
    found = alignment.aligned(documents(rows), A, B)
    assert found.count() == len({t for _, t in rows if t})
    assert found.agg(F.sum("copies")).first()[0] == sum(1 for _, t in rows if t)


def test_vocabularies_bound_the_pairs(documents):
    assert alignment.most_pairs([b"ab", b"b", b"", b"c"], [b"b", b"ab", b"xab", b"b"]) == 8
    pair = alignment.load(A, B)
    assert alignment.most_pairs(pair.bytes_a, pair.bytes_b) < alignment.BROADCAST_PAIRS


def test_clashing_names_and_empty_tables(documents, plain):
    rows = texts(4, 10)
    names = ("key", "copies", "links", "code", "n", "best", "hot", "rest", "m", "n_a", "groups_sha256")
    docs = documents(rows).withColumns({c: F.lit(c) for c in names})
    assert sum(plain(rows)[0].values()) == alignment.align(docs, A, B)[0].count()
    got, pairs = alignment.align(documents(rows).limit(0), A, B)
    assert got.count() == 0 and pairs.count() == 0
    nothing, _ = alignment.align(documents([(1, None), (2, "")]), A, B)
    assert sorted(r.n_a + r.count_sum for r in nothing.collect()) == [0, 0]
