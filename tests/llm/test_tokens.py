"""BPE and packing against the tokenizers library, and round trips."""

import hashlib
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphvec.llm import bpe, packing

ODD = [
    None, "", " ", "\n\n  x\t\ty ", "don't I'LL we've 12345 €5", "a<|endoftext|>b <|endoftext|>", "é́ñ 你好 ١٢٣\u200b\x00\u2028 z", "ab" * 4000,
    "x" * 5000, "the the the", "the the the", "🙂🙃" * 50, "\r\n\r\n", "A" + " " * 300 + "B",
]


def test_encode_equals_library(tokenizer_path):
    mine, theirs = bpe.load(tokenizer_path), Tokenizer.from_file(tokenizer_path)
    for text in ODD:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert mine.encode(text or "") == ids
        assert mine.decode_packed(mine.packed(text or "")).decode() == theirs.decode(ids, skip_special_tokens=False)
        assert packing.tokenizer(tokenizer_path).encode(text or "", allowed_special="all") == ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encode_equals_library_on_any_text(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = _LIBRARY.setdefault(path, Tokenizer.from_file(path))
    assert bpe.load(path).encode(text) == theirs.encode(text, add_special_tokens=False).ids


_LIBRARY: dict = {}


def test_decode_of_broken_bytes(tokenizer_path):
    mine, theirs = bpe.load(tokenizer_path), Tokenizer.from_file(tokenizer_path)
    ids = mine.encode("你好")[1:]
    packed = struct.pack(f"<{len(ids)}I", *ids)
    assert mine.decode_packed(packed).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_cache_stays_bounded(tokenizer_path, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    mine = bpe.Bpe(tokenizer_path)
    want = [mine.merge(f" w{i}".encode()) for i in range(500)]
    assert [mine.encode(f" w{i}") for i in range(500)] == [mine.encode(f" w{i}") for i in range(500)]
    assert len(mine.pieces) <= 50 and len(mine.pieces.old) <= 50
    assert len(want) == 500


def test_documents_round_trip(documents, tokenizer_path):
    docs = documents(list(enumerate(ODD)) + [(3, ODD[3]), (None, "null id")])
    got = {(r.doc_id, r.ids_sha256): r for r in bpe.round_trip_digests(docs, tokenizer_path).collect()}
    theirs = Tokenizer.from_file(tokenizer_path)
    for doc_id, text in [*enumerate(ODD), (None, "null id")]:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()]
        assert row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode_documents(docs, tokenizer_path)
    back = {(r.doc_id, r.text) for r in bpe.decode_ids(encoded, tokenizer_path).collect()}
    assert back == {(i, t or "") for i, t in [*enumerate(ODD), (None, "null id")]}


def test_no_documents(documents, tokenizer_path):
    assert bpe.round_trip_digests(documents([]), tokenizer_path).count() == 0
    assert packing.pack(documents([]), tokenizer_path).count() == 0


def test_cut_lengths():
    assert packing.cut_lengths(0) == []
    assert packing.cut_lengths(2048 * 2 + 13) == [2048, 2048, 8, 4, 1]
    for n in range(1, 5000, 7):
        cut = packing.cut_lengths(n, 64)
        assert sum(cut) == n and all(x & (x - 1) == 0 and x <= 64 for x in cut)
    with pytest.raises(ValueError):
        packing.cut_lengths(5, 100)


def test_pack_covers_every_id(documents, tokenizer_path):
    texts = [*ODD, "word " * 9000]
    docs = documents(list(enumerate(texts)) + [(3, ODD[3])])
    theirs = Tokenizer.from_file(tokenizer_path)
    plain = packing.pack(docs, tokenizer_path).collect()
    assert len({r.sequence_id for r in plain}) == len(plain)  # a sequence is one piece
    pieces = defaultdict(list)
    for r in plain:
        assert r.length == len(r.ids) <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0
        pieces[r.doc_id].append(r)
    for doc_id, text in enumerate(texts):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 1]
        found = sorted(pieces[doc_id], key=lambda r: r.start)
        want = ids * (2 if doc_id == 3 else 1)
        assert sorted(x for r in found for x in r.ids) == sorted(want)
        for r in found:
            assert list(r.ids) == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
    sums = sorted((r.doc_id, r.start, zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))) for r in plain)
    digest = packing.pack(docs, tokenizer_path, digest=True).collect()
    assert sums == sorted((r.doc_id, r.start, r.ids_crc32) for r in digest)


LONG = 1_001_000


@pytest.mark.parametrize("run", [" " * LONG, "\n" * LONG, " \n\t\u2003\u00a0" * (LONG // 5)], ids=["spaces", "newlines", "mixed"])
def test_pack_of_very_long_whitespace(tokenizer_path, run):
    """tiktoken's own pattern raises on these; the ids are the library's."""
    theirs, encoding = Tokenizer.from_file(tokenizer_path), packing.tokenizer(tokenizer_path)
    for text in [run, "a b" + run, run + "b c", f"don't {run}'s x{run}<|endoftext|>{run}12<|endoftext|> y"]:
        assert packing.encode(encoding, text) == theirs.encode(text, add_special_tokens=False).ids


def test_pack_cuts_whitespace_runs_anywhere(tokenizer_path, monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 2)
    theirs, encoding = Tokenizer.from_file(tokenizer_path), packing.tokenizer(tokenizer_path)
    for text in [*ODD, "a  b   \n c\t\t1 \x1c \x85\u200b  !", "  <|endoftext|>   x<|endoftext|>  "]:
        assert packing.encode(encoding, text or "") == theirs.encode(text or "", add_special_tokens=False).ids


def test_pack_rows_of_very_long_whitespace(documents, tokenizer_path):
    text = "a" + " " * LONG + "b"
    rows = packing.pack(documents([(1, text), (2, "x")]), tokenizer_path).collect()
    ids = [*Tokenizer.from_file(tokenizer_path).encode(text, add_special_tokens=False).ids, 1]
    found = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.start)
    assert [x for r in found for x in r.ids] == ids and sum(r.doc_id == 2 for r in rows) == 1


def test_buckets_on_disk(spark, documents, tokenizer_path, tmp_path):
    pieces = packing.pack(documents([(1, "a b c d e f g"), (2, "a")]), tokenizer_path)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert sorted((r.doc_id, r.start, r.length) for r in back.collect()) == sorted((r.doc_id, r.start, r.length) for r in pieces.collect())


def test_every_code_point_is_cut_as_the_library_does(tokenizer_path):
    """All code points between letters, digits, marks and blanks, in both encoders."""
    import random

    theirs, ours, fast = Tokenizer.from_file(tokenizer_path), bpe.load(tokenizer_path), packing.tokenizer(tokenizer_path)
    rng = random.Random(1)
    near = ["a", "1", "!", " ", "\n", ""]
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 60):
        text = "".join(rng.choice(near) + chr(c) + rng.choice(near) for c in points[at : at + 60])
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want and packing.encode(fast, text) == want, hex(points[at])


def test_packing_encodes_arbitrary_texts(tokenizer_path):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    theirs, fast = Tokenizer.from_file(tokenizer_path), packing.tokenizer(tokenizer_path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
    def same(text):
        assert packing.encode(fast, text) == theirs.encode(text, add_special_tokens=False).ids

    same()
