"""Byte-level BPE: encode with a priority queue of merge ranks over a doubly linked list, decode
by concatenating vocabulary strings.

A text is cut at the added tokens' strings, then by the pre-tokenizer's pattern. Each piece is a
doubly linked list of symbols. The queue holds ``(rank, left position, left id, right id)``; an entry whose two
symbols changed since it was pushed is stale and skipped. Equal ranks merge from the left.

A worker keeps the ids of pieces it has seen in two generations of at most ``CACHE_PIECES``
pieces each, so memory is bounded whatever the vocabulary of the corpus. Pieces over
``CACHE_BYTES`` bytes are never kept.

The installed ``regex`` module and the tokenizers library know different versions of the letter and number classes. The driver
asks the library's pre-tokenizer for the class of every code point once (``class_differences``); texts that hold a
code point on which the two differ are cut by a pattern with the library's classes.

Defined results: null or empty text has no ids and decodes to the empty text. Rows are
independent, so repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_PIECES = 300_000
CACHE_BYTES = 64
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"\\U{start:08X}-\\U{p:08X}")
            start = None
    return "".join(out)


@functools.cache
def class_differences(path: str) -> tuple[tuple[str, str], ...]:
    """For letters, numbers and whitespace: code points that only the tokenizer file's pre-tokenizer, and that only the
    ``regex`` module counts among them, as insides of character classes."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    whole = "".join(map(chr, points))
    names = (r"\p{L}", r"\p{N}", r"\s")
    ours = [set(map(ord, regex.findall(name, whole))) for name in names]
    kind = {c: k for k, found in enumerate(ours) for c in found}  # all others are 3
    theirs = [set(x) for x in ours]

    def is_all(k: int, part: list[int]) -> bool:
        """Do these go on with a letter, a number, or a mark as one pre-token? Blanks go on with none."""
        first, *more = cut("a1 !"[k] + "".join(map(chr, part)))
        return not more if k != 2 else not any(is_all(x, part) for x in (0, 1, 3))

    def compare(k: int, part: list[int]) -> None:
        if len(part) == 1 or k != 2:
            if is_all(k, part):
                return
            if len(part) == 1:
                if k < 3:
                    theirs[k].discard(part[0])
                now = next((x for x in (0, 1, 3) if is_all(x, part)), 2)
                if now < 3:
                    theirs[now].add(part[0])
                return
        half = len(part) // 2
        compare(k, part[:half])
        compare(k, part[half:])

    for k, run in itertools.groupby(points, key=lambda c: kind.get(c, 3)):
        compare(k, list(run))
    return tuple((_ranges(sorted(t - o)), _ranges(sorted(o - t))) for t, o in zip(theirs, ours, strict=True))


def _exact_pattern(differences: tuple[tuple[str, str], ...]) -> str:
    """``PATTERN`` with the library's classes."""
    letter, number, space = (
        f"[{name}{more}]" if not less else f"[[{name}{more}]--[{less}]]" for name, (more, less) in zip((r"\p{L}", r"\p{N}", r"\s"), differences, strict=True)
    )
    rest = f"(?!{letter}|{number}|{space})."
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?(?:{rest})+|{space}+(?!(?!{space}).)|{space}+"


class Bpe:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str, differences: tuple[tuple[str, str], ...] | None = None):
        differences = class_differences(path) if differences is None else differences
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[alphabet[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode("utf-8") for s, i in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        self.exact = regex.compile(_exact_pattern(differences), regex.V1 | regex.S)
        self.differ = "".join(x for pair in differences for x in pair)
        self.unlike = regex.compile(f"[{self.differ}]") if self.differ else None
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.pieces = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges.get
        heap = []
        for i in range(n - 1):
            m = merges((ids[i], ids[i + 1]))
            if m is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, a, b, new = pop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # stale: one of the two symbols has merged since
            ids[i], ids[j] = new, -1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                m = merges((new, ids[k]))
                if m is not None:
                    push(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges((ids[h], new))
                if m is not None:
                    push(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pattern = self.pattern
        if not text.isascii() and self.unlike and self.unlike.search(text):
            pattern = self.exact
        if self.cut is None:
            return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += map(self.pieces.__getitem__, pattern.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        """Vocabulary strings in a row; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.strings.__getitem__, memoryview(packed).cast("I")))
        return out.decode("utf-8", "replace").encode("utf-8")


class _Pieces(dict):
    """Pre-token -> packed ids, in two generations."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode("utf-8")
            out = b"".join([i.to_bytes(4, "little") for i in self.bpe.merge(raw)])
            if len(raw) > CACHE_BYTES:
                return out
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


_LOADED: dict[str, Bpe] = {}


def load(path: str, differences: tuple[tuple[str, str], ...] | None = None) -> Bpe:
    """The vocabulary, once a worker; tasks are given the ``class_differences`` of the driver."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path, differences)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text."""
    differences = class_differences(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, differences)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [bpe.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, col: str = "ids", out: str = "text") -> DataFrame:
    """The rows of ``(doc_id, ids)`` with the text that the ids stand for."""
    import struct

    differences = class_differences(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, differences)
        for b in batches:
            texts = [
                bpe.decode_packed(struct.pack(f"<{len(x)}I", *x)).decode("utf-8") if x else ""
                for x in b.column(col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", out])

    return rows.select("doc_id", col).mapInArrow(run, f"doc_id long, {out} string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass, so that
    no ids travel through a shuffle."""
    differences = class_differences(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, differences)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column("text"):
                packed = bpe.packed(text.as_py() or "")
                n.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_packed(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
