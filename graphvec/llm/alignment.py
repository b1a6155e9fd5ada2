"""Alignment of two tokenizers over a corpus, each distinct text done once.

Texts are shuffled by their full content, so that copies meet and are tokenised and aligned once; a text
with a third of all rows is summed in its map tasks first. Tokenizer A is byte-level BPE and reads a space
and the text, tokenizer B is a sentencepiece model that adds that space itself. Both then spell the same
bytes, and byte offsets where tokens of both end cut the text into groups. The last tokens of a group are a
link. A pair of ids counts its links, weighted by the copies of each text.

1. ``aligned``: one row a distinct text, with its measures and its links as packed pair codes (written).
2. ``pair_counts``: partial sums of the codes by task, then by pair.
3. ``measures``: the links of each text against the counts.
4. ``align``: measures go back to the documents by the SHA-256 of their text.

Two linked tokens spell bytes that end together, so the shorter is a suffix of the longer. The vocabularies
therefore bound the pairs that can occur (``most_pairs``; some 10^6 for the files used here), whatever the
corpus. Within ``BROADCAST_PAIRS`` the counts are sent to the tasks as two arrays of 16 bytes a pair; with larger
vocabularies the links take a shuffle join. Texts with more than a thousandth of all rows, a thousand
at most, join their documents by broadcast, so that no key of the shuffle join is hot.

Defined results: null, empty and differently spelt texts (where the joined bytes of A or B are not a space
and the text) have no tokens: all zero, and '' for groups_sha256. Special tokens' strings are plain text. Very long
texts are encoded and aligned whole, in memory of some 100 bytes a token. Repeated rows have equal measures and count each
time. A null doc_id stays null. An empty table gives no rows. Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.llm import packing
from graphvec.llm.bpe import PATTERN, byte_alphabet
from graphvec.llm.text import pieces
from graphvec.session import write_table

#: Pairs whose counts may be sent to every task (64 MB).
BROADCAST_PAIRS = 4_000_000
#: Links that a task sums up at a time.
FLUSH_LINKS = 2_000_000
#: A text with more than one in so many rows is joined back by broadcast.
HOT_SHARE = 1000

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Pair:
    """Both tokenizers and what their tokens spell."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        added = set(vocab.values()) - set(range(len(vocab)))
        if added:
            raise ValueError("ids of the byte-level vocabulary are not gapless")
        spelt = {i: bytes(back[c] for c in s) for s, i in vocab.items() if all(c in back for c in s)}
        ranks = {s: i for i, s in spelt.items()}
        self.a = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [spelt.get(i, b"") for i in range(len(vocab))]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_b = len(self.bytes_b)
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # ids as text, followed by what parts them: next of the group, next side, next group
        self.text_a, self.last_a = self._texts(len(self.bytes_a), "|")
        self.text_b, self.last_b = self._texts(self.size_b, ";")

    def _piece(self, i: int) -> bytes:
        s = self.b.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode("utf-8")

    @staticmethod
    def _texts(n: int, end: str) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([f"{i}{x}".encode() for i in range(n)], object) for x in (",", end))

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) < packing.LONG_RUN:
            return self.a.encode_to_numpy(text, disallowed_special=())
        return np.array(packing.encode(self.a, text), np.uint32)

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """n_a, n_b, n_groups, groups_sha256 and the codes ``a * size_b + b`` of the links."""
        a = self.encode_a(" " + text)
        listed = self.b.encode(text)
        b = np.array(listed, np.int32)
        want = b" " + text.encode("utf-8")
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        # tokens of A are cut from the text's own bytes, so their total length tells; pieces of B are compared
        if end_a[-1] != len(want) or b"".join(map(self.bytes_b.__getitem__, listed)) != want:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        ends = np.zeros((2, len(want) + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        is_last_a, is_last_b = ends[1, end_a], ends[0, end_b]
        last_a, last_b = np.flatnonzero(is_last_a), np.flatnonzero(is_last_b)
        spelt_a, spelt_b = self.text_a[a], self.text_b[b]
        spelt_a[last_a], spelt_b[last_b] = self.last_a[a[last_a]], self.last_b[b[last_b]]
        # a token stands behind all of its own side before it and the other side's groups up to it
        group_a, group_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = spelt_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = spelt_b
        digest = hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()
        return len(a), len(b), len(last_a), digest, a[last_a].astype(np.int64) * self.size_b + b[last_b]


_LOADED: dict[tuple[str, str], Pair] = {}


def load(path_a: str, path_b: str) -> Pair:
    """The tokenizers, once a worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def most_pairs(one: list[bytes], two: list[bytes]) -> int:
    """How many pairs of tokens there are of which one spells a suffix of the other."""
    count: list[dict[bytes, int]] = []
    for tokens in (one, two):
        n: dict[bytes, int] = defaultdict(int)
        for s in tokens:
            n[s] += 1
        n.pop(b"", None)
        count.append(n)
    total = 0
    for mine, other, least in ((count[0], count[1], 0), (count[1], count[0], 1)):  # equal ones once
        for s, n in mine.items():
            total += n * sum(other.get(s[k:], 0) for k in range(least, len(s)))
    return total


def _key(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a distinct text that is not null or empty: key, copies, n_a, n_b, n_groups, groups_sha256 and ``links``,
    little-endian 64-bit (32-bit where they suffice) codes."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    texts = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", _key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        code = code_type(pair)
        for b in pieces(batches):
            cols: list[list] = [[], [], [], [], []]
            for text in b.column("text"):
                *found, links = pair.align(text.as_py())
                for c, v in zip(cols, (*found, links.astype(code).tobytes()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), *arrays], ["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return texts.mapInArrow(run, "key string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def code_type(pair: Pair) -> str:
    return "<u4" if len(pair.bytes_a) * pair.size_b < 1 << 32 else "<i8"


def pair_counts(texts: DataFrame, code: str) -> DataFrame:
    """``(code, n)``: the links of each pair in all documents."""

    def total(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        codes = np.concatenate([x for x, _ in held]).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], np.repeat([n for _, n in held], [len(x) for x, _ in held])[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(np.add.reduceat(n, first))], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches):
            for copies, links in zip(b.column("copies").to_pylist(), b.column("links"), strict=True):
                held.append((np.frombuffer(links.as_py(), code), copies))
                size += len(held[-1][0])
                if size >= FLUSH_LINKS:
                    yield total(held)
                    held, size = [], 0
        if size:
            yield total(held)

    return texts.select("copies", "links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _best(pairs: DataFrame, size_b: int) -> DataFrame:
    """``(code, n, best)``: is the count the highest of its id of B?"""
    of = F.col("code") % F.lit(size_b)
    top = pairs.groupBy(of.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", of).join(top, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def measures(texts: DataFrame, pairs: DataFrame, code: str, *, broadcast: bool = True) -> DataFrame:
    """``texts`` with n_best and count_sum instead of links, from ``pairs (code, n, best)``."""
    if not broadcast:
        return _measures_by_join(texts, pairs, code)
    spark = texts.sparkSession
    rows = pairs.orderBy("code").toArrow()  # as many rows as ``most_pairs`` at most
    table = spark.sparkContext.broadcast((rows["code"].to_numpy(), np.where(rows["best"].to_numpy(), rows["n"].to_numpy(), -rows["n"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, signed = table.value  # counts of pairs that are not their id's best are negative
        for b in pieces(batches):
            best, total = [], []
            for links in b.column("links"):
                n = signed[np.searchsorted(codes, np.frombuffer(links.as_py(), code).astype(np.int64))]
                best.append(int((n > 0).sum()))
                total.append(int(np.abs(n).sum()))
            at = b.schema.get_field_index("links")
            kept = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*(x for x in b.schema.names if x != "links"), "n_best", "count_sum"])

    kinds = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != "links")
    out = write_table(texts.mapInArrow(run, f"{kinds}, n_best long, count_sum long"), "measures")
    table.destroy()
    return out


def _measures_by_join(texts: DataFrame, pairs: DataFrame, code: str) -> DataFrame:
    """The same by a shuffle: a text sends each of its distinct pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for key, links in zip(b.column("key").to_pylist(), b.column("links"), strict=True):
                codes, n = np.unique(np.frombuffer(links.as_py(), code).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["key", "code", "times"])

    met = texts.select("key", "links").mapInArrow(run, "key string, code long, times long").join(pairs, "code")
    sums = met.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return texts.drop("links").join(sums, "key", "left").na.fill({"n_best": 0, "count_sum": 0})


def align(docs: DataFrame, path_a: str, path_b: str, *, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, and the corpus's
    pairs ``(a, b, n, best)``."""
    pair = load(path_a, path_b)
    code = code_type(pair)
    texts = write_table(aligned(docs, path_a, path_b), "aligned_texts")
    pairs = write_table(_best(write_table(pair_counts(texts, code), "pair_counts"), pair.size_b), "pairs")
    small = most_pairs(pair.bytes_a, pair.bytes_b) <= broadcast_pairs
    found = measures(texts, pairs, code, broadcast=small).withColumn("n_links", F.col("n_groups"))
    found = found.select("key", "copies", *MEASURES, "groups_sha256")
    rows = found.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = F.col("copies") * HOT_SHARE > F.lit(rows)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"))
    few = F.broadcast(found.where(hot).select("key", F.struct(*MEASURES, "groups_sha256").alias("hot")))  # under HOT_SHARE rows
    keyed = keyed.join(few, "key", "left")
    rest = found.where(~hot).select("key", F.struct(*MEASURES, "groups_sha256").alias("rest"))
    # a text that is hot or has no key joins nothing: it is dealt by its place instead of by its text
    alone = F.coalesce(F.when(F.col("hot").isNull(), F.col("key")), F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    met = keyed.withColumn("key", alone).join(rest, "key", "left").select("doc_id", F.coalesce("hot", "rest").alias("m"))
    out = met.select("doc_id", *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c) for c in MEASURES], F.coalesce("m.groups_sha256", F.lit("")).alias("groups_sha256"))
    b = F.col("code") % F.lit(pair.size_b)
    return out, pairs.select(((F.col("code") - b) / pair.size_b).cast("long").alias("a"), b.alias("b"), "n", "best")
