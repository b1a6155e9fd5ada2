"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning: in a bounded sample of the labelled rows (about ``sample_rows`` for each language, drawn by a
hash of doc_id) the letter n-grams are counted. A language's filter holds the n-grams with at least
``min_share`` of its n-grams, so at most ``1 / min_share`` for each n. All filters are one array of slots,
and a slot is a bitmask of languages: an n-gram's slots, and-ed, name all languages that hold it.

Deciding: for each language the n-grams of a text that hit are counted, less what chance hits would add
(share of the language's filled slots to the power of the number of hashes). The largest corrected count wins; ties
go to the language with more labelled rows, then to the smaller name. The score is its share of all corrected
counts.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything when there is nothing to learn
from. Rows with null doc_id are predicted, not learned from, and not held out. Repeated rows repeat
their result. Texts of any length are read whole, in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS, MIN_SHARE, SIZES = 3_000, 1e-5, (3, 4)
SLOT_BITS, HASHES = 21, 3
SEGMENT = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of the words of a text: runs of letters, lower-cased, with
    one blank on each side. Hashed a segment at a time."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    keep = letter | np.r_[True, letter[:-1]]  # of a run of others the first one
    code = np.where(letter, code, 32)[keep]
    for n in sizes:
        for start in range(0, len(code) - n + 1, SEGMENT):
            part = code[start : start + SEGMENT + n - 1].astype(np.uint64)
            m = len(part) - n + 1
            h = np.full(m, np.uint64(n), np.uint64)
            across = np.zeros(m, bool)
            for i in range(n):
                h = (h + part[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                if 0 < i < n - 1:
                    across |= part[i : i + m] == 32
            yield h[~across]


class Model(NamedTuple):
    """``langs`` in the order of their bits; ``slots[w]`` holds languages 64 w to 64 w + 63."""

    langs: list[str]
    slots: np.ndarray
    chance: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that hold it, one column for 64 languages."""
        out = None
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            at = ((h + np.uint64(i) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            got = self.slots[:, at]
            out = got if out is None else out & got
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        total, hits, some = 0, np.zeros(len(self.langs)), False
        for h in ngrams(text):
            if not len(h):
                continue
            some = True
            masks = self.masks(h)
            total += len(h)
            for i in range(len(self.langs)):
                hits[i] += int(((masks[i >> 6] >> np.array(i & 63, masks.dtype)) & np.array(1, masks.dtype)).sum())
        if not some:
            return "und", 0.0
        real = np.maximum((hits - total * self.chance) / (1 - self.chance), 0.0)
        best = int(np.argmax(real))
        whole = float(real.sum())
        return self.langs[best], float(real[best]) / whole if whole else 0.0


def learn(rows: DataFrame, *, sample_rows: int = SAMPLE_ROWS, min_share: float = MIN_SHARE) -> Model:
    """A model from ``rows(doc_id, text, lang)``. The driver gets a row for each language and at
    most ``len(SIZES) / min_share`` hashes for each."""
    rows = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return Model([], np.zeros((1, 1 << SLOT_BITS), np.uint8), np.zeros(0))
    share = F.lit(1.0)
    for lang, n in counts.items():
        if n > sample_rows:
            share = F.when(F.col("lang") == lang, F.lit(sample_rows / n)).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple[str, int], list[np.ndarray]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for n in SIZES:
                    for h in ngrams(text, (n,)):
                        held.setdefault((lang, n), []).append(h)
            for (lang, n), hs in held.items():
                got, k = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(got), pa.string()), pa.array([n] * len(got), pa.int64()), pa.array(got.view(np.int64)), pa.array(k, pa.int64())],
                    ["lang", "n", "gram", "k"],
                )

    grams = drawn.mapInArrow(count, "lang string, n long, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    totals = grams.groupBy("lang", "n").agg(F.sum("k").alias("total"))
    kept = grams.join(totals, ["lang", "n"]).where(F.col("k") >= F.greatest(F.lit(2.0), F.col("total") * min_share)).select("lang", "gram")
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.dtype(t).itemsize * 8), np.uint64)
    slots = np.zeros((-(-len(langs) // 64), 1 << SLOT_BITS), kind)
    bit = {x: i for i, x in enumerate(langs)}
    found = kept.toPandas()
    for lang, part in found.groupby("lang"):
        h = part["gram"].to_numpy(np.int64).view(np.uint64)
        i = bit[lang]
        step = (h >> np.uint64(32)) | np.uint64(1)
        for j in range(HASHES):
            at = ((h + np.uint64(j) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
            slots[i >> 6, at] |= np.array(1 << (i & 63), kind)
    filled = [float(((slots[i >> 6] >> np.array(i & 63, kind)) & np.array(1, kind)).mean()) for i in range(len(langs))]
    return Model(langs, slots, np.array(filled) ** HASHES)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; the text is the only input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return predict(docs, learn(known, **settings))
