"""Repeated passages by seed and extend.

Seeds: k-word hashes, winnowed: of every ``window - k + 1`` consecutive ones the smallest (the last
of equals) is an anchor. Equal passages of ``window`` words choose the same anchor, so passages that
repeat share one. Anchors that occur once in the corpus drop out (``repeats.find_repeats``).

Window hashes replace the extension: each window of ``window`` words belongs to the anchor it chose, and
no words are compared to the left or right of a seed. Windows are compared by 64 bits of their own hash and
32 bits of the anchor's. Windows meet in blocks of anchors: all windows of an anchor go to the block of its hash, where
the earliest occurrence of each window is known and the others are repeats. Adjacent repeats are
merged into maximal spans.

A hot passage does not gather in a task: a chunk of a map task keeps its earliest occurrence of a
window only and reports the others as repeats at once. Spans return to their documents by one join.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``. Null or empty text has none. Null doc_ids order after
all others. Rows repeated with the same doc_id and text are judged alike: neither is earlier than
the other. Rows with one doc_id and different texts are told apart by a text checksum. Empty tables give no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.llm.repeats import block_bits, find_repeats
from graphvec.llm.text import blobs, mix, ngram_hashes, pieces, word_hashes, words

WINDOW, ANCHOR = 20, 10
CHUNK_WINDOWS = 1_000_000
#: What a null doc_id counts as.
NULL_ID = np.iinfo(np.int64).max

_ENTRY = np.dtype([("hash", "<u8"), ("anchor", "<u4"), ("doc", "<i8"), ("crc", "<u4"), ("start", "<i4")])
_RUN = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<i4"), ("n", "<i4")])


def anchors(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs, and for each window the position of the one it chooses."""
    grams = ngram_hashes(hashes, k, seed=1)
    span = window - k + 1
    if len(grams) < span:
        return grams, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], span)
    last = len(grams) - 1 - (np.arange(len(view)) + view.argmin(axis=1))
    return grams, last[::-1]


def _docs(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, checksum, word hashes)."""
    ids = b.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    for i, x in enumerate(blobs(b.column("text"))):
        yield int(ids[i]), zlib.crc32(x), word_hashes(words(x))


def _runs(flagged: np.ndarray) -> np.ndarray:
    """Adjacent starts of one document as (doc, crc, first start, number of starts)."""
    f = np.sort(np.unique(flagged), order=["doc", "crc", "start"])
    if not len(f):
        return np.empty(0, _RUN)
    new = np.r_[True, (f["doc"][1:] != f["doc"][:-1]) | (f["crc"][1:] != f["crc"][:-1]) | (f["start"][1:] != f["start"][:-1] + 1)]
    at = np.flatnonzero(new)
    out = np.empty(len(at), _RUN)
    for c in ("doc", "crc", "start"):
        out[c] = f[c][at]
    out["n"] = np.diff(np.r_[at, len(f)])
    return out


def _later(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with one hash: the earliest entries, and those that start strictly later."""
    order = np.lexsort((entries["start"], entries["doc"], entries["anchor"], entries["hash"]))
    e = entries[order]
    new = np.r_[True, (e["hash"][1:] != e["hash"][:-1]) | (e["anchor"][1:] != e["anchor"][:-1])] if len(e) else np.empty(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(e) else np.empty(0, np.int64)
    later = (e["doc"] != e["doc"][first]) | (e["start"] != e["start"][first])
    return e[new | ~later], e[later]


def _spots(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<i4")]))
    for c in ("doc", "crc", "start"):
        out[c] = e[c]
    return out


def _rows(found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "entries", "runs"])


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, crc, start, n)``: ``n`` consecutive windows from ``start`` on begin earlier
    elsewhere too (``doc_id`` is ``NULL_ID`` for null)."""
    if not 0 < k <= window:
        raise ValueError("an anchor is at most as long as the window")
    rows = docs.select("doc_id", "text")
    bits = block_bits(rows)

    def seeds(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, h in _docs(b):
            grams, chosen = anchors(h, window, k)
            if len(chosen):
                yield mix(grams[np.unique(chosen)])  # the smallest of many lie low: spread them over the blocks

    seen = rows.sparkSession.sparkContext.broadcast(find_repeats(rows, ["doc_id", "text"], seeds))

    def chunk(held: list[np.ndarray]) -> pa.RecordBatch:
        first, later = _later(np.concatenate(held))
        out = []
        block = (first["anchor"] >> np.uint32(32 - bits)).astype(np.int64)
        order = np.lexsort((first["start"], first["doc"], block))
        first, block = first[order], block[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out.append((int(block[a]), first[a:b].tobytes(), b""))
        runs = _runs(_spots(later))
        side = runs["crc"] % (1 << bits)
        for key in np.unique(side):
            out.append((int(key), b"", runs[side == key].tobytes()))
        return _rows(out)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches):
            for doc, crc, h in _docs(b):
                grams, chosen = anchors(h, window, k)
                if not len(chosen):
                    continue
                spread = mix(grams)
                at = np.flatnonzero(seen.value.repeated(spread)[chosen])
                if not len(at):
                    continue
                e = np.empty(len(at), _ENTRY)
                e["hash"] = ngram_hashes(h, window, seed=2)[at]
                e["anchor"] = spread[chosen[at]] >> np.uint64(32)
                e["doc"], e["crc"], e["start"] = doc, crc, at
                held.append(e)
                n += len(e)
                if n >= CHUNK_WINDOWS:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in part["entries"]])
        runs = [np.frombuffer(x, _RUN) for x in part["runs"]]
        runs = np.concatenate([*runs, _runs(_spots(_later(entries)[1]))])
        return pd.DataFrame({"doc_id": runs["doc"], "crc": runs["crc"].astype(np.int64), "start": runs["start"].astype(np.int64), "n": runs["n"].astype(np.int64)})

    met = rows.mapInArrow(extend, "block long, entries binary, runs binary")
    return met.groupBy("block").applyInPandas(meet, "doc_id long, crc long, start long, n long")


def with_spans(docs: DataFrame, *, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``docs`` with ``_sd_spans``, the repeated windows of each row as an array of (start, n)."""
    spans = (
        repeated_spans(docs, window=window, k=k)
        .groupBy("doc_id", "crc")
        .agg(F.collect_list(F.struct("start", "n")).alias("_sd_spans"))
        .select(F.col("doc_id").alias("_sd_id"), F.col("crc").alias("_sd_crc"), "_sd_spans")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"_sd_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))), "_sd_sum": F.crc32(text.cast("binary"))})
    on = (F.col("_sd_key") == F.col("_sd_id")) & (F.col("_sd_sum") == F.col("_sd_crc"))
    return keyed.join(spans, on, "left").drop("_sd_key", "_sd_sum", "_sd_id", "_sd_crc")


def _keep(tokens: list[bytes], spans: list[dict] | None, window: int) -> list[bytes]:
    if not spans:
        return tokens
    edge = np.zeros(len(tokens) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + window - 1] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return [w for w, c in zip(tokens, covered, strict=True) if not c]


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``docs`` (a text column, any others) with the repeated words removed. Texts that lose
    nothing stay as they are; of the others the kept words are joined by one space. A column
    ``n_chars`` follows the new text."""
    schema = docs.schema
    out = with_spans(docs, window=window, k=k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, sizes = [], []
            for x, spans in zip(b.column("text").to_pylist(), b.column("_sd_spans").to_pylist(), strict=True):
                if spans:
                    x = b" ".join(_keep(words(x.encode("utf-8")), spans, window)).decode("utf-8")
                texts.append(x)
                sizes.append(None if x is None else len(x))
            cols = {n: b.column(n) for n in schema.names}
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                changed = pa.array([bool(s) for s in b.column("_sd_spans").to_pylist()])
                cols["n_chars"] = pa.compute.if_else(changed, pa.array(sizes, pa.int64()).cast(cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return out.mapInArrow(run, schema)


def digests(docs: DataFrame, *, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, gone, sha = [], [], []
            for x, spans in zip(blobs(b.column("text")), b.column("_sd_spans").to_pylist(), strict=True):
                tokens = words(x)
                kept = _keep(tokens, spans, window)
                n.append(len(tokens))
                gone.append(len(tokens) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    out = with_spans(docs.select("doc_id", "text"), window=window, k=k)
    return out.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
