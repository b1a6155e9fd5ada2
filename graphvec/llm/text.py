"""Small helpers that the text operators share: words, word hashes, shingle hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


#: Rows of an Arrow batch that are turned into Python objects at a time.
PIECE_ROWS = 256


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that no whole batch of texts is copied."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty, without decoding."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(blob: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` cuts at exactly these six characters."""
    return blob.split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(32))) * _MULT
    return h ^ (h >> _SHIFT)


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words; empty with fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(m, np.uint64((seed * 0x632BE59BD9B4E019 + n) & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + m])
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct ``n``-word shingles, ascending. Fewer words than ``n`` make one
    shingle of the whole sequence; no word makes none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    return np.unique(ngram_hashes(hashes, min(n, len(hashes))))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (the file sizes for a plain scan). Used for partition
    counts only, never for what is computed."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))
