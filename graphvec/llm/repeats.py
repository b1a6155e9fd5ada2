"""Which 64-bit values occur more than once in a corpus: exact counts by blocks of values, kept
as filters of fixed size.

Tasks cut their values by the leading bits into blocks and send each block's distinct values (the
32 bits after the block's, as differences) as one binary row a chunk. A block is counted by one task; the
number of blocks follows the input's size, and a value occurs once a chunk at most, so a hot value
adds a few bytes for each chunk. What comes back is a bit filter of the values seen twice or more
and a small table of levels (log2 of the count) for frequent ones. Both have a fixed size; where a
corpus outgrows them they let more values through, which costs time and never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from graphvec.llm.text import estimated_bytes, pieces

#: Bits of the filter of repeated values (16 MB) and slots of the table of levels (4 MB).
FILTER_BITS, LEVEL_BITS = 27, 22
#: Counts from this on have a level of their own; below it the level is 0.
FREQUENT = 16
CHUNK_VALUES = 1_000_000
BLOCK_BYTES = 2 << 20


def block_bits(df: DataFrame) -> int:
    """Bits that name a block, so that a block has about ``BLOCK_BYTES`` of the input."""
    return int(np.clip(np.ceil(np.log2(max(estimated_bytes(df), 1) / BLOCK_BYTES)), 6, 18))


#: Bits of a value that are told apart within a block.
LOW_BITS = 32


def _low(values: np.ndarray) -> bytes:
    """Ascending values as planes of the bytes of their differences; the upper planes are
    nearly all zero and vanish in the shuffle's compression."""
    low = values & np.uint64((1 << LOW_BITS) - 1)
    step = np.diff(low, prepend=np.uint64(0)).astype("<u4")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.uint64))


def _chunk(values: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row a block: its distinct values, then those found more than once with their counts."""
    top = values >> np.uint64(64 - bits - LOW_BITS)
    top, n = np.unique(top, return_counts=True)
    block = (top >> np.uint64(LOW_BITS)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.array([0])
    rows: list[tuple] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        many = np.flatnonzero(n[a:b] > 1)
        rows.append((int(block[a]), _low(top[a:b]), _low(top[a:b][many]), n[a:b][many].astype("<u4").tobytes()))
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "vals", "many", "counts"])


def _count_block(bits: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        vals = np.concatenate([_wide(x) for x in rows["vals"]])
        many = np.concatenate([_wide(x) for x in rows["many"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]).astype(np.int64) - 1
        got, n = np.unique(vals, return_counts=True)
        np.add.at(n, np.searchsorted(got, many), counts)
        got, n = got[n > 1] | np.uint64(block << LOW_BITS), n[n > 1]
        filled = np.zeros(1 << (FILTER_BITS - bits), bool)
        levels = np.zeros(1 << (LEVEL_BITS - bits), np.uint8)
        for slot in _slots(got, bits, FILTER_BITS):
            filled[slot - (block << (FILTER_BITS - bits))] = True
        frequent = n >= FREQUENT
        slot = _slots(got[frequent], bits, LEVEL_BITS)[0] - (block << (LEVEL_BITS - bits))
        np.maximum.at(levels, slot, np.log2(n[frequent]).astype(np.uint8))
        return pd.DataFrame({"block": [block], "filled": [np.packbits(filled, bitorder="little").tobytes()], "levels": [levels.tobytes()]})

    return run


def _slots(top: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of a value (given by its leading ``bits + LOW_BITS`` bits), in its block's slice."""
    slice_at = (top >> np.uint64(LOW_BITS)) << np.uint64(size - bits)
    mask = np.uint64((1 << (size - bits)) - 1)
    v = ((top & np.uint64((1 << LOW_BITS) - 1)) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return (slice_at | (v & mask)).astype(np.int64), (slice_at | ((v >> np.uint64(34)) & mask)).astype(np.int64)


class Repeats:
    """The filter, on an executor."""

    def __init__(self, bits: int, filled: np.ndarray, levels: np.ndarray):
        self.bits, self.filled, self.levels = bits, filled, levels

    def repeated(self, values: np.ndarray) -> np.ndarray:
        """True for every value seen twice or more, and for few others."""
        a, b = _slots(self._top(values), self.bits, FILTER_BITS)
        return (self._bit(a) & self._bit(b)).astype(bool)

    def level(self, values: np.ndarray) -> np.ndarray:
        """log2 of the count of a frequent value, else 0, never too low; a fixed function of
        the value."""
        return self.levels[_slots(self._top(values), self.bits, LEVEL_BITS)[0]]

    def _top(self, values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(64 - self.bits - LOW_BITS)

    def _bit(self, slot: np.ndarray) -> np.ndarray:
        return (self.filled[slot >> 3] >> (slot & 7).astype(np.uint8)) & np.uint8(1)


def find_repeats(docs: DataFrame, columns: list[str], values: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> Repeats:
    """Count what ``values`` yields for the batches of ``docs``.

    The driver receives each block's slice of the two arrays: 20 MB in all at any input size."""
    bits = block_bits(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches):
            for v in values(b):
                held.append(v)
                n += len(v)
                if n >= CHUNK_VALUES:
                    yield _chunk(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield _chunk(np.concatenate(held), bits)

    chunks = docs.select(*columns).mapInArrow(run, "block long, vals binary, many binary, counts binary")
    found = chunks.groupBy("block").applyInPandas(_count_block(bits), "block long, filled binary, levels binary")
    filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    levels = np.zeros(1 << LEVEL_BITS, np.uint8)
    for row in found.collect():
        at = row["block"] << (FILTER_BITS - 3 - bits)
        filled[at : at + len(row["filled"])] = np.frombuffer(row["filled"], np.uint8)
        at = row["block"] << (LEVEL_BITS - bits)
        levels[at : at + len(row["levels"])] = np.frombuffer(row["levels"], np.uint8)
    return Repeats(bits, filled, levels)
