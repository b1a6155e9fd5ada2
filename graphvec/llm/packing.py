"""Packing by power-of-two decomposition.

A document of L tokens (its ids and an end token) is cut into pieces whose lengths are the powers
of two of L's binary form, the longest first; what exceeds ``max_length`` (a power of two) is cut
into pieces of ``max_length``. A piece is a sequence of its own, so no sequence crosses documents
and none needs padding; batches are built from one bucket of equal lengths.

Everything happens in one pass over the rows: no shuffle, no state between documents.

Defined results: null or empty text is the end token alone (one piece of length 1). A null doc_id
stays null. Repeated rows give repeated pieces under sequence ids of their own. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphvec.llm.bpe import PATTERN, byte_alphabet

END_ID = 1
MAX_LENGTH = 2048
#: Whitespace runs from this length on do not go through tiktoken's pattern: it steps back over them and
#: raises beyond a million characters.
LONG_RUN = 500_000


def cut_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """``n`` as whole pieces of ``max_length`` and then falling powers of two."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


_LOADED: dict = {}


def tokenizer(path: str):
    """The vocabulary file as a tiktoken encoding: in a byte-level BPE file without extra merges
    an id is its merge's rank. Loaded once a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        _LOADED[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _LOADED[path]


def encode(encoding, text: str) -> list[int]:
    """Ids of a text, whatever the length of its whitespace runs. No pre-token looks behind or goes
    on from other characters into a run, so a run can be taken out: it is one pre-token, without
    its last character where other text follows (that character belongs to what follows)."""
    if len(text) < LONG_RUN:
        return encoding.encode(text, allowed_special="all")
    run_of = regex.compile(rf"(?<!\s)\s{{{LONG_RUN},}}")
    if not run_of.search(text):
        return encoding.encode(text, allowed_special="all")
    added = sorted(encoding.special_tokens_set, key=len, reverse=True)
    out: list[int] = []
    for part in regex.split("(" + "|".join(map(regex.escape, added)) + ")", text) if added else [text]:
        if part in encoding.special_tokens_set:
            out.append(encoding.encode_single_token(part))
            continue
        at = 0
        for run in run_of.finditer(part):
            out += encoding.encode_ordinary(part[at : run.start()])
            at = run.end() if run.end() == len(part) else run.end() - 1
            out += encoding._encode_single_piece(part[run.start() : at])
        out += encoding.encode_ordinary(part[at:])
    return out


def pack(docs: DataFrame, path: str, *, max_length: int = MAX_LENGTH, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)``, one row a piece;
    ``length`` names the bucket. With ``digest`` the ids are replaced by ``ids_crc32``, the CRC-32
    of their little-endian 32-bit form."""
    cut_lengths(0, max_length)
    last = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        for b in batches:
            ids_of = b.column("doc_id").cast(pa.int64()).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            held = 0
            for doc_id, text in zip(ids_of, b.column("text"), strict=True):
                ids = np.array([*encode(encoding, text.as_py() or ""), end_id], dtype="<u4")
                at = 0
                for n in cut_lengths(len(ids), max_length):
                    piece = ids[at : at + n]
                    for c, v in zip(cols, (doc_id, at, n, len(ids), zlib.crc32(piece.tobytes()) if digest else piece.astype(np.int32)), strict=True):
                        c.append(v)
                    at += n
                    held += n
                    if held >= 1_000_000:
                        yield _batch(cols, last[0], digest)
                        cols, held = [[], [], [], [], []], 0
            if cols[0]:
                yield _batch(cols, last[0], digest)

    schema = f"doc_id long, start long, length long, doc_tokens long, {last[0]} {last[1]}"
    pieces = docs.select("doc_id", "text").mapInArrow(run, schema)
    # Unique in one run of the job: the partition's number and the row's place in it.
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _batch(cols: list[list], name: str, digest: bool) -> pa.RecordBatch:
    kind = pa.int64() if digest else pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], kind)],
        ["doc_id", "start", "length", "doc_tokens", name],
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder a length, for loaders that fill batches from one bucket. Each task appends its
    own files, so no bucket passes through one task."""
    pieces.write.partitionBy("length").parquet(path)
