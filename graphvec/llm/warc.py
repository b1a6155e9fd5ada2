"""WARC archives through a chunked record table.

Writing. Equal payloads of at least ``REVISIT_BYTES`` bytes are found by their SHA-1 and length:
the row with the largest page_id is the ``response``, the others become ``revisit`` records that
refer to it. Each row then streams through one generator that yields (record identifier, chunk
number, bytes) rows of at most ``chunk_bytes``, updating the payload's digest chunk by chunk. A
payload of more than one chunk becomes a segmented record (WARC-Segment-Number, closed by
WARC-Segment-Total-Length and the digest), so neither side ever holds a whole archive or builds a
whole record. The chunk rows are written as gzip text files: their concatenation is a valid WARC
file, and one file is read by one task in its order.

Reading. A parser streams the lines of a file and yields the same chunk rows; they are dealt by
record identifier, sorted by chunk number, and length and digest are computed incrementally. A
revisit takes length and digest of the record that it refers to.

Defined results: a null payload is empty; a null page_id is older than all others and gets no
revisit if all copies' ids are null. Rows repeated with the same page_id and payload are
all responses if theirs is the largest page_id. Every row has a record of its own, so repeated
rows return repeated results. An empty table writes no records. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphvec.session import bounded_batches

REVISIT_BYTES = 1000
CHUNK_BYTES = 256 * 1024
_DATE = "1970-01-01T00:00:00Z"


def classify(pages: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, refers_to)``: ``refers_to`` is null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("html"),
    )
    rows = rows.withColumns({"_sha": F.sha1("html"), "_n": F.length("html")})
    last = (
        rows.where(F.col("_n") >= least)
        .groupBy("_sha", "_n")
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1")
        .drop("_copies")
    )
    older = F.col("_last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")))
    return rows.join(last, ["_sha", "_n"], "left").select("page_id", "url", "html", F.when(older, F.col("_last")).alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = [(k, v.replace("\r", " ").replace("\n", " ")) for k, v in fields]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n").encode("utf-8")


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def records(page_id: int | None, url: str | None, html: bytes, refers_to: int | None, chunk_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(chunk number, record bytes) of one page, each a complete WARC record or segment."""
    base = [("WARC-Date", _DATE), ("WARC-Target-URI", url or ""), ("Content-Type", "text/html")]
    view = memoryview(html)
    if refers_to is not None:
        sha = hashlib.sha1()
        for at in range(0, len(view), chunk_bytes):
            sha.update(view[at : at + chunk_bytes])
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Refers-To", urn(refers_to)),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}"), *base, ("Content-Length", "0")]
        yield 1, _header(fields) + b"\r\n\r\n"
        return
    sha, many = hashlib.sha1(), len(view) > chunk_bytes
    for number, at in enumerate(range(0, max(len(view), 1), chunk_bytes), 1):
        part = view[at : at + chunk_bytes]
        sha.update(part)
        name = urn(page_id) if number == 1 else f"{urn(page_id)[:-1]}:{number}>"
        fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", name), *base]
        if many:
            fields.append(("WARC-Segment-Number", str(number)))
            if number > 1:
                fields.append(("WARC-Segment-Origin-ID", urn(page_id)))
        if at + chunk_bytes >= len(view):
            fields.append(("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}"))
            if many:
                fields.append(("WARC-Segment-Total-Length", str(len(view))))
        fields.append(("Content-Length", str(len(part))))
        yield number, b"".join((_header(fields), part, b"\r\n\r\n"))


_CHUNKS = "record_id string, chunk long, data binary"


def chunk_table(classified: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(record_id, chunk, data)``: the archive as rows, in the order of its bytes."""
    bounded_batches(classified.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, held = ([], [], []), 0
            for page_id, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                pid = page_id.as_py()
                for number, data in records(pid, url.as_py(), memoryview(html.as_buffer() or b""), refers.as_py(), chunk_bytes):
                    for c, v in zip(cols, (urn(pid), number, data), strict=True):
                        c.append(v)
                    held += len(data)
                    if held >= 4 << 20:
                        yield _rows(cols)
                        cols, held = ([], [], []), 0
            if cols[0]:
                yield _rows(cols)

    return classified.select("page_id", "url", "html", "refers_to").mapInArrow(run, _CHUNKS)


def _rows(cols: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["record_id", "chunk", "data"])


def write_archives(pages: DataFrame, path: str, *, least: int = REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Gzip WARC files below ``path``. Each chunk row ends with the line feed that the text
    writer adds, so the files hold exactly the records."""
    rows = chunk_table(classify(pages, least=least), chunk_bytes)
    value = F.substring(F.col("data"), F.lit(1), F.length("data") - 1).cast("string")
    rows.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


class Parser:
    """Chunks of a WARC stream, fed line by line without their line feeds."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.need = -1  # payload bytes still to come; -1: in a header
        self.parts: list[bytes] = []
        self.tail = 0  # closing lines to skip

    def line(self, raw: bytes) -> tuple[dict[str, str], bytes] | None:
        """The record that this line completes."""
        if self.tail:
            self.tail -= 1
            return None
        if self.need < 0:
            text = raw.rstrip(b"\r")
            if self.fields is None:
                if not text.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record begins with {text[:40]!r}")
                self.fields = {}
            elif text:
                key, _, value = text.partition(b":")
                self.fields[key.decode().lower()] = value.strip().decode("utf-8")
            else:
                self.need, self.parts = int(self.fields["content-length"]), []
            return None
        if len(raw) >= self.need:  # the payload ends in this line, which "\r" closes
            self.parts.append(raw[: self.need])
            if raw[self.need :] != b"\r":
                raise ValueError("a record is longer than its Content-Length")
            fields, data = self.fields, b"".join(self.parts)
            self.fields, self.need, self.parts, self.tail = None, -1, [], 1
            return fields, data
        self.parts.append(raw + b"\n")
        self.need -= len(raw) + 1
        return None


_READ = "file string, record_no long, chunk long, page_id long, record_type string, refers_to long, digest string, data binary"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(name: str | None) -> int | None:
    part = (name or "").removeprefix("<urn:page:").rstrip(">").split(":")[0]
    return int(part) if part not in ("", "null") else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of archives to chunk rows."""
    names = [x.split(" ")[0] for x in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    now, parser, number = None, Parser(), 0
    rows, held = [], 0
    for b in batches:
        for file, raw in zip(b.column("file").to_pylist(), b.column("value").to_pylist(), strict=True):
            if file != now:
                now, parser, number = file, Parser(), 0
            got = parser.line(raw)
            if got is None:
                continue
            fields, data = got
            chunk = int(fields.get("warc-segment-number", 1))
            number += chunk == 1
            kind = fields["warc-type"]
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            rows.append((file, number, chunk, _page(fields["warc-record-id"]), kind, _page(fields.get("warc-refers-to")), digest, data))
            held += len(data) + 200
            if held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows to records. A record's chunks stand together and in order: one task wrote them to one file."""
    key, sha, size, chunk, head, stored, out = None, None, 0, 0, None, None, []

    def close() -> None:
        if key is None:
            return
        digest = sha.hexdigest()
        if head[1] == "revisit":
            out.append((head[0], None, stored, head[1], head[2]))
            return
        if stored != digest:
            raise ValueError(f"record of page {head[0]}: stored digest {stored}, computed {digest}")
        out.append((head[0], size, digest, head[1], None))

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in _RECORDS.split(", ")])

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("file", "record_no", "chunk", "page_id", "record_type", "refers_to", "digest")]
        for i, (file, number, part, page_id, kind, refers, digest) in enumerate(zip(*cols, strict=True)):
            if (file, number) != key:
                close()
                key, sha, size, chunk, head, stored = (file, number), hashlib.sha1(), 0, 0, (page_id, kind, refers), None
            if part != chunk + 1:
                raise ValueError(f"page {page_id}: chunk {part} follows chunk {chunk}")
            data = memoryview(b.column("data")[i].as_buffer() or b"")
            sha.update(data)
            size, chunk, stored = size + len(data), part, digest or stored
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below ``path``: (file, record_no) identify a
    record, ``chunk`` numbers its segments from 1."""
    return _lines(spark, path).mapInArrow(_parsed, _READ)


def read_records(chunks: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` from chunk rows. The
    digest runs over the chunks of a record as they come, and is held against the stored one.
    Raises if a stored digest does not fit or a chunk is missing."""
    bounded_batches(chunks.sparkSession)
    return chunks.mapInArrow(_digested, _RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``read_records`` of ``read_chunks``, both steps in one Python function: a task has one worker
    instead of two, and payloads do not travel through the JVM between the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digested(_parsed(batches))

    return _lines(spark, path).mapInArrow(run, _RECORDS)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records as ``read_records`` returns them, revisits with the length that the referred
    record has. A revisit of a record that is not there, or has another digest, raises."""
    revisit = F.col("record_type") == "revisit"
    there = (
        found.where(~revisit & F.col("page_id").isNotNull() & (F.col("payload_bytes") > 0))
        .select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("_bytes"))
        .distinct()
    )
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    lost = F.raise_error(F.concat_ws(" ", F.lit("no response for the revisit of page"), F.col("page_id").cast("string"), F.lit("by page"), F.col("refers_to").cast("string")))
    looked_up = found.where(revisit).join(there, ["refers_to", "payload_digest"], "left")
    looked_up = looked_up.withColumn("payload_bytes", F.when(F.col("_bytes").isNull(), lost.cast("long")).otherwise(F.col("_bytes")))
    return found.where(~revisit).select(*cols).unionByName(looked_up.select(*cols))
