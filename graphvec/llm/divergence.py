"""Divergence audit of sources: how far each source's use of words lies from the other sources of its
language, and which words it uses more than its language does.

Counts are made in one pass over the texts: a task sums its own (language, source, term) counts before
the shuffle. A language keeps the terms found in at least ``least_docs`` of its documents. A group's share
of a kept term, in billionths, is ``1 + floor(10^9 * (count + 5) / (N + 5 V))``.

All pairs of groups are compared by a three-dimensional cube. Groups of a language are dealt to blocks of
about ``GROUP_BLOCK`` and its kept terms to blocks of about ``TERM_BLOCK``, both by hash. A slice is what one
group has in one term block; it is sent to the cells (group block, group block, term block) that need it, once
for each group block of its language. A cell is a group of its own, holds at most two blocks of groups as dense
rows of ``TERM_BLOCK`` shares, and returns a partial sum for each of its pairs; partial sums are
added along the term axis by a plain aggregate. So neither a source with a third of all rows nor a term in every
document is more than one slice or one number in a cell.

Shares are computed exactly at any count (long division in integers).

Defined results: null text, language and source are empty strings. A group without terms takes part with
counts of 0; a language without kept terms gives pairs of value 0 and no terms. A very long text is counted piece by
piece of its batch and sends distinct terms only. Repeated rows count each time. An empty table gives no rows. Ties
are ranked by the item's UTF-8 bytes. Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphvec.llm.text import blobs, pieces
from graphvec.session import write_table

LEAST_DOCS, ADDED, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Groups and terms of a block, on average. A cell's dense shares take GROUP_BLOCK * TERM_BLOCK * 16 bytes (8 MB).
GROUP_BLOCK, TERM_BLOCK = 64, 8192
#: Text that a task counts before it passes its sums on.
FLUSH_BYTES = 32 << 20

#: ASCII characters that part terms (all but letters) become blanks, capitals become small.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(blob: bytes) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased."""
    return blob.translate(_FOLD).split()


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """``1 + floor(SCALE * (counts + ADDED) / whole)`` by long division, three digits at a time: exact
    for any ``whole`` below 9 * 10^15."""
    out, rest = np.divmod(counts.astype(np.int64) + ADDED, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _share(count: str, whole: str) -> Column:
    """``shares`` as a column."""
    return F.expr(f"1 + cast({count} + {ADDED} as decimal(19,0)) * cast({SCALE} as decimal(10,0)) div cast({whole} as decimal(19,0))")


def _groups_of(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term, and documents that hold it."""

    def batch(found: dict, held: dict) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), counts in found.items():
            cols[0] += [lang] * len(counts)
            cols[1] += [source] * len(counts)
            cols[2] += counts
            cols[3] += counts.values()
            cols[4] += map(held[lang, source].__getitem__, counts)
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size = {}, {}, 0
        for b in pieces(batches):
            for lang, source, blob in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), blobs(b.column("text")), strict=True):
                here = terms(blob)
                found.setdefault((lang, source), Counter()).update(here)
                held.setdefault((lang, source), Counter()).update(set(here))
                size += len(blob)
                if size >= FLUSH_BYTES:
                    yield batch(found, held)
                    found, held, size = {}, {}, 0
        if found:
            yield batch(found, held)

    rows = docs.select(*_groups_of(docs), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _blocks(count: str, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(count) / F.lit(size))).cast("int")


def _block_of(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of one cell. Rows are slices: gb, source, whole, width, at, counts."""
    lang, one, two, _ = key
    width = int(rows["width"].iloc[0])

    def dense(part: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        part = part.sort_values("source")
        out = np.zeros((len(part), width), np.int64)
        for i, (at, counts, whole) in enumerate(zip(part["at"], part["counts"], part["whole"], strict=True)):
            if at is not None and len(at):
                out[i, np.asarray(at)] = counts
            out[i] = shares(out[i], whole) if width else out[i]
        return part["source"].tolist(), out

    names, a = dense(rows[rows["gb"] == one])
    others, b = (names, a) if one == two else dense(rows[rows["gb"] == two])
    first, second, value = [], [], []
    for i, name in enumerate(names):
        start = i + 1 if one == two else 0
        first += [name] * (len(others) - start)
        second += others[start:]
        value.append(np.abs(b[start:] - a[i]).sum(axis=1))
    # object columns: an empty frame of strings has none of the chunks that Arrow asks for
    text = {c: pd.Series(x, dtype=object) for c, x in (("lang", [lang] * len(first)), ("a", first), ("b", second))}
    return pd.DataFrame({**text, "value": np.concatenate(value) if value else np.zeros(0, np.int64)})


def prepare(docs: DataFrame, *, least_docs: int = LEAST_DOCS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: groups ``(lang, source, n, v, total, gb, gbs, tbs)``, term blocks ``(lang, tb, width)`` and the
    counts of kept terms ``(lang, source, term, n, held, tb, at)``, ``at`` being the term's place in its block."""
    counts = write_table(term_counts(docs), "term_counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("held")).where(F.col("docs") >= least_docs)
    kept = write_table(kept.select("lang", "term", "held"), "kept_terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("held").alias("total"))
    langs = write_table(langs.withColumn("tbs", _blocks("v", term_block)), "kept_languages")
    place = Window.partitionBy("lang", "tb").orderBy("term")
    numbered = kept.join(langs.select("lang", "tbs"), "lang").withColumn("tb", _block_of("term", "tbs")).drop("tbs")
    numbered = write_table(numbered.withColumn("at", F.row_number().over(place) - 1), "numbered_terms")
    widths = numbered.groupBy("lang", "tb").agg(F.count(F.lit(1)).cast("int").alias("width"))
    mine = write_table(counts.join(numbered, ["lang", "term"]).select("lang", "source", "term", "n", "held", "tb", "at"), "kept_counts")

    groups = docs.select(*_groups_of(docs)).distinct()
    sums = mine.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    several = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s")).select("lang", _blocks("s", group_block).alias("gbs"))
    groups = groups.join(sums, ["lang", "source"], "left").join(several, "lang").join(langs, "lang", "left")
    groups = groups.na.fill({"n": 0, "v": 0, "total": 0, "tbs": 1}).withColumn("gb", _block_of("source", "gbs"))
    return write_table(groups, "audited_groups"), widths, mine


def pair_divergences(groups: DataFrame, widths: DataFrame, mine: DataFrame) -> DataFrame:
    """``(lang, a, b, value)`` of every two sources of a language, a before b or after, once."""
    packed = mine.groupBy("lang", "source", "tb").agg(F.collect_list(F.struct("at", "n")).alias("x"))
    grid = groups.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tbs") - 1))).join(widths, ["lang", "tb"], "left")
    slices = grid.join(packed, ["lang", "source", "tb"], "left").select(
        "lang", "source", "tb", "gb", "gbs", F.coalesce("width", F.lit(0)).alias("width"), (F.col("n") + ADDED * F.col("v")).alias("whole"),
        F.col("x.at").alias("at"), F.col("x.n").alias("counts"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("gbs") - 1))
    cells = slices.withColumn("other", other).withColumns({"one": F.least("gb", "other"), "two": F.greatest("gb", "other")})
    partial = cells.groupBy("lang", "one", "two", "tb").applyInPandas(_cell, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, top_terms: int = TOP_TERMS, **settings) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` ranks the other sources of the language by their
    divergence from the source, part ``term`` the ``top_terms`` terms that the source uses most above its language."""
    groups, widths, mine = prepare(docs, **settings)
    pairs = write_table(pair_divergences(groups, widths, mine), "divergences")
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    whole = groups.select("lang", "source", (F.col("n") + ADDED * F.col("v")).alias("whole"), (F.col("total") + ADDED * F.col("v")).alias("all"))
    used = mine.join(whole, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (_share("n", "whole") - _share("held", "all")).alias("value"))
    used = used.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, x in (("pair", pairs), ("term", used))]
    return out[0].unionByName(out[1])
