"""Quality rules: a base rule on every text, and robust multivariate outliers.

Each text gives a vector of transformed statistics (see ``VECTOR``). For every language and source
the location and scatter are estimated by a minimum covariance determinant: from quartile-based
starting values, concentration steps take the ``core`` share of rows that lie closest and
estimate again from these. A text whose squared Mahalanobis distance, scaled so that the
group's median is the chi-square median (never scaled up in strictness), exceeds the chi-square quantile is rejected.

All rows are counted in every step: a step is one grouped sum over (group, distance bin), whose
result has a bounded number of rows for each group, so a hot source is summed in its map
tasks first. Bins are a sixteenth of a doubling wide. Groups with fewer than ``least`` rows take the estimate of
their language, or of all rows. The scatter has a floor for each statistic, so constant columns do
no harm. Rows that fail the base rule are rejected and estimate nothing.

Defined results: null or empty text has no words, fails the base rule and is rejected. Null lang or
source is a group of its own. Repeated rows count each time and are judged alike. A table without rows that
pass the base rule rejects all; an empty table returns none. Extra columns do not matter; ``filter_quality`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphvec.llm.text import blobs, pieces, words
from graphvec.session import write_table

#: Statistic -> floor of its standard deviation. log mean word length; square roots of the
#: shares of symbols by word, of repeated lines, of words in repeated 3-word windows, of capitals and of
#: ASCII punctuation by character.
VECTOR = {"len": 0.05, "symbols": 0.08, "lines": 0.13, "repeats": 0.14, "capitals": 0.06, "marks": 0.05}
CORE, STEPS, LEAST, ALPHA = 0.75, 4, 200, 1e-7
P = len(VECTOR)
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SYMBOLS = b"#*$%&|<>"


def repeated_words(tokens: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more, first ones included."""
    if len(tokens) < n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, len(tokens))
    m = len(ids) - n + 1
    key = ids[:m]
    for i in range(1, n):
        # ranks keep the key small: (a, b) -> rank, then (rank, c)
        key = np.unique(key, return_inverse=True)[1] if i > 1 else key
        key = key * len(number) + ids[i : i + m]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(blob: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the vector of a text."""
    tokens = words(blob)
    n = len(tokens)
    points = sum(map(len, tokens)) - _continued(blob)
    symbols = len(blob) - len(blob.translate(None, _SYMBOLS))
    lines = [x for x in blob.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(tokens)
    capitals = len(blob) - len(blob.translate(None, _CAPITALS))
    marks = len(blob) - len(blob.translate(None, _MARKS))
    vector = [
        math.log((points + 1) / (n + 1)),
        math.sqrt(symbols / (n + 1)),
        math.sqrt(dup / (len(lines) + 1)),
        math.sqrt(repeats / (n + 1)),
        math.sqrt(capitals / (points + 1)),
        math.sqrt(marks / (points + 1)),
    ]
    return n, points, symbols, dup, repeats, vector


_CONTINUED = bytes(range(0x80, 0xC0))


def _continued(blob: bytes) -> int:
    """Bytes that continue a code point."""
    return 0 if blob.isascii() else len(blob) - len(blob.translate(None, _CONTINUED))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct column ``_q`` of its statistics."""
    kind = pa.struct([*((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [statistics(x) for x in blobs(b.column("text"))]
            cols = [pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [[]] * 6, kind, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, fields=list(kind))], [*b.schema.names, "_q"])

    struct = "_q struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,x:array<double>>"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(struct).fields]))


def _base_failed() -> Column:
    n, r = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def chi2_quantile(q: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    z, c = NormalDist().inv_cdf(q), 2 / (9 * k)
    return k * (1 - c + z * math.sqrt(c)) ** 3


def _group() -> list[Column]:
    """The levels of a row: its language and source, its language, all."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return [F.struct(F.lit(3).alias("level"), lang.alias("l"), source.alias("s")), F.struct(F.lit(2).alias("level"), lang.alias("l"), F.lit("").alias("s")), F.struct(F.lit(1).alias("level"), F.lit("").alias("l"), F.lit("").alias("s"))]


_KEYS = ["level", "l", "s"]
_PARAMS = "level int, l string, s string, n long, mean array<double>, inverse array<double>, det double"


def _distance(x: str = "x") -> Column:
    """Squared Mahalanobis distance as a sum of products of columns."""
    d = [F.col(x)[i] - F.col("mean")[i] for i in range(P)]
    terms = [d[i] * d[j] * F.col("inverse")[i * P + j] * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * 16).cast("int")


def _scatter(key: tuple, n: int, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    cov = cov + np.diag(np.square(list(VECTOR.values())))
    inverse = np.linalg.inv(cov)
    short = lambda a: [float(f"{v:.9g}") for v in np.ravel(a)]  # noqa: E731  sums come in any order
    return pd.DataFrame({"level": [key[0]], "l": [key[1]], "s": [key[2]], "n": [n], "mean": [short(mean)], "inverse": [short(inverse)], "det": [float(np.linalg.det(cov))]})


def _start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Medians and quartile ranges from histograms."""
    mean, sd, n = np.zeros(P), np.zeros(P), 0
    for i, part in rows.groupby("i"):
        part = part.sort_values("bin")
        total = part["n"].cumsum().to_numpy()
        n = int(total[-1])
        at = [part["bin"].to_numpy()[np.searchsorted(total, q * n)] for q in (0.25, 0.5, 0.75)]
        mean[i], sd[i] = (at[1] + 0.5) / 256, (at[2] - at[0]) / 256 / 1.349
    return _scatter(key, n, mean, np.diag(np.square(sd)))


def _concentrate(core: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        total = int(rows["n"].sum())
        # whole bins, so that at least the core is in
        last = int(np.searchsorted(rows["n"].cumsum().to_numpy(), math.ceil(core * total)))
        part = rows.iloc[: last + 1]
        n = int(part["n"].sum())
        first = np.sum(np.stack(part["sx"].to_list()), axis=0)
        second = np.sum(np.stack(part["sxx"].to_list()), axis=0)
        cov = np.zeros((P, P))
        cov[np.triu_indices(P)] = second / n
        cov = cov + np.triu(cov, 1).T
        mid = first / n
        center = np.array(part["mean"].iloc[0])
        return _scatter(key, total, center + mid, cov - np.outer(mid, mid))

    return run


def _scale(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("bin")
    total = rows["n"].cumsum().to_numpy()
    at = rows["bin"].to_numpy()[np.searchsorted(total, 0.5 * total[-1])]
    return pd.DataFrame({"level": [key[0]], "l": [key[1]], "s": [key[2]], "scale": [max(1.0, 2.0 ** ((at + 1) / 16) / chi2_quantile(0.5, P))]})


def estimate(rows: DataFrame, *, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """``(level, l, s, n, mean, inverse, det, scale)`` from ``rows(lang, source, x)``."""
    if not 0.5 <= core <= 1:
        raise ValueError("the core is between one half and all")
    all_levels = rows.select("x", F.explode(F.array(*_group())).alias("g")).select("x", "g.*")
    bins = all_levels.select(*_KEYS, F.posexplode("x").alias("i", "v")).groupBy(*_KEYS, "i", F.floor(F.col("v") * 256).alias("bin"))
    params = bins.agg(F.count(F.lit(1)).alias("n")).groupBy(*_KEYS).applyInPandas(_start, _PARAMS)
    params = write_table(params, "mcd")
    for _ in range(steps):
        d = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
        sums = [F.array(*[F.sum(d[i]) for i in range(P)]).alias("sx"), F.array(*[F.sum(d[i] * d[j]) for i in range(P) for j in range(i, P)]).alias("sxx")]
        near = all_levels.join(params, _KEYS).withColumn("bin", _bin(_distance()))
        near = near.groupBy(*_KEYS, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), *sums)
        params = write_table(near.groupBy(*_KEYS).applyInPandas(_concentrate(core), _PARAMS), "mcd")
    bins = all_levels.join(params, _KEYS).groupBy(*_KEYS, _bin(_distance()).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    scale = bins.groupBy(*_KEYS).applyInPandas(_scale, "level int, l string, s string, scale double")
    return write_table(params.join(scale, _KEYS), "mcd")


def judge(rows: DataFrame, *, core: float = CORE, steps: int = STEPS, least: int = LEAST, alpha: float = ALPHA) -> DataFrame:
    """``rows`` (with lang, source and ``_q``; written by the caller) with ``_base_failed``, ``_d2``
    (null where there is no estimate) and ``_kept``."""
    fine = rows.where(~_base_failed()).select("lang", "source", F.col("_q.x").alias("x"))
    params = estimate(fine, core=core, steps=steps)
    own, lang, _ = _group()
    kind = "struct<n:bigint,mean:array<double>,inverse:array<double>,scale:double>"
    groups = rows.select("lang", "source").distinct().withColumns({"_g3": own, "_g2": lang})
    for level in (3, 2):
        part = params.where(F.col("level") == level).select(F.struct(*_KEYS).alias(f"_g{level}"), F.struct("n", "mean", "inverse", "scale").cast(kind).alias(f"_p{level}"))
        groups = groups.join(part, f"_g{level}", "left")
    whole = params.where("level = 1").first()  # the one row for all
    rest = F.lit(None) if whole is None else F.struct(F.lit(whole["n"]), *[F.array(*map(F.lit, whole[c])) for c in ("mean", "inverse")], F.lit(whole["scale"]))
    chosen = F.coalesce(*[F.when(F.col(f"_p{k}.n") >= least, F.col(f"_p{k}")) for k in (3, 2)], rest.cast(kind))
    groups = write_table(groups.select(F.col("lang").alias("_ql"), F.col("source").alias("_qs"), chosen.alias("_qp")), "mcd_groups")
    met = rows.join(groups, F.col("lang").eqNullSafe(F.col("_ql")) & F.col("source").eqNullSafe(F.col("_qs")), "left")
    met = met.withColumns({"mean_": F.col("_qp.mean"), "inverse_": F.col("_qp.inverse")})
    d = [F.col("_q.x")[i] - F.col("mean_")[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * F.col("inverse_")[i * P + j] * (1.0 if i == j else 2.0)
    met = met.withColumns({"_base_failed": _base_failed(), "_d2": F.greatest(total, F.lit(0.0)) / F.col("_qp.scale")})
    far = F.coalesce(F.col("_d2") > chi2_quantile(1 - alpha, P), F.lit(False))
    return met.withColumn("_kept", ~F.col("_base_failed") & ~far).drop("_ql", "_qs", "_qp", "mean_", "inverse_")


def verdicts(docs: DataFrame, **settings) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)``."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text"))
    rows = write_table(rows.select("doc_id", "lang", "source", "_q"), "statistics")
    judged = judge(rows, **settings)
    return judged.select(
        "doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_d2").alias("distance"),
    )


def filter_quality(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The texts are read once, and
    written once with their statistics."""
    judged = judge(write_table(with_statistics(docs), "statistics"), **settings)
    return judged.where("_kept").select(*docs.columns)
