"""Dense-vector arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns with
higher-order built-ins; everything accumulates in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def array_l2(a: Column | str) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    den = array_l2(a) * array_l2(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(array_dot(a, b) / den)


def array_to_text(a: Column | str, sep: str = " ") -> Column:
    return F.array_join(_c(a).cast("array<string>"), sep)


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(_c(c).cast("double"), places)
