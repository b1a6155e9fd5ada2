"""Seeded, repeatable pseudo-random numbers as pure functions of a row.

A walk step, a skip-gram window shrink and a train/test shuffle all need a
random draw. Drawing from ``rand()`` would make a recomputed partition differ
from the first attempt; here the draw is a hash of (seed, row identity), so a
retried task produces the same rows and any SQL engine with ``md5`` can
reproduce the numbers exactly.

Fixed values that define the draw (must stay as they are for results to be
repeatable across versions and engines):
  * the key is ``concat_ws('|', seed, part1, part2, ...)``
  * the number is the first 15 hex digits of ``md5(key)`` read as an integer
    (60 bits, so it fits a signed BIGINT)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"
HEX_DIGITS = 15
HASH_BITS = 4 * HEX_DIGITS


def _as_col(c: Column | str | int) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def hash_int60(seed: int, *parts: Column | str | int) -> Column:
    """Non-negative 60-bit integer from md5 of the seeded key."""
    key = F.concat_ws(
        SEPARATOR, F.lit(str(int(seed))), *[_as_col(p).cast("string") for p in parts]
    )
    return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform_index(seed: int, n: Column | str | int, *parts: Column | str | int) -> Column:
    """Integer in ``[0, n)`` chosen uniformly (bias below 2**-40 for n < 2**20)."""
    return F.pmod(hash_int60(seed, *parts), _as_col(n).cast("bigint"))


def hash_fraction(seed: int, *parts: Column | str | int) -> Column:
    """Double in ``[0, 1)`` derived from the same hash."""
    return hash_int60(seed, *parts).cast("double") / F.lit(float(2**HASH_BITS))
