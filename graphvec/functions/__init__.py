"""Column-expression helpers. Every function returns a ``Column`` built from
Spark built-ins, so it stays inside whole-stage codegen (no Python UDF)."""

from graphvec.functions.hashing import hash_fraction, hash_int60, uniform_index
from graphvec.functions.vectors import (
    array_dot,
    array_l2,
    array_to_text,
    cosine,
    rounded,
)

__all__ = [
    "array_dot",
    "array_l2",
    "array_to_text",
    "cosine",
    "hash_fraction",
    "hash_int60",
    "rounded",
    "uniform_index",
]
