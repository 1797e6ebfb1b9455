"""Hashes of whole rows that treat equal values alike: null is a value, NaN equals NaN, -0.0 equals 0.0."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(df: DataFrame, name: str) -> Column:
    """The column with one spelling per value: adding 0.0 turns -0.0 into 0.0 and hashing folds the NaNs."""
    c = F.col(f"`{name}`")
    return c + F.lit(0.0) if dict(df.dtypes)[name] in ("double", "float") else c


def row_hash(df: DataFrame, names: Iterable[str], *salt: int) -> Column:
    """64 bits over ``names`` in that order. A null flag goes in before each value, as the hash itself skips nulls."""
    parts: list[Column] = [F.lit(s) for s in salt]
    for n in names:
        c = canonical(df, n)
        parts += [c.isNull(), c]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")
