"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, places: int) -> Column:
    """Half up at so many places; what rounds to zero keeps its sign, as IEEE arithmetic has it."""
    x = F.col(c) if isinstance(c, str) else c
    r = F.round(x, places)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)
