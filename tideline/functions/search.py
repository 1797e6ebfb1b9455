"""Look-ups in sorted arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEW = 8  # as many values are gone through faster than halved


def count_upto(values: Column, key: Column, strict: bool = False) -> Column:
    """How many of the ascending ``values`` are at or below ``key`` (``strict``: below it), by bisection; 0 for null and empty arrays."""
    n = F.coalesce(F.size(values), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        here = F.get(values, mid)
        open_ = acc["low"] < acc["high"]
        right = open_ & ((here < key) if strict else (here <= key))
        return F.struct(F.when(right, mid + 1).otherwise(acc["low"]).alias("low"), F.when(right | ~open_, acc["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    few = F.size(F.filter(values, (lambda x: x < key) if strict else (lambda x: x <= key)))
    return F.when(n == 0, 0).when(n <= FEW, few).otherwise(_bisected(n, start, step))


def _bisected(n: Column, start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int")), start, step, lambda acc: acc["low"])
