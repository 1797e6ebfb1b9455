"""Hilbert codes as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(x: Column, low: Column, high: Column, bits: int) -> Column:
    """The cell of ``x`` among 2**bits equal cells of [low, high); values outside go to the end cells, null to cell 0."""
    cells = 1 << bits
    cell = F.floor((x - low).cast("double") * cells / (high - low).cast("double"))
    low_end, high_end = F.lit(0).cast("long"), F.lit(cells - 1).cast("long")
    return F.when(cell.isNull(), low_end).otherwise(F.greatest(low_end, F.least(high_end, cell)))


def hilbert2(x: Column, y: Column, bits: int) -> Column:
    """Distance along the Hilbert curve of order ``bits`` through the 2**bits x 2**bits grid, from the top bit down.

    Each step takes one bit of x and of y: the quadrant's rank is 3*bx xor by, and the lower bits are turned so that
    the curve leaves each quadrant next to where it enters the following one.
    """
    top = (1 << bits) - 1
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), long(0).alias("d"))

    def step(acc: Column, k: Column) -> Column:
        bx = F.pmod(F.call_function("div", acc["x"], k), long(2))
        by = F.pmod(F.call_function("div", acc["y"], k), long(2))
        turn, flip = by == 0, (by == 0) & (bx == 1)
        px = F.when(flip, long(top) - acc["x"]).otherwise(acc["x"])
        py = F.when(flip, long(top) - acc["y"]).otherwise(acc["y"])
        rank = (bx * 3).bitwiseXOR(by)
        return F.struct(F.when(turn, py).otherwise(px).alias("x"), F.when(turn, px).otherwise(py).alias("y"), (acc["d"] * 4 + rank).alias("d"))

    steps = F.array(*(long(1 << b) for b in range(bits - 1, -1, -1)))
    return F.aggregate(steps, start, step, lambda acc: acc["d"])
