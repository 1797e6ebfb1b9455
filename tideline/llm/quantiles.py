"""Percentiles of very large columns, with bounded and stated rank error, from summaries that merge.

A summary is a sorted list of values, each with the least and greatest rank it can have among the n values summarised.
Where rows are read, values are sorted and thinned to every so many ranks; summaries of any parts merge into one whose
rank intervals add up, and are thinned again as far as the permitted uncertainty goes. Each level of merging gets its
share of the permitted error, and the error really reached is kept beside the summary. Nothing is random: the same
partitions give the same summaries. Of the permitted error, parts use a quarter, neighbouring parts put together a half,
a key's summary three quarters, and what is put together from such summaries all of it.

Null values are left out; groups without values have no summary; ties share a run of ranks; NaN is a value, above all
others. Few values (up to ``exact`` of a summary) are kept as they are, and all answers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH_ROWS = 1 << 20
SUMMARY = "n long, err long, v array<double>, lo array<long>, hi array<long>"


def thin(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, eps: float, exact: int = 2) -> np.ndarray:
    """Positions to keep: from each the farthest next one whose greatest rank is within 2 * eps * n of this one's least."""
    room = int(2 * eps * n)
    if room <= 1 or len(v) <= max(exact, 2):
        return np.arange(len(v))
    keep, i = [0], 0
    while i < len(v) - 1:
        i = max(i + 1, int(np.searchsorted(hi, lo[i] + room, side="right")) - 1)
        keep.append(i)
    return np.array(keep)


def reached(lo: np.ndarray, hi: np.ndarray) -> int:
    """Greatest rank error of the best value, for any rank: half the widest span from one value's least rank to the next one's greatest."""
    gap = int((hi[1:] - lo[:-1]).max()) if len(lo) > 1 else 0
    return -(-gap // 2) if gap > 1 else 0


def merge(parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], eps: float, exact: int = 2) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, v, lo, hi) of disjoint parts as (n, err, v, lo, hi) of all, in one sweep over their values."""
    n = sum(p[0] for p in parts)
    v = np.concatenate([p[1] for p in parts])
    # below a value: for each part the least rank of its last value so far; above: what its next value still allows
    up = np.concatenate([np.diff(p[2], prepend=0) for p in parts])
    down = np.concatenate([np.append(p[3][1:] - 1, p[0]) - (p[3] - 1) for p in parts])
    start = sum(int(p[3][0]) - 1 for p in parts)
    order = np.argsort(v, kind="stable")
    v, lo = v[order], np.cumsum(up[order])
    hi = start + np.cumsum(down[order]) - down[order] + 1
    k = thin(v, lo, hi, n, eps, exact)
    v, lo, hi = v[k], lo[k], hi[k]
    return n, reached(lo, hi), v, lo, hi


class Quantiles:
    """Summaries of ``value`` per ``keys``; ``eps``: permitted rank error as a share of n."""

    def __init__(self, keys: Sequence[str], eps: float = 0.0005, fan_in: int = 1024, exact: int = 4096):
        """``fan_in``: from how many parts of the input summaries are merged at once; so many squared make one key's final merge."""
        self.keys, self.eps, self.fan_in, self.exact = list(keys), eps, fan_in, exact

    def _schema(self, df: DataFrame, keys: Sequence[str]) -> str:
        kinds = dict(df.dtypes)
        return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), SUMMARY])

    def summaries(self, df: DataFrame, value: Column) -> DataFrame:
        """One summary per key and part of the input, made where the rows are read."""
        keys, eps, exact = self.keys, self.eps / 4, self.exact
        rows = df.select(*keys, value.cast("double").alias("v_")).where("v_ is not null")

        def part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).to_pandas()
            code = t.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.lexsort((t["v_"].to_numpy(), code))
            code, v = code[order], t["v_"].to_numpy()[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            n = np.diff(np.append(first, len(v)))
            rank = np.arange(len(v)) - np.repeat(first, n)
            step = np.repeat(np.where(n <= exact, 1, np.maximum(1, (2 * eps * n).astype(np.int64))), n)
            keep = (rank % step == 0) | (rank == np.repeat(n, n) - 1)
            rank = rank[keep] + 1
            per = np.add.reduceat(keep, first)
            ends = np.cumsum(per)
            err = np.where(step[first] > 1, -(-step[first] // 2), 0)
            offsets = pa.array(np.append(0, ends), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
            named = pa.Table.from_pandas(t.iloc[order[first]][keys], preserve_index=False).cast(pa.schema([held[0].schema.field(k) for k in keys]))
            cols = [*(named[k].combine_chunks() for k in keys), pa.array(n.astype(np.int64)), pa.array(err.astype(np.int64)), lists(v[keep]), lists(rank), lists(rank)]
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "n", "err", "v", "lo", "hi"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    size += b.num_rows
                if size >= FLUSH_ROWS:
                    yield part(held)
                    held, size = [], 0
            if held:
                yield part(held)

        return rows.mapInArrow(run, self._schema(rows, keys))

    def combined(self, summaries: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        """One summary per ``keys`` (a subset of the summaries' keys): first over neighbouring parts, then in all."""
        share = 0.75 if keys is None or list(keys) == self.keys else 1.0
        keys = self.keys if keys is None else list(keys)
        schema, exact = self._schema(summaries, keys), self.exact

        def level(eps: float):
            def run(b: pd.DataFrame) -> pd.DataFrame:
                parts = [(int(n), np.asarray(v, float), np.asarray(lo, np.int64), np.asarray(hi, np.int64)) for n, v, lo, hi in zip(b["n"], b["v"], b["lo"], b["hi"])]
                n, err, v, lo, hi = merge(parts, eps, exact)
                out = {k: [b[k].iloc[0]] for k in keys}
                return pd.DataFrame(out | {"n": [n], "err": [err], "v": [v], "lo": [lo], "hi": [hi]})

            return run

        parts = summaries.withColumn("parts_", F.floor(F.spark_partition_id() / self.fan_in))
        middle = parts.groupBy(*keys, "parts_").applyInPandas(level(self.eps * (share - 0.25)), schema)
        return middle.groupBy(*keys).applyInPandas(level(self.eps * share), schema)


def at_rank(rank: Column) -> Column:
    """The value whose rank interval lies closest to ``rank``; the smaller value on a tie."""
    tuples = F.arrays_zip("v", "lo", "hi")
    off = F.transform(tuples, lambda x: F.struct(F.greatest(rank - x["lo"], x["hi"] - rank).alias("off"), x["v"].alias("v")))
    return F.array_min(off)["v"]


def percentile(pct: int) -> Column:
    """Nearest rank: the value of rank ceil(pct * n / 100), at least 1."""
    rank = F.greatest(F.lit(1).cast("long"), F.call_function("div", F.col("n") * pct + 99, F.lit(100).cast("long")))
    return at_rank(rank)


def median() -> Column:
    """Mean of the two central values."""
    two = F.lit(2).cast("long")
    return (at_rank(F.call_function("div", F.col("n") + 1, two)) + at_rank(F.call_function("div", F.col("n"), two) + 1)) / 2
