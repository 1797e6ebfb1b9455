"""Overlapping and gapped intervals: merged periods, their complements and their length per time bucket.

The aggregate is a sorted list of disjoint pieces per (key, bucket). Lists of any two subsets merge into the
list of their union, so partial lists are made where rows are read, merged again under a salt, and once more
per (key, bucket): no task ever holds the raw intervals of a key, however hot. Periods across bucket borders
are stitched from the pieces that touch a border, of which a bucket has two at most.

Rows with null key, null bounds or ``end <= start`` hold no time and are left out; an empty table gives empty
results; repeated rows change nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div
from tideline.session import written

PIECE = "key string, bucket long, s long, e long, min_s long, max_s long, min_e long, max_e long"
FLUSH_ROWS = 1 << 18


def merge_pieces(p: pd.DataFrame, width: int) -> pd.DataFrame:
    """One linear merge of pieces sorted by (key, bucket, s) into disjoint ones. min/max tell whether one interval made them."""
    if p.empty:
        return p
    key, bucket = p["key"].to_numpy(), p["bucket"].to_numpy()
    s, e = p["s"].to_numpy(), p["e"].to_numpy()
    change = np.ones(len(p), bool)
    change[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    # ends measured from the group's own offset, so one running maximum serves all groups
    base = np.cumsum(change) * (2 * width)
    reach = np.maximum.accumulate(base + (e - bucket * width))
    fresh = change.copy()
    fresh[1:] |= base[1:] + (s[1:] - bucket[1:] * width) > reach[:-1]
    at = np.flatnonzero(fresh)
    low, high = np.minimum.reduceat, np.maximum.reduceat
    return pd.DataFrame(
        {
            "key": key[at], "bucket": bucket[at], "s": s[at], "e": high(e, at),
            "min_s": low(p["min_s"].to_numpy(), at), "max_s": high(p["max_s"].to_numpy(), at),
            "min_e": low(p["min_e"].to_numpy(), at), "max_e": high(p["max_e"].to_numpy(), at),
        }
    )


def _partial(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= FLUSH_ROWS:
                merged = merge_pieces(pd.concat(held).sort_values(["key", "bucket", "s"]), width)
                if 2 * len(merged) > rows:  # nothing much to gain by holding them
                    yield merged
                    held, rows = [], 0
                else:
                    held, rows = [merged], len(merged)
        if held:
            yield merge_pieces(pd.concat(held).sort_values(["key", "bucket", "s"]), width)

    return run


def _final(width: int):
    """Input sorted by (key, bucket, s), a bucket never split over tasks: emits whole pieces, each with its successor's start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None

        def out(m: pd.DataFrame) -> pd.DataFrame:
            nxt = m["s"].astype("Int64").shift(-1)
            same = (m["key"] == m["key"].shift(-1)) & (m["bucket"] == m["bucket"].shift(-1))
            return m.assign(next_s=nxt.where(same))

        for b in batches:
            m = merge_pieces(b if last is None else pd.concat([last, b]), width)
            if len(m):
                last = m.iloc[-1:]
                yield out(m).iloc[:-1]
        if last is not None:
            yield out(last)

    return run


class Intervals:
    """Half-open intervals [start, end) per key, cut at multiples of ``bucket_ms``."""

    def __init__(self, df: DataFrame, key: str, start: str, end: str, bucket_ms: int = DAY_MS, salts: int = 16):
        self.bucket_ms = bucket_ms
        rows = df.select(
            F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{start}`").cast("long").alias("a"), F.col(f"`{end}`").cast("long").alias("b")
        ).where("key is not null and b > a")
        bucket = F.explode(F.sequence(floor_div("a", bucket_ms), floor_div(F.col("b") - 1, bucket_ms)))
        low = F.col("bucket") * bucket_ms
        pieces = rows.select("key", "a", "b", bucket.alias("bucket")).select(
            "key", "bucket", F.greatest("a", low).alias("s"), F.least("b", low + bucket_ms).alias("e"),
            F.col("a").alias("min_s"), F.col("a").alias("max_s"), F.col("b").alias("min_e"), F.col("b").alias("max_e"),
        )
        partial = pieces.mapInPandas(_partial(bucket_ms), PIECE)
        salt = F.pmod(F.xxhash64("s", "e"), F.lit(salts))
        middle = partial.repartition("key", "bucket", salt).mapInPandas(_partial(bucket_ms), PIECE)
        ordered = middle.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "s")
        self.pieces = written(ordered.mapInPandas(_final(bucket_ms), PIECE + ", next_s long"), "intervals")

    def periods(self) -> DataFrame:
        """key, start_ms, end_ms, several: maximal unions of overlapping or touching intervals; several: of two or more different ones."""
        w = self.bucket_ms
        at_border = (F.col("s") == F.col("bucket") * w) | (F.col("e") == (F.col("bucket") + 1) * w)
        several = ((F.col("min_s") != F.col("max_s")) | (F.col("min_e") != F.col("max_e"))).alias("several")
        inner = self.pieces.where(~at_border).select("key", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), several)
        by_key = W.partitionBy("key").orderBy("s")
        chained = (
            self.pieces.where(at_border)
            .withColumn("fresh", F.coalesce((F.lag("e").over(by_key) != F.col("s")).cast("int"), F.lit(1)))
            .withColumn("chain", F.sum("fresh").over(by_key.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy("key", "chain")
            .agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), *(F.min(c).alias(c) for c in ("min_s", "min_e")), *(F.max(c).alias(c) for c in ("max_s", "max_e")))
            .select("key", "start_ms", "end_ms", several)
        )
        return inner.unionByName(chained)

    def gaps(self) -> DataFrame:
        """key, start_ms, end_ms: the stretches between consecutive periods of a key."""
        inside = self.pieces.where("next_s is not null").select("key", F.col("e").alias("start_ms"), F.col("next_s").alias("end_ms"))
        by_key = W.partitionBy("key").orderBy("bucket")  # one row per bucket
        across = (
            self.pieces.groupBy("key", "bucket")
            .agg(F.min("s").alias("first_s"), F.max("e").alias("start_ms"))
            .withColumn("end_ms", F.lead("first_s").over(by_key))
            .where("end_ms > start_ms")
            .select("key", "start_ms", "end_ms")
        )
        return inside.unionByName(across)

    def totals(self) -> DataFrame:
        """key, bucket, total_ms: time inside any interval, per bucket that has some."""
        return self.pieces.groupBy("key", "bucket").agg(F.sum(F.col("e") - F.col("s")).alias("total_ms"))


def common(a: Intervals, b: Intervals) -> DataFrame:
    """key, start_ms, end_ms: time that both hold. Pieces meet inside their bucket; touching ones are joined again."""
    if a.bucket_ms != b.bucket_ms:
        raise ValueError("both need the same buckets")
    left, right = a.pieces.select("key", "bucket", "s", "e"), b.pieces.select("key", "bucket", F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = left.join(right, ["key", "bucket"]).where("s < e2 and s2 < e").select("key", F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e"))
    return Intervals(met, "key", "s", "e", a.bucket_ms).periods().select("key", "start_ms", "end_ms")
