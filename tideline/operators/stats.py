"""Exact order statistics by integer ranks, and time-weighted ones over step functions.

Values are counted first (one row per distinct value, with map-side combine), so the ordered part works on histograms.
A histogram of many values is cut into pieces of the value range, by quantiles of all its values, and summed piece by
piece, so a key with a third of all values is no hot task.
Null values are left out; groups without values have no row; zero weights do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS
from tideline.operators.ordered import BUCKET, Runs, bucketed, split_ms
from tideline.session import written

PIECES, LEAST_VALUES = 256, 1 << 20


def ranked(hist: DataFrame, keys: Sequence[str], value: str, weight: str, pieces: int = PIECES, least: int = LEAST_VALUES) -> DataFrame:
    """``hist``, one row per key and value, with ``cum_``, the weight of all values up to each, and ``all_``, that of all.

    Up to ``least`` values a key is one window. More are cut at quantiles of the values, so that a piece holds about one
    in ``pieces`` of all rows, whatever their keys; each piece carries the sum of those below.
    """
    hist = written(hist, "histogram")
    if hist.count() <= least:
        upto = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
        return hist.withColumn("cum_", F.sum(weight).over(upto)).withColumn("all_", F.sum(weight).over(W.partitionBy(*keys)))
    from pyspark.ml.feature import Bucketizer  # its binary search runs in the JVM

    plain = hist.withColumn("d_", F.col(value).cast("double"))
    cuts = plain.agg(F.percentile_approx("d_", [i / pieces for i in range(1, pieces)], 100 * pieces)).first()[0]
    splits = [float("-inf"), *sorted({c for c in cuts if abs(c) < float("inf")}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="d_", outputCol="b_", handleInvalid="keep").transform(plain).withColumn(BUCKET, F.col("b_").cast("long")).drop("d_", "b_")
    return Runs(placed, keys, value, []).annotate(running={"cum_": F.col(weight)}, whole={"all_": F.col(weight)}).select(*hist.columns, "cum_", "all_")


def counted(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return df.select(*keys, value.alias("v_")).where("v_ is not null").groupBy(*keys, "v_").agg(F.count(F.lit(1)).alias("c_"))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: Column, percents: Sequence[int], prefix: str = "p", **cut: int) -> DataFrame:
    """keys, n and p<pct>: the smallest value with at least pct percent of the values at or below it."""
    hist = ranked(counted(df, keys, value), keys, "v_", "c_", **cut)
    at = lambda p: F.min(F.when(F.col("cum_") * 100 >= F.col("all_") * p, F.col("v_")))
    return hist.groupBy(*keys).agg(F.max("all_").alias("n"), *(at(p).alias(f"{prefix}{p}") for p in percents))


def _between(shares: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over a ranked histogram, and from them the percentiles between the two values around their places."""
    place = {n: (F.col("all_") - 1) * F.lit(float(q)) for n, q in shares.items()}
    at = lambda rank: F.min(F.when(F.col("cum_") > rank, F.col("v_")))
    found = [F.max("all_").alias("all_"), *(c for n, p in place.items() for c in (at(F.floor(p)).alias(f"low_{n}"), at(F.ceil(p)).alias(f"high_{n}")))]
    whole = lambda p: F.floor(p) == F.ceil(p)
    return found, [F.when(whole(p), F.col(f"low_{n}")).otherwise((F.ceil(p) - p) * F.col(f"low_{n}") + (p - F.floor(p)) * F.col(f"high_{n}")).alias(n) for n, p in place.items()]


def interpolated(df: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float], **cut: int) -> DataFrame:
    """keys, n and a column per share: the percentile between the two values around its place, in proportion."""
    found, out = _between(shares)
    return ranked(counted(df, keys, value.cast("double")), keys, "v_", "c_", **cut).groupBy(*keys).agg(*found).select(*keys, F.col("all_").alias("n"), *out)


def weighted_percentile(df: DataFrame, keys: Sequence[str], value: str, weight: str, pct: int, out: str, **cut: int) -> DataFrame:
    """keys, out, total weight: the smallest value v with 100 * weight(values <= v) >= pct * total weight. Integer weights."""
    hist = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("v_")).agg(F.sum(weight).alias("w_"))
    hist = ranked(hist, keys, "v_", "w_", **cut)
    return hist.where(F.col("cum_") * 100 >= F.col("all_") * pct).groupBy(*keys).agg(F.min("v_").alias(out), F.max("all_").alias("weight"))


def step_levels(changes: DataFrame, keys: Sequence[str], time: str, delta: str, start_ms: int, end_ms: int, bucket_ms: int | None = None) -> DataFrame:
    """keys, level, weight: how long the running sum of ``delta`` stood at each level above 0 within [start_ms, end_ms).

    Changes before the start count from the start on; those at or after the end never. Unless it is given, the width of
    the buckets follows from the changes of the busiest key.
    """
    at = changes.where(F.col(time) < end_ms).select(*keys, F.greatest(F.col(time), F.lit(start_ms)).alias("t_"), F.col(delta).alias("d_"))
    at = at.groupBy(*keys, "t_").agg(F.sum("d_").alias("d_"))
    if bucket_ms is None:
        at = written(at, "changes")
        bucket_ms = split_ms(at, keys, "t_")
    levels = Runs(bucketed(at, keys, "t_", bucket_ms), keys, "t_", []).annotate(following=["t_"], running={"level": F.col("d_")})
    weight = F.coalesce(F.col("next_t_"), F.lit(end_ms)) - F.col("t_")
    return levels.withColumn("w_", weight).where("level > 0 and w_ > 0").groupBy(*keys, "level").agg(F.sum("w_").cast("long").alias("weight"))


def level_changes(rows: DataFrame, keys: Sequence[str], item: str, time: str, order: Sequence[str], before: Column, after: Column, start_ms: int, bucket_ms: int = DAY_MS) -> DataFrame:
    """keys, t, delta: what each row adds to the sum of ``after`` over items; an item's first row shows where it stood at the start."""
    rows = rows.withColumn("to_", after).withColumn("from_", before)
    seen = Runs(rows, [*keys, item], time, order, bucket_ms).previous(["to_"], "was_")
    first = seen.where("not has_was").select(*keys, F.lit(start_ms).cast("long").alias("t"), F.col("from_").alias("delta"))
    moves = seen.select(*keys, F.col(time).alias("t"), (F.col("to_") - F.coalesce(F.col("was_to_"), F.col("from_"))).alias("delta"))
    return first.unionByName(moves)


def ratio_summary(df: DataFrame, value: Column, threshold: float, **cut: int) -> DataFrame:
    """One row: n, median, p95, p99 (interpolated), max, share above the threshold; n 0 and nulls without values."""
    found, out = _between({"median": 0.5, "p95": 0.95, "p99": 0.99})
    above = F.sum(F.when(F.col("v_") > threshold, F.col("c_")).otherwise(0))
    rows = ranked(counted(df, [], value.cast("double")), [], "v_", "c_", **cut).agg(*found, F.max("v_").alias("max"), (above / F.sum("c_")).alias("share_above"))
    return rows.select(F.coalesce("all_", F.lit(0)).cast("long").alias("n"), *out, "max", "share_above")
