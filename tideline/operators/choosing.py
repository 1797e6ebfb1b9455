"""Choosing among rows reproducibly: hash order and blocks, first few under a condition, stages of removal, greedy shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT_DIGITS = 3  # hash order is counted per slot of 16 ** 3 first


def hash_order(df: DataFrame, key: str, salt: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) of each row in the order of SHA-256("salt:key"), ties by key.

    Ranks come from exact counts per leading hex digits, so no task orders more than one slot's rows.
    """
    h = F.sha2(F.concat_ws(":", F.lit(salt), F.col(key)), 256)
    rows = df.withColumn("h_", h).withColumn("slot_", F.substring("h_", 1, SLOT_DIGITS))
    slots = rows.groupBy("slot_").agg(F.count(F.lit(1)).alias("n_"))
    slots = slots.withColumn("below_", F.sum("n_").over(W.orderBy("slot_").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")).drop("n_")  # 4096 rows
    inside = F.row_number().over(W.partitionBy("slot_").orderBy("h_", key))
    return rows.join(F.broadcast(slots), "slot_").withColumn("rank", (F.col("below_") + inside - 1).cast("long")).drop("h_", "slot_", "below_")


def block(ordered: DataFrame, size: int) -> DataFrame:
    return ordered.withColumn("block", F.call_function("div", F.col("rank"), F.lit(size).cast("long")))


def first_meeting(df: DataFrame, condition: Column, order: Sequence[Column], k: int) -> DataFrame:
    """``df`` with ``meets`` and ``place``: 1..k for the first k rows that meet the condition, null for all others.

    Only the k best are ever ordered as a whole. ``order`` must tell rows apart; rows equal in every column share a place.
    """
    marked = df.withColumn("meets", F.coalesce(condition, F.lit(False)))
    best = marked.where("meets").orderBy(*order).limit(k)
    placed = best.withColumn("place", F.row_number().over(W.orderBy(*order))).drop("meets")  # k rows
    placed = placed.groupBy(*(F.col(c).alias(f"b_{c}") for c in df.columns)).agg(F.min("place").alias("place"))
    on = F.col("meets")
    for c in df.columns:
        on &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return marked.join(placed, on, "left").select(*df.columns, "meets", "place")


def failed(stages: Sequence[tuple[str, Column]]) -> Column:
    """Names of the stages a row fails, in order; an undefined condition fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in stages)), lambda x: x.isNotNull())


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """stage_no, stage, entered, removed: rows entering each stage, and those that it removes first."""
    first = F.get(failed(stages), F.lit(0))
    counts = df.select(first.alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("removed"))
    spark = df.sparkSession
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(stages)], "stage_no int, stage string")
    out = names.join(counts, "stage", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    total = counts.agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("all_"))
    before = F.coalesce(F.sum("removed").over(W.orderBy("stage_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per stage
    return out.crossJoin(F.broadcast(total)).withColumn("entered", (F.col("all_") - before).cast("long")).select("stage_no", "stage", "entered", "removed")


def until_share(df: DataFrame, weight: str, order: Sequence[Column], share: float, most: int | None = None) -> DataFrame:
    """Rows in order while the weight before them is less than ``share`` of all, ``most`` of them at most. For small tables, one row per item."""
    upto = F.sum(weight).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("cumulative", upto).withColumn("total", F.sum(weight).over(W.partitionBy()))
    out = out.where(F.col("cumulative") - F.col(weight) < F.col("total") * share)
    return out if most is None else out.orderBy(*order).limit(most)
