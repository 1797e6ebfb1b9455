"""Pairs each record with the record of the same entity nearest in time, within a tolerance.

Time is cut into ticks. The right records of a tick are expanded to every tick within the tolerance: for a later tick
only the latest of them can be nearest, for an earlier one only the earliest, and so each entity-tick keeps one nearest
instant on either side, besides the sorted distinct instants inside it, at most one per millisecond of the tick. Left
records then meet their tick by equality and look up the instants inside by bisection. A hot entity is spread over its
ticks, and no row of either side meets more than one row of the other.

The width of a tick is a parameter. With ticks of a millisecond nothing is inside but the tick's own instant and each
record is expanded to 2 * tolerance + 1 ticks; with ticks as wide as the tolerance, to three.

Left rows without entity or instant, or without partner in reach, have no result; right rows without either are
ignored; repeated rows of the right side count once, those of the left side each. On a tie the earlier instant wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.search import count_upto
from tideline.functions.timeops import floor_div


def ticks(right: DataFrame, entity: str, time: str, tolerance_ms: int, tick_ms: int) -> DataFrame:
    """entity_, tick_, before_, after_, inside_: per entity and tick, what may be nearest to an instant of the tick."""
    rows = right.select(F.col(entity).alias("entity_"), F.col(time).cast("long").alias("t")).where("entity_ is not null and t is not null")
    own = rows.groupBy("entity_", floor_div("t", tick_ms).alias("tick")).agg(F.array_sort(F.collect_set("t")).alias("ts"))
    first, last = F.element_at("ts", 1), F.element_at("ts", -1)
    low, high = floor_div(first - tolerance_ms, tick_ms), floor_div(last + tolerance_ms, tick_ms)
    tick, none = F.col("tick"), F.lit(None)
    serve = lambda j: F.struct(j.alias("tick_"), F.when(j > tick, last).otherwise(none).alias("before"), F.when(j < tick, first).otherwise(none).alias("after"), F.when(j == tick, F.col("ts")).otherwise(none).alias("inside"))
    reached = own.select("entity_", F.explode(F.transform(F.sequence(low, high), serve)).alias("x")).select("entity_", "x.*")
    return reached.groupBy("entity_", "tick_").agg(F.max("before").alias("before_"), F.min("after").alias("after_"), F.first("inside", ignorenulls=True).alias("inside_"))


def nearest(left: DataFrame, right: DataFrame, left_entity: str, left_time: str, right_entity: str, right_time: str, tolerance_ms: int, out: str = "nearest_ms", tick_ms: int | None = None) -> DataFrame:
    """``left`` with the instant of the nearest right record as ``out``; rows without one are left out.

    ``tick_ms``: the width of a tick, by default that of the tolerance.
    """
    width = max(1, tick_ms or tolerance_ms)
    served = ticks(right, right_entity, right_time, tolerance_ms, width)
    t = F.col("t_")
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("l_"), F.col(f"`{left_entity}`").alias("e_"), F.col(f"`{left_time}`").cast("long").alias("t_")).where("e_ is not null and t_ is not null")
    joined = rows.withColumn("tick_of_left_", floor_div(t, width)).join(served, (F.col("e_") == F.col("entity_")) & (F.col("tick_of_left_") == F.col("tick_")))
    joined = joined.withColumn("place_", count_upto(F.col("inside_"), t))
    # the last instant at or before t, inside the tick or before it; the first at or after t likewise
    back_at = F.coalesce(F.when(F.col("place_") > 0, F.get("inside_", F.col("place_") - 1)), F.col("before_"))
    ahead_at = F.when(back_at == t, t).otherwise(F.coalesce(F.get("inside_", F.col("place_")), F.col("after_")))
    back, ahead = t - F.col("b_"), F.col("a_") - t
    best = F.when((back <= ahead) | ahead.isNull(), F.col("b_")).otherwise(F.col("a_"))
    near = joined.withColumn("b_", back_at).withColumn("a_", ahead_at).withColumn("best_", best).where(F.abs(F.col("best_") - t) <= tolerance_ms)
    return near.select(*(F.col(f"l_.`{c}`").alias(c) for c in left.columns), F.col("best_").alias(out))
