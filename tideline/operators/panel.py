"""Prices at the instants that delayed followers need, found before anything is simulated.

When a follower can act depends on prices only, so the instants are known beforehand and looked up as sets: the first bar
at or after the delayed instant, the bar of that very second, and the last bar strictly before it. The strictness is what
keeps the future out. Delays multiply the events by a stated small number of scenarios.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.timeops import hour_floor, second_of
from tideline.operators.ordered import as_of


def scenarios(delays_ms: Sequence[int], slippages_bps: Sequence[float]) -> list[tuple[int, int, float]]:
    """scenario number, delay, slippage: every delay at the first slippage, then every other slippage at the first delay."""
    pairs = [(d, slippages_bps[0]) for d in delays_ms] + [(delays_ms[0], s) for s in slippages_bps[1:]]
    return [(i, d, s) for i, (d, s) in enumerate(dict.fromkeys(pairs))]


def delayed(events: DataFrame, time: str, delays_ms: Sequence[int]) -> DataFrame:
    """``events`` once per delay, with delay_ms and nominal_t."""
    return events.withColumn("delay_ms", F.explode(F.array(*(F.lit(d).cast("long") for d in delays_ms)))).withColumn("nominal_t", F.col(time) + F.col("delay_ms"))


def executions(rows: DataFrame, bars: DataFrame, side: str = "side") -> DataFrame:
    """``rows`` (coin, nominal_t, side) with exec_t, exec_px and mark.

    exec_t is nominal_t if its second has a bar, else the start of the first later second that has one; null if none.
    exec_px is that bar's worse end for the side; mark the last price strictly before the second of exec_t.
    """
    bars = bars.where("coin is not null and second is not null")
    rows = rows.withColumn("n_second", second_of("nominal_t"))
    found = as_of(rows, bars, ["coin"], "n_second", "second", ["second", "low", "high"], forward=True, bucket_ms=86_400, prefix="x_")
    found = found.withColumn("exec_t", F.when(F.col("x_second") == F.col("n_second"), F.col("nominal_t")).otherwise(F.col("x_second") * 1000))
    found = found.withColumn("exec_px", F.when(F.col(side) == "buy", F.col("x_high")).otherwise(F.col("x_low")))
    known = found.where("x_second is not null").drop("x_low", "x_high", "n_second")
    marked = as_of(known, bars, ["coin"], "x_second", "second", ["last"], strict=True, bucket_ms=86_400, prefix="m_").withColumnRenamed("m_last", "mark").drop("m_second", "x_second")
    none = found.where("x_second is null").drop("x_low", "x_high", "n_second", "x_second").withColumn("mark", F.lit(None).cast("double"))
    return marked.unionByName(none)


def quotes_around(rows: DataFrame, quotes: DataFrame, time: str, side: str = "side") -> DataFrame:
    """``rows`` with before_ms, after_ms and px: the worse, for the side, of the quotes just before and just after the instant.

    ``quotes``: coin, time_ms, bid, ask. A buy pays the greater ask, a sell gets the lesser bid; one quote alone decides.
    """
    both = as_of(rows, quotes, ["coin"], time, "time_ms", ["bid", "ask"], prefix="b_")
    both = as_of(both, quotes, ["coin"], time, "time_ms", ["bid", "ask"], forward=True, prefix="a_")
    px = F.when(F.col(side) == "buy", F.greatest("b_ask", "a_ask")).otherwise(F.least("b_bid", "a_bid"))
    return both.select(*rows.columns, F.col("b_time_ms").alias("before_ms"), F.col("a_time_ms").alias("after_ms"), px.alias("px"))


def rates_at(rows: DataFrame, rates: DataFrame, time: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (coin, time) with the rate of their hour; and the coin, hour_ms that have none, which must not be."""
    asked = rows.withColumn("hour_ms", hour_floor(time))
    known = rates.groupBy("coin", "hour_ms").agg(F.min("rate").alias("rate"))
    return asked.join(known, ["coin", "hour_ms"]), asked.select("coin", "hour_ms").distinct().join(known, ["coin", "hour_ms"], "left_anti")
