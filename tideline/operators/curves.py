"""Equity curves and copied positions: returns, drawdowns, curves on common instants, average cost and episodes of orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div
from tideline.operators.ordered import UNCUT, Runs, as_of

DUST = 1e-12


def returns(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t, ret: change from the previous point of the curve; none where that one is not positive."""
    seen = Runs(curve, keys, "t", []).previous(["equity"])
    return seen.where("has_prev and prev_equity > 0").select(*keys, "t", (F.col("equity") / F.col("prev_equity") - 1).alias("ret"))


def sharpe(rets: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """keys, n, sharpe: null with fewer than two returns or without deviation."""
    agg = rets.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.max(F.abs("ret")).alias("top"))
    ok = (F.col("n") >= 2) & (F.col("s") > DUST * F.col("top"))
    return agg.select(*keys, "n", F.when(ok, F.col("m") / F.col("s") * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def drawdowns(curve: DataFrame, keys: Sequence[str], bucket_ms: int = 64 * DAY_MS) -> DataFrame:
    """keys, depth, peak_t, trough_t, recovery_t: the deepest fall from the running maximum; first of equals; nulls without one."""
    best = F.struct("equity", (-F.col("t")).alias("nt"))  # the first instant of the running maximum
    rows = Runs(curve, keys, "t", [], bucket_ms).annotate(highest={"top": best})
    rows = rows.withColumn("depth", (F.col("top.equity") - F.col("equity")) / F.col("top.equity"))
    low = rows.groupBy(*(F.col(k).alias(f"d_{k}") for k in keys)).agg(F.max(F.struct("depth", (-F.col("t")).alias("nt"), F.col("top.equity").alias("peak"), (-F.col("top.nt")).alias("peak_t"))).alias("x"))
    low = low.select(*(f"d_{k}" for k in keys), F.col("x.depth").alias("depth"), (-F.col("x.nt")).alias("trough_t"), F.col("x.peak").alias("peak"), F.col("x.peak_t").alias("peak_t"))
    on = (F.col("t") > F.col("trough_t")) & (F.col("equity") >= F.col("peak"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"d_{k}"))
    back = low.join(curve, on, "left").groupBy(*(f"d_{k}" for k in keys), "depth", "trough_t", "peak_t").agg(F.min("t").alias("recovery_t"))
    fell = F.col("depth") > 0
    return back.select(*(F.col(f"d_{k}").alias(k) for k in keys), F.greatest("depth", F.lit(0.0)).alias("depth"), *(F.when(fell, F.col(c)).alias(c) for c in ("peak_t", "trough_t", "recovery_t")))


def together(curves: DataFrame, group: Sequence[str], member: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """group, t, equity: sum over members of each one's last point at or before t, at every instant any of them has.

    A member's point adds its difference from the one before it, so the sum is a running sum of changes: one row per
    point, whatever the number of members. Of several points of a member at one instant the greatest counts.
    """
    points = curves.where("equity is not null").groupBy(*group, member, "t").agg(F.max("equity").alias("equity"))
    seen = Runs(points, [*group, member], "t", [], bucket_ms).previous(["equity"])
    changes = seen.groupBy(*group, "t").agg(F.sum(F.col("equity") - F.coalesce("prev_equity", F.lit(0))).alias("change_"))
    return Runs(changes, group, "t", [], bucket_ms).annotate(running={"equity": F.col("change_")}).select(*group, "t", "equity")


def order_runs(orders: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], signed: Column, bucket_ms: int = DAY_MS) -> DataFrame:
    """``orders`` in parts that never cross zero, with the position around each in hundredths, and ``episode``: 1, 2, ... per key.

    Positions are running sums of whole hundredths, so they return to zero exactly. An order that turns the position
    around is two parts: what closes, and what opens the next episode.
    """
    rows = orders.withColumn("units_", F.floor(signed * 100 + 0.5).cast("long")).where("units_ != 0")
    rows = Runs(rows, keys, time, order, bucket_ms).running(end_=F.col("units_"))
    before, after = F.col("end_") - F.col("units_"), F.col("end_")
    part = lambda k, units, start: F.struct(F.lit(k).alias("part"), units.alias("units"), start.alias("before_units"))
    turns = F.signum(before.cast("double")) * F.signum(after.cast("double")) < 0
    split = F.when(turns, F.array(part(0, -before, before), part(1, after, F.lit(0).cast("long")))).otherwise(F.array(part(0, F.col("units_"), before)))
    rows = rows.withColumn("p_", F.explode(split)).select(*orders.columns, "p_.*")
    return Runs(rows, keys, time, [*order, "part"], bucket_ms).running(episode=(F.col("before_units") == 0).cast("long"))


def cost_fold(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], price: str, change: str, dust: float, bucket_ms: int) -> DataFrame:
    """keys, size, cost, realized: average cost over the rows of ``keys`` in order, each changing the position by ``change``.

    What grows the position is averaged in, what shrinks it realizes against the average. The average after a step is
    linear in the average before it, so the rows of a time bucket fold into one row of coefficients, and these rows fold
    along the run: no list is longer than a bucket's rows or a run's buckets. ``dust``: a smaller size is zero.
    """
    at = F.lit(0).cast("long") if bucket_ms == UNCUT else floor_div(time, bucket_ms)
    units = F.col(change)
    sizes = rows.groupBy(*keys, at.alias("at_")).agg(F.sum(units).alias("moved_"))
    before = W.partitionBy(*keys).orderBy("at_").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("size_", F.coalesce(F.sum("moved_").over(before), F.lit(0.0))).drop("moved_")
    item = F.struct(time, *order, F.col(price).cast("double").alias("px"), units.alias("change"))
    per = rows.groupBy(*keys, at.alias("at_")).agg(F.array_sort(F.collect_list(item)).alias("rows_")).join(sizes, [*keys, "at_"])
    zero, one = F.lit(0.0), F.lit(1.0)
    # cost = cost0 + cost1 * the bucket's first cost, realized likewise
    start = F.struct(F.when(F.abs("size_") < dust, zero).otherwise(F.col("size_")).alias("size"), zero.alias("cost0"), one.alias("cost1"), zero.alias("gain0"), zero.alias("gain1"))

    def fold(s: Column, x: Column) -> Column:
        size = s["size"] + x["change"]
        grows = F.abs(size) > F.abs(s["size"])
        cost0 = F.when(grows, (s["size"] * s["cost0"] + x["change"] * x["px"]) / size).otherwise(s["cost0"])
        cost1 = F.when(grows, s["size"] * s["cost1"] / size).otherwise(s["cost1"])
        gain0 = s["gain0"] + F.when(grows, zero).otherwise(-x["change"] * (x["px"] - s["cost0"]))
        gain1 = s["gain1"] + F.when(grows, zero).otherwise(x["change"] * s["cost1"])
        return F.struct(F.when(F.abs(size) < dust, zero).otherwise(size).alias("size"), cost0.alias("cost0"), cost1.alias("cost1"), gain0.alias("gain0"), gain1.alias("gain1"))

    parts = per.select(*keys, "at_", F.aggregate("rows_", start, fold).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at_", "x.*"))).alias("parts_"))
    flat = F.struct(zero.alias("size"), zero.alias("cost"), zero.alias("realized"))
    along = lambda s, x: F.struct(x["size"].alias("size"), (x["cost0"] + x["cost1"] * s["cost"]).alias("cost"), (s["realized"] + x["gain0"] + x["gain1"] * s["cost"]).alias("realized"))
    return parts.select(*keys, F.aggregate("parts_", flat, along).alias("x")).select(*keys, "x.*")


def average_cost(runs: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], price: str = "price", bucket_ms: int = 64 * DAY_MS) -> DataFrame:
    """keys, episode, opened, n_parts, realized, cost, size, notional: average cost over each episode of ``order_runs``."""
    run = [*keys, "episode"]
    rows = runs.withColumn("change_", F.col("units") / 100.0)
    sums = rows.groupBy(*run).agg(F.min(time).alias("opened"), F.count(F.lit(1)).alias("n_parts"), F.sum(F.abs("change_") * F.col(price)).alias("notional"))
    return sums.join(cost_fold(rows, run, time, [*order, "part"], price, "change_", 0.005, bucket_ms), run).select(*run, "opened", "n_parts", "realized", "cost", "size", "notional")


def ladder_fill(levels: DataFrame, keys: Sequence[str], level: str, size: str, price: str, wanted: float) -> DataFrame:
    """keys, filled, avg_px, levels_used: an order of ``wanted`` walked down the levels of each book, in level order."""
    before = F.coalesce(F.sum(size).over(W.partitionBy(*keys).orderBy(level).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = levels.where(F.col(price).isNotNull() & (F.col(size) > 0)).withColumn("take", F.greatest(F.lit(0.0), F.least(F.col(size), F.lit(wanted) - before)))
    return rows.groupBy(*keys).agg(F.sum("take").alias("filled"), (F.sum(F.col("take") * F.col(price)) / F.sum("take")).alias("avg_px"), F.sum((F.col("take") > 0).cast("long")).alias("levels_used"))


def to_episodes(payments: DataFrame, episodes: DataFrame, keys: Sequence[str], time: str) -> tuple[DataFrame, DataFrame]:
    """``payments`` with the episode (opened < time <= closed, or still open) of their keys; and those that fall in none.

    Episodes of a key do not overlap, so the last one opened strictly before the payment is the only candidate.
    """
    found = as_of(payments, episodes.select(*keys, "opened", "closed", "episode"), keys, time, "opened", ["opened", "closed", "episode"], strict=True, prefix="e_")
    inside = F.col("e_opened").isNotNull() & (F.col("e_closed").isNull() | (F.col(time) <= F.col("e_closed")))
    hit = found.where(inside).withColumnRenamed("e_episode", "episode").drop("e_opened", "e_closed")
    return hit, found.where(~inside).select(*payments.columns)


def decomposition(results: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """keys, step, value, delta, inert: what each step of a ladder of scenarios adds to the one before; one row per step."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(step))
    delta = F.col(value) - F.coalesce(before, F.lit(0.0))
    return results.select(*keys, step, value, delta.alias("delta"), F.coalesce(F.abs(F.col(value) - before) <= DUST * F.greatest(F.lit(1.0), F.abs(value)), F.lit(False)).alias("inert"))
