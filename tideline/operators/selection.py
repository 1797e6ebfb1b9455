"""From fills to a universe of coins and to the accounts that pass every filter, all coins and all accounts in one plan.

Limits are parameters, not rules of ours; ties and undefined measures have one outcome each: an undefined measure fails
the filter that asks for it, and equal notionals are ordered by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS, floor_div, second_of, utc_day
from tideline.operators.account import LOT_KIND
from tideline.operators.stats import interpolated, nearest_ranks
from tideline.session import written

# -- prices against a proxy ----------------------------------------------------------------------------------------------


def compared(fills: DataFrame, proxy: DataFrame) -> DataFrame:
    """coin, day, bps per fill with coin and time: its distance from the proxy's price of its second; null where there is none.

    A second that is listed several times counts with its least price; prices that are null or not positive are none.
    """
    known = proxy.where("last > 0").groupBy("coin", "second").agg(F.min("last").alias("last_"))
    rows = fills.where("coin is not null and time_ms is not null").select("coin", utc_day("time_ms").alias("day"), second_of("time_ms").alias("second"), "px")
    return rows.join(known, ["coin", "second"], "left").select("coin", "day", ((F.col("px") / F.col("last_") - 1) * 1e4).alias("bps"))


def day_levels(rows: DataFrame) -> DataFrame:
    """coin, day, n, median_bps: the median distance of each day that has any."""
    return interpolated(rows, ["coin", "day"], F.col("bps"), {"median_bps": 0.5})


def proxy_check(fills: DataFrame, proxy: DataFrame, pct: int = 95, max_deviation_bps: float = 10.0, max_level_bps: float = 20.0) -> DataFrame:
    """coin, compared, skipped, deviation_bps, level_bps, shift_bps, valid: how well a proxy stands for each coin's prices.

    The deviation is the percentile of the distance from the day's median, the level the greatest such median in size,
    the shift their range. Both limits are inclusive; a coin without any compared fill is not valid.
    """
    rows = written(compared(fills, proxy), "proxy-differences")
    levels = written(day_levels(rows).select("coin", "day", "median_bps"), "day-levels")
    off = rows.where("bps is not null").join(levels, ["coin", "day"])
    spread = nearest_ranks(off, ["coin"], F.abs(F.col("bps") - F.col("median_bps")), [pct], "q").withColumnRenamed(f"q{pct}", "deviation_bps").drop("n")
    m = F.col("median_bps")
    by_day = levels.groupBy("coin").agg(F.max(F.abs(m)).alias("level_bps"), (F.max(m) - F.min(m)).alias("shift_bps"))
    counts = rows.groupBy("coin").agg(F.count("bps").alias("compared"), F.count(F.when(F.col("bps").isNull(), 1)).alias("skipped"))
    valid = F.coalesce((F.col("deviation_bps") <= max_deviation_bps) & (F.col("level_bps") <= max_level_bps), F.lit(False))
    return counts.join(spread, "coin", "left").join(by_day, "coin", "left").withColumn("valid", valid)


# -- the universe --------------------------------------------------------------------------------------------------------


def notional() -> Column:
    """A fill's size times price, in whole cents, so that sums are exact; none without either."""
    return F.floor(F.coalesce(F.abs("sz") * F.col("px"), F.lit(0.0)) * 100 + 0.5).cast("long")


def candidates(fills: DataFrame, wallets: DataFrame, days: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """coin, cents, n_fills, meets_i: perpetuals in the fills of ``wallets`` (address), and whether ``days`` (coin, day, found) has every day found."""
    mine = fills.join(wallets.select("address").distinct(), "address", "left_semi").where(F.col("kind") == LOT_KIND)
    per = mine.where("coin is not null").groupBy("coin").agg(F.sum(notional()).alias("cents"), F.count(F.lit(1)).alias("n_fills"))
    whole = days.where("found").where(F.col("day").between(first_day, last_day)).select("coin", "day").distinct().groupBy("coin").agg(F.count(F.lit(1)).alias("d_"))
    return per.join(whole, "coin", "left").select("coin", "cents", "n_fills", F.coalesce(F.col("d_") == last_day - first_day + 1, F.lit(False)).alias("meets_i"))


def form_universe(assets: DataFrame, checks: DataFrame, costs: DataFrame, max_assets: int, min_fills: int) -> DataFrame:
    """``assets`` with place and excluded_by: the first of conditions i to v that a coin fails, null if it is in.

    i: a price file on every day; ii: among the ``max_assets`` of most notional that meet i; iii: enough fills; iv: a
    valid proxy check; v: a measured cost (``costs``: coin). One row per instrument, so ranks are of a small table.
    """
    ranked = assets.withColumn("place", F.when(F.col("meets_i"), F.row_number().over(W.partitionBy("meets_i").orderBy(F.desc("cents"), "coin"))))
    rows = ranked.join(checks.select("coin", "valid"), "coin", "left").join(costs.select("coin").distinct().withColumn("cost_", F.lit(True)), "coin", "left")
    failed = (
        F.when(~F.col("meets_i"), "i").when(F.col("place") > max_assets, "ii").when(F.col("n_fills") < min_fills, "iii")
        .when(~F.coalesce("valid", F.lit(False)), "iv").when(F.col("cost_").isNull(), "v")
    )
    return rows.select(*assets.columns, "place", failed.alias("excluded_by"))


def universe_cover(decisions: DataFrame, fills: DataFrame, wallets: DataFrame) -> DataFrame:
    """One row: cents inside the universe, of all fills and of perpetuals, and the universe's share of both; null of nothing."""
    mine = fills.join(wallets.select("address").distinct(), "address", "left_semi")
    all_ = mine.agg(F.coalesce(F.sum(notional()), F.lit(0)).alias("all_cents"), F.coalesce(F.sum(F.when(F.col("kind") == LOT_KIND, notional())), F.lit(0)).alias("perp_cents")).withColumn("k_", F.lit(0))
    inside = decisions.agg(F.coalesce(F.sum(F.when(F.col("excluded_by").isNull(), F.col("cents"))), F.lit(0)).alias("cents")).withColumn("k_", F.lit(0))
    share = lambda c: F.when(F.col(c) > 0, F.col("cents") / F.col(c))
    return inside.join(all_, "k_").select("cents", "all_cents", "perp_cents", share("all_cents").alias("of_all"), share("perp_cents").alias("of_perps"))


def market_walk(assets: DataFrame, max_assets: int, always: Sequence[str] = ()) -> DataFrame:
    """``assets`` that are visited in order of notional until ``max_assets`` of them meet condition i, and those of ``always``."""
    upto = W.orderBy(F.desc("cents"), "coin").rowsBetween(W.unboundedPreceding, -1)  # a row per instrument
    met = F.coalesce(F.sum(F.col("meets_i").cast("int")).over(upto), F.lit(0))
    return assets.withColumn("met_before", met.cast("long")).where((F.col("met_before") < max_assets) | F.col("coin").isin(list(always)))


# -- accounts ------------------------------------------------------------------------------------------------------------

#: The names of the filters in the order of their run; F1 last.
ORDER = ("F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F10", "F1")


@dataclass(frozen=True)
class Limits:
    """What the filters ask for."""

    role: str = "user"
    account_value: float = 10_000.0
    max_fills: int = 10_000
    tolerance_bps: float = 10.0
    closed_episodes: int = 20
    active_blocks: int = 6
    shortest_ms: float = 0.5 * HOUR_MS
    longest_ms: float = 14.0 * DAY_MS
    taker_pct: float = 50.0
    open_coins: int = 3
    universe_pct: float = 80.0
    liquidated_fills: int = 0


def filters(limits: Limits, order: Sequence[str] = ORDER) -> list[tuple[str, Column]]:
    """name and condition over a row of facts, in order; each filter once, or it is an error."""
    if sorted(order) != sorted(ORDER):
        raise ValueError(f"the order must have F1 to F10 once each: {list(order)}")
    c = F.col
    at_least = lambda share, pct: c(share) * 100 >= pct
    kept = c("coverage_ok") & (c("n_fills") <= limits.max_fills) & (c("invalid_perp_fills") == 0) & (c("n_breaks") == 0) & (c("unreconciled_episodes") == 0)
    of = {
        "F1": c("role") == limits.role,
        "F2": c("account_value") >= limits.account_value,
        "F3": kept & (F.coalesce("max_divergence_bps", F.lit(0.0)) <= limits.tolerance_bps),
        "F4": c("closed_episodes") >= limits.closed_episodes,
        "F5": c("active_blocks") >= limits.active_blocks,
        "F6": c("median_duration_ms").between(limits.shortest_ms, limits.longest_ms),
        "F7": at_least("taker_share", limits.taker_pct),
        "F8": c("median_open") <= limits.open_coins,
        "F9": at_least("universe_share", limits.universe_pct),
        "F10": c("liquidated_fills") <= limits.liquidated_fills,
    }
    return [(name, of[name]) for name in order]


def reference_stage() -> tuple[str, Column]:
    """The stage after all filters: accounts without any exposure inside the universe go."""
    return "N*", F.col("exposure") > 0


def pool_growth(eligible: int, blocks_used: int, pool_size: int, block_size: int, least: int) -> tuple[str, int | None]:
    """What to do with a pool by its number of eligible accounts: enough, grow (and which block comes next), or exhausted."""
    if eligible >= least:
        return "enough", None
    return ("grow", blocks_used) if blocks_used * block_size < pool_size else ("exhausted", None)


def proxied_days(proxy: DataFrame) -> DataFrame:
    """coin, day, found: days of which the proxy has a price."""
    return proxy.where("last > 0").select("coin", floor_div("second", 86_400).alias("day")).distinct().withColumn("found", F.lit(True))
