"""Positions of accounts from their fills: steps, continuity breaks, events per instant, episodes from zero to zero.

A fill declares the position before it, so every state is a function of one row and the previous one: no recursion.
All accounts and coins are worked on in one plan. Long runs are split by time, at a width that follows from the rows of
the busiest run (see ``ordered.split_ms``).

Fills of other kinds, without price, size, side, start, time or coin are left out and counted by ``ignored``; rows
repeated as a whole count once. Comparisons allow what lot sizes and floating point ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div
from tideline.operators.curves import cost_fold
from tideline.operators.ordered import LEAST_ROWS, SHARE, Runs, bucketed, split_ms
from tideline.operators.stats import interpolated, step_levels, weighted_percentile
from tideline.session import written

#: Relative slack of positions, and the kinds that have positions.
SLACK = 1e-9
LOT_KIND, OTHER_KIND = "perp", "hip3"
KEYS = ["address", "coin"]


def unusable() -> Column:
    """Whether a fill lacks what a position needs. Never null."""
    missing = ~F.coalesce(F.col("side").isin("A", "B"), F.lit(False))
    for c in ("px", "sz", "start_position"):
        missing |= F.col(c).isNull()
    return missing


def ignored(fills: DataFrame) -> DataFrame:
    """address, n_ignored: fills of kinds with positions that cannot be used."""
    return fills.where(F.col("kind").isin(LOT_KIND, OTHER_KIND)).distinct().groupBy("address").agg(F.sum(unusable().cast("long")).alias("n_ignored"))


def usable(fills: DataFrame, bucket_ms: int | None = None) -> DataFrame:
    """Fills with a signed size (side B adds, A takes away), each once, placed by account, coin and time."""
    named = fills.select("address", "seq", "time_ms", "coin", "kind", "px", "sz", "side", "start_position", "crossed", "closed_pnl", "twap_id")
    whole = named.where(F.col("kind").isin(LOT_KIND, OTHER_KIND) & F.col("side").isin("A", "B")).dropna(subset=["address", "time_ms", "coin", "px", "sz", "start_position"])
    once = bucketed(whole, KEYS, "time_ms", split_ms(fills, KEYS, "time_ms") if bucket_ms is None else bucket_ms).distinct()
    return once.withColumn("signed", F.when(F.col("side") == "B", F.col("sz")).otherwise(-F.col("sz")))


def _sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def steps(fills: DataFrame, lots: DataFrame | None = None, default_lot: float = 0.01, bucket_ms: int | None = None) -> DataFrame:
    """usable fills with lot, before, after (zero by rule), expected (null for a coin's first), broke, touched_zero.

    And what the next row will find: whether the fill opens or crosses, whether and on which side it leaves a position
    open. All of it follows from the row and the one before it.
    """
    rows = usable(fills, bucket_ms)
    if lots is None:
        rows = rows.withColumn("lot", F.when(F.col("kind") == LOT_KIND, F.lit(default_lot)))
    else:
        known = lots.groupBy("coin").agg(F.max("lot").alias("lot_"))
        rows = rows.join(known, "coin", "left").withColumn("lot", F.when(F.col("kind") == LOT_KIND, F.coalesce("lot_", F.lit(default_lot)))).drop("lot_")
    near = F.when(F.col("lot").isNotNull(), F.col("lot") / 2).otherwise(SLACK * F.col("sz"))
    zeroed = lambda c: F.when(F.abs(c) < near, F.lit(0.0)).otherwise(c)
    rows = rows.withColumn("before", zeroed(F.col("start_position"))).withColumn("after", zeroed(F.col("start_position") + F.col("signed")))
    b, a, d = F.col("before"), F.col("after"), _sign(F.col("signed"))
    rows = rows.withColumn("opens", (b == 0) | (_sign(b) == d))
    rows = rows.withColumn("crosses", ~F.col("opens") & (a != 0) & (_sign(a) != _sign(b)))
    rows = rows.withColumn("open_after", F.col("opens") | (a != 0)).withColumn("side_after", F.when(F.col("opens"), d).when(F.col("crosses"), _sign(a)).otherwise(_sign(b)))
    out = Runs(rows, KEYS, "time_ms", ["seq"], null_keys=False).previous(["after", "time_ms", "px", "open_after", "side_after"])
    expected = F.col("prev_after")
    limit = F.when(F.col("lot").isNotNull(), F.col("lot") * (1 + SLACK)).otherwise(SLACK * F.greatest(F.abs(expected), F.col("sz")))
    broke = F.coalesce(F.abs(F.col("start_position") - expected) > limit, F.lit(False))
    touched = (F.col("before") == 0) | (F.col("after") == 0) | (F.col("before") * F.col("after") < 0)
    return out.withColumn("broke", broke).withColumn("touched_zero", touched).withColumnsRenamed({"prev_after": "expected", "prev_time_ms": "prev_t"})


def breaks(steps_: DataFrame) -> DataFrame:
    """address, coin, kind, t, prev_t, expected, declared: fills that do not start where the previous one ended."""
    return steps_.where("broke").select(*KEYS, "kind", F.col("time_ms").alias("t"), "prev_t", "expected", F.col("start_position").alias("declared"))


def events(steps_: DataFrame) -> DataFrame:
    """One row per account, coin and millisecond: positions before the first and after the last fill, last price, sums."""
    n = F.count(F.lit(1))
    return steps_.groupBy(*KEYS, "kind", F.col("time_ms").alias("t")).agg(
        F.min_by("before", "seq").alias("prev_position"),
        F.max_by("after", "seq").alias("position"),
        F.bool_or("touched_zero").alias("touched_zero"),
        F.max_by("px", "seq").alias("px"),
        F.sum(F.col("sz") * F.col("px")).alias("notional"),
        F.bool_or("broke").alias("unobserved"),
        n.alias("n_fills"),
    )


def parts(steps_: DataFrame) -> DataFrame:
    """Each fill as the part that closes or opens, and a second part where it crosses zero; each with its episode's number.

    Whether an episode is open after a row, and on which side, follows from that row alone. A row that finds the
    position at zero or on the other side ends the open episode where that is seen, as broken.
    """
    b, a, d = F.col("before"), F.col("after"), _sign(F.col("signed"))
    has = F.coalesce(F.col("prev_open_after"), F.lit(False))
    forced = has & ((b == 0) | (_sign(b) != F.col("prev_side_after")))
    rows = steps_.withColumn("forced", forced).withColumn("live", has & ~forced)
    starts = ~F.col("live")
    first_size = F.when(F.col("opens"), F.col("sz")).when((a == 0) | F.col("crosses"), F.abs(b)).otherwise(F.col("sz"))
    one = F.struct(
        F.lit(0).alias("part"), starts.alias("starts"), F.col("opens").alias("opening"), first_size.alias("size"), (starts & (b == 0)).alias("from_flat"),
        F.when(F.col("opens"), F.when(b == 0, d).otherwise(_sign(b))).otherwise(_sign(b)).alias("run_side"), (F.col("broke") & (F.col("live") | (b != 0))).alias("broken_part"), (~F.col("opens") & ((a == 0) | F.col("crosses"))).alias("ends"),
    )
    two = F.struct(F.lit(1).alias("part"), F.lit(True).alias("starts"), F.lit(True).alias("opening"), F.abs(a).alias("size"), F.lit(True).alias("from_flat"), _sign(a).alias("run_side"), F.lit(False).alias("broken_part"), F.lit(False).alias("ends"))
    split = F.explode(F.when(F.col("crosses"), F.array(one, two)).otherwise(F.array(one)))
    rows = rows.withColumn("p", split).select(*steps_.columns, "forced", "p.*")
    return Runs(rows, KEYS, "time_ms", ["seq", "part"], null_keys=False).running(episode=F.col("starts").cast("long"))


def episodes(parts_: DataFrame, bucket_ms: int = 64 * DAY_MS) -> DataFrame:
    """One row per episode: opened, closed (null while open), side, how it began and ended, notionals, fills, and its result.

    ``divergence_bps`` is the distance of the rebuilt from the reported result per traded notional, for whole episodes:
    from flat, closed, not broken, every fill with a reported result. With average cost, an episode whose sizes cancel
    has realized its cash flow, whatever the order of its fills. Where a residue below a lot is left, it counts at the
    average cost reached; only the fills of such episodes are folded in order, bucket by bucket.
    """
    notional = F.col("size") * F.col("px")
    at = F.struct("time_ms", "seq", "part")
    side = F.col("run_side").cast("double")
    rows = parts_.withColumn("from_", side * F.col("start_position")).withColumn("to_", side * (F.col("start_position") + F.col("signed")))
    rows = rows.withColumn("change", F.greatest("to_", F.lit(0.0)) - F.greatest("from_", F.lit(0.0)))
    # the result of a fill that turns the position belongs to the episode it closes
    inherited = F.col("starts") & (F.col("from_") < 0) & (-F.col("from_") > SLACK * F.col("sz"))
    out = rows.groupBy(*KEYS, "kind", "episode").agg(
        F.min("time_ms").alias("opened"),
        F.max(F.when(F.col("ends"), F.col("time_ms"))).alias("ended"),
        F.min_by("run_side", at).alias("side"),
        F.min_by("from_flat", at).alias("opened_from_flat"),
        F.bool_or("broken_part").alias("broken_fill"),
        F.sum(notional).alias("traded_notional"),
        F.coalesce(F.sum(F.when(F.col("opening"), notional)), F.lit(0.0)).alias("opening_notional"),
        F.coalesce(F.sum(F.when(F.col("opening") & F.col("crossed"), notional)), F.lit(0.0)).alias("opening_taker_notional"),
        F.count(F.lit(1)).alias("n_fills"),
        F.min_by("seq", at).alias("first_seq"),
        F.max_by("seq", at).alias("last_seq"),
        F.min_by("forced", at).alias("forced_start"),
        F.sum(-F.col("change") * F.col("px")).alias("cash"),
        F.sum("change").alias("residue"),
        F.sum(F.when(inherited, 0.0).otherwise(F.col("closed_pnl"))).alias("reported"),
        F.bool_or(F.col("closed_pnl").isNull()).alias("unknown"),
    )
    out = written(out, "episodes")
    # an episode cut short ends where the next one's first row shows it
    out = Runs(out, KEYS, "opened", ["episode"], bucket_ms, null_keys=False).following(["opened", "forced_start"])
    cut = F.col("ended").isNull() & F.coalesce(F.col("next_forced_start"), F.lit(False))
    out = out.withColumn("closed", F.coalesce("ended", F.when(cut, F.col("next_opened")))).withColumn("broken", F.col("broken_fill") | cut)
    whole = F.expr("opened_from_flat and closed is not null and not broken and not unknown and traded_notional > 0")
    rest = out.where(whole & (F.abs("residue") > 1e-9)).select(*KEYS, "episode")
    left = cost_fold(rows.join(rest, [*KEYS, "episode"], "left_semi"), [*KEYS, "episode"], "time_ms", ["seq", "part"], "px", "change", 0.0, bucket_ms)
    left = left.select(*KEYS, "episode", (F.col("size") * F.col("cost")).alias("cost_left"))
    out = out.join(left, [*KEYS, "episode"], "left")
    realized = F.col("side") * (F.col("cash") + F.coalesce("cost_left", F.lit(0.0)))
    gap = F.when(whole, F.abs(realized - F.col("reported")) / F.col("traded_notional") * 1e4)
    return out.select(
        *KEYS, "kind", "episode", "opened", "closed", "side", "opened_from_flat", "broken",
        "traded_notional", "opening_notional", "opening_taker_notional", "n_fills", "first_seq", "last_seq", gap.alias("divergence_bps"),
    )


def pnl_divergence(episodes_: DataFrame) -> DataFrame:
    """address, coin, episode, divergence_bps of the episodes that can be checked."""
    return episodes_.where("divergence_bps is not null").select(*KEYS, "episode", "divergence_bps")


def facts(fills: DataFrame, start_ms: int, end_ms: int, default_lot: float = 0.01, tolerance_bps: float = 10.0, universe: DataFrame | None = None, accounts: DataFrame | None = None, coverage: DataFrame | None = None, block_days: int = 7) -> DataFrame:
    """One row of measures per account over [start, end): fills, breaks, episodes, durations, shares, open coins, results.

    ``universe``: coin; breaks, episodes and the share of notional count inside it only. ``accounts``: address,
    account_value, role. ``coverage``: address, start_ms, end_ms, status, ingested_at_ms; the last row of exactly this
    window decides. Without them the measures are over all coins, and value, role and coverage are null.
    Blocks of ``block_days`` end at the window's end. Parts are made once, as a table; every measure is an aggregate over
    all accounts at once.
    """
    return Measures(fills, start_ms, end_ms, default_lot, universe).facts(tolerance_bps, accounts, coverage, block_days)


class Measures:
    """Measures of all accounts over one window; steps and parts are written once and shared by all of them."""

    def __init__(self, fills: DataFrame, start_ms: int, end_ms: int, default_lot: float = 0.01, universe: DataFrame | None = None, share: float = SHARE, least: int = LEAST_ROWS):
        self.start_ms, self.end_ms = start_ms, end_ms
        self.fills = fills.where((F.col("time_ms") >= start_ms) & (F.col("time_ms") < end_ms))
        self.coins = None if universe is None else universe.select("coin").distinct()
        self.level_ms = split_ms(self.fills, ["address"], "time_ms", share, least)
        width = split_ms(self.fills, KEYS, "time_ms", share, least)
        self.parts = written(parts(steps(self.fills, default_lot=default_lot, bucket_ms=width)), "parts")
        self.steps = self.parts.where("part = 0")  # one row per fill

    def _inside(self, df: DataFrame) -> DataFrame:
        """Rows of the universe's coins: a list of instruments, so mostly a broadcast by measured size."""
        return df if self.coins is None else df.join(self.coins, "coin", "left_semi")

    def facts(self, tolerance_bps: float = 10.0, accounts: DataFrame | None = None, coverage: DataFrame | None = None, block_days: int = 7) -> DataFrame:
        # rows repeated as a whole count once
        inside = self.fills.select("address", "seq", "time_ms", "coin", "kind", "px", "sz", "side", "start_position", "liquidated_user")
        episodes_ = self._inside(episodes(self.parts))
        notional = F.coalesce(F.abs("sz") * F.col("px"), F.lit(0.0))
        known = inside if self.coins is None else inside.join(self.coins.withColumn("of_universe", F.lit(True)), "coin", "left")
        of = F.lit(True) if self.coins is None else F.coalesce("of_universe", F.lit(False))
        missing = F.col("kind").isin(LOT_KIND, OTHER_KIND) & unusable()
        base = known.distinct().groupBy("address").agg(
            F.sum(missing.cast("long")).alias("n_ignored"), F.sum((missing & (F.col("kind") == LOT_KIND)).cast("long")).alias("invalid_perp_fills"),
            F.count(F.lit(1)).alias("n_fills"), F.sum(notional).alias("notional"), F.sum(F.when(F.col("kind") == LOT_KIND, notional).otherwise(0.0)).alias("perp_notional"),
            F.count(F.when(F.lower("liquidated_user") == F.lower("address"), 1)).alias("liquidated_fills"), F.sum(F.when(of, notional).otherwise(0.0)).alias("u_"),
        )
        base = base.withColumn("universe_share", F.when(F.col("notional") > 0, F.col("u_") / F.col("notional"))).drop("u_")
        broken = self._inside(self.steps).groupBy("address").agg(F.count(F.when(F.col("broke"), 1)).alias("n_breaks"))
        flat = F.col("opened_from_flat")
        closed = flat & F.col("closed").isNotNull()
        opened = F.sum(F.when(flat, F.col("opening_notional")))
        block = floor_div(F.lit(self.end_ms - 1).cast("long") - F.col("opened"), block_days * DAY_MS)
        runs = episodes_.groupBy("address").agg(
            F.count(F.when(closed, 1)).alias("closed_episodes"),
            F.when(opened > 0, F.sum(F.when(flat, F.col("opening_taker_notional"))) / opened).alias("taker_share"),
            F.size(F.collect_set(F.when(flat, block))).cast("long").alias("active_blocks"),
            F.max(F.when(closed, F.col("divergence_bps"))).alias("max_divergence_bps"),
            F.count(F.when(F.col("divergence_bps") > tolerance_bps, 1)).alias("n_violations"),
            F.count(F.when(closed & F.col("divergence_bps").isNull(), 1)).alias("unreconciled_episodes"),
        )
        durations = interpolated(episodes_.where(closed), ["address"], F.col("closed") - F.col("opened"), {"median_duration_ms": 0.5}).drop("n")
        open_ = self.open_coins().drop("weight")
        out = base
        for more in (broken, runs, durations, open_):
            out = out.join(more, "address", "left")
        zero = ("n_ignored", "invalid_perp_fills", "n_breaks", "closed_episodes", "active_blocks", "n_violations", "unreconciled_episodes")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero})
        if accounts is not None:
            out = out.join(accounts.groupBy("address").agg(F.max("account_value").alias("account_value"), F.max("role").alias("role")), "address", "left")
        if coverage is not None:
            mine = coverage.where((F.col("start_ms") == self.start_ms) & (F.col("end_ms") == self.end_ms))
            last = mine.groupBy("address").agg(F.max_by("status", F.struct("ingested_at_ms", "status")).alias("s_"))
            out = out.join(last, "address", "left").withColumn("coverage_ok", F.coalesce(F.col("s_") == "ok", F.lit(False))).drop("s_")
        return out

    def open_coins(self, pct: int = 50) -> DataFrame:
        return open_coins(self.steps, self.start_ms, self.end_ms, pct, self.level_ms)

    def exposure(self, pct: int = 95) -> DataFrame:
        return exposure(self._inside(self.steps), self.start_ms, self.end_ms, pct, self.level_ms)


def moves(steps_: DataFrame, was: Column, before: Column, after: Column, start_ms: int) -> DataFrame:
    """address, t, delta: what each fill changes in a sum over coins; a coin's first fill shows where it stood at the start."""
    seen = F.col("has_prev")
    first = steps_.where(~seen).select("address", F.lit(start_ms).cast("long").alias("t"), before.alias("delta"))
    return first.unionByName(steps_.select("address", F.col("time_ms").alias("t"), (after - F.when(seen, was).otherwise(before)).alias("delta")))


def open_coins(steps_: DataFrame, start_ms: int, end_ms: int, pct: int = 50, bucket_ms: int | None = None) -> DataFrame:
    """address, median_open, weight: time-weighted percentile of the number of open coins, over the time with at least one."""
    is_open = lambda c: (F.col(c) != 0).cast("long")
    changes = moves(steps_, is_open("expected"), is_open("before"), is_open("after"), start_ms)
    return weighted_percentile(step_levels(changes, ["address"], "t", "delta", start_ms, end_ms, bucket_ms), ["address"], "level", "weight", pct, "median_open")


def exposure(steps_: DataFrame, start_ms: int, end_ms: int, pct: int = 95, bucket_ms: int | None = None) -> DataFrame:
    """address, exposure, hours: time-weighted percentile of the sum of |position| * price over time in position, in whole cents."""
    cents = lambda c, px: F.floor(F.abs(F.col(c)) * F.col(px) * 100 + 0.5).cast("long")
    changes = moves(steps_, cents("expected", "prev_px"), cents("before", "px"), cents("after", "px"), start_ms)
    found = weighted_percentile(step_levels(changes, ["address"], "t", "delta", start_ms, end_ms, bucket_ms), ["address"], "level", "weight", pct, "cents")
    return found.select("address", (F.col("cents") / 100).alias("exposure"), (F.col("weight") / 3_600_000).alias("hours"))


def lots_from_meta(meta: DataFrame) -> DataFrame:
    """coin, lot: 10 to the minus sz_decimals."""
    return meta.select("coin", F.pow(F.lit(10.0), -F.col("sz_decimals")).alias("lot"))
