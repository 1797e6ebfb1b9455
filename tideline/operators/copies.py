"""Copied accounts over a window: positions between orders, funding, marked equity, the identity of both sides, shared ladders.

Every amount is a whole number: sizes in hundredths, prices in ten-thousandths, cash in millionths, funding rates in
millionths of a notional, so that sums are exact in any order. Nothing is replayed: a position is a running sum of orders,
it stands from one order to the next, and what it pays is its size times the difference of two readings of its coin's
funding index, however many hours lie between. Marks are the last price strictly before the second of their instant.

Orders without time, coin, run or wallet, without price or with a size of zero do not count; orders repeated as a whole
count once. A mark or rate that is missing counts as nothing and is listed by ``missing``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS, floor_div, floor_to, hour_floor
from tideline.operators.curves import average_cost, drawdowns, order_runs, returns, sharpe, together
from tideline.operators.ordered import Runs, as_of, join_same, split_ms
from tideline.session import written

KEYS = ["run_id", "wallet", "coin"]
ACCOUNT = ["run_id", "wallet"]
MICRO = 1_000_000


def whole(c: Column, per: int) -> Column:
    """``c`` in whole parts of 1 / ``per``, halves up."""
    return F.floor(c * per + 0.5).cast("long")


def ceil_to(c: Column, width: int) -> Column:
    return -floor_to(-c, width)


class Copies:
    def __init__(self, orders: DataFrame, prices: DataFrame, rates: DataFrame, start_ms: int, end_ms: int, capital: int):
        """``orders``: KEYS, order_no, exec_t, signed, price, fee. ``prices``: coin, second, last. ``rates``: coin, hour_ms, rate (millionths).

        ``capital``: whole units per wallet.
        """
        self.start_ms, self.end_ms, self.capital = start_ms, end_ms, capital
        rows = orders.where((F.col("exec_t") >= start_ms) & (F.col("exec_t") < end_ms)).select(
            *KEYS, "order_no", "exec_t", "price", whole(F.col("signed"), 100).alias("units"), whole(F.col("price"), 10_000).alias("px"), whole(F.coalesce("fee", F.lit(0.0)), MICRO).alias("fee")
        )
        self.orders = written(rows.where("units != 0 and px is not null").dropna(subset=KEYS).distinct(), "copied-orders")
        self.prices = prices.where("last > 0 and coin is not null").groupBy("coin", "second").agg(F.min("last").alias("last"))
        self.rates = rates.groupBy("coin", "hour_ms").agg(F.min("rate").alias("rate"))
        self.width = split_ms(self.orders, KEYS, "exec_t")
        self._index: DataFrame | None = None

    # -- marks and the funding index -----------------------------------------------------------------------------------------

    def marks(self, instants: DataFrame, time: str) -> DataFrame:
        """``instants`` (coin, time) with ``mark``, null before the coin's first price."""
        rows = instants.withColumn("second_", floor_div(time, 1_000))
        found = as_of(rows, self.prices, ["coin"], "second_", "second", ["last"], strict=True, bucket_ms=86_400, prefix="m_")
        return found.withColumn("mark", whole(F.col("m_last"), 10_000)).drop("second_", "m_last", "m_second")

    def index(self) -> DataFrame:
        """coin, hour_ms, owed, known: what one unit of size has paid up to and including each hour, in millionths of a ten-thousandth, and at how many hours."""
        if self._index is not None:
            return self._index
        inside = self.rates.where((F.col("hour_ms") >= self.start_ms) & (F.col("hour_ms") < self.end_ms))
        term = F.coalesce(F.col("mark") * F.col("rate"), F.lit(0)).cast("long")
        self._index = written(Runs(self.marks(inside, "hour_ms"), ["coin"], "hour_ms", [], 64 * DAY_MS).running(owed=term, known=F.col("mark").isNotNull().cast("long")).select("coin", "hour_ms", "mark", "rate", "owed", "known"), "funding-index")
        return self._index

    def missing(self) -> DataFrame:
        """coin, hour_ms that open positions ask for and that have no rate."""
        hours = self.hours().select("coin", "hour_ms").distinct()
        return hours.join(self.rates.select("coin", "hour_ms"), ["coin", "hour_ms"], "left_anti")

    # -- positions -------------------------------------------------------------------------------------------------------------

    def intervals(self) -> DataFrame:
        """KEYS, t, until, size: the position after the orders of each instant, and until when it stands."""
        at = self.orders.groupBy(*KEYS, F.col("exec_t").alias("t")).agg(F.sum("units").alias("units_"))
        rows = Runs(at, KEYS, "t", [], self.width).annotate(following=["t"], running={"size": F.col("units_")})
        return rows.select(*KEYS, "t", F.coalesce("next_t", F.lit(self.end_ms)).alias("until"), "size")

    def hours(self) -> DataFrame:
        """KEYS, hour_ms, size: the full hours at which a position is open; an hour comes before the orders of its instant."""
        rows = self.intervals().where("size != 0").withColumn("a_", hour_floor("t") + HOUR_MS).withColumn("b_", hour_floor(F.least("until", F.lit(self.end_ms - 1))))
        return rows.where("a_ <= b_").select(*KEYS, "size", F.explode(F.sequence("a_", "b_", F.lit(HOUR_MS))).alias("hour_ms"))

    def payments(self) -> DataFrame:
        """KEYS, hour_ms, size, mark, rate, amount: every payment by itself."""
        return self.hours().join(self.index().where("mark is not null"), ["coin", "hour_ms"]).select(*KEYS, "hour_ms", "size", "mark", "rate", (F.col("size") * F.col("mark") * F.col("rate")).alias("amount"))

    def _owed(self, rows: DataFrame, time: Column, index: DataFrame, out: str) -> DataFrame:
        """``rows`` with the index of their coin at the hour of ``time``, 0 before the first."""
        asked = rows.withColumn("hour_", hour_floor(time))
        return join_same(asked.withColumnRenamed("hour_", "hour_ms"), index.select("coin", "hour_ms", F.col("owed").alias(out)), ["coin", "hour_ms"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("hour_ms")

    def funding(self) -> DataFrame:
        """KEYS, t, until, size, paid: what each position pays while it stands, from two readings of the index."""
        index = self.index()
        rows = self._owed(self.intervals(), F.col("t"), index, "from_")
        rows = self._owed(rows, F.least("until", F.lit(self.end_ms - 1)), index, "to_")
        return rows.select(*KEYS, "t", "until", "size", (F.col("size") * (F.col("to_") - F.col("from_"))).alias("paid"), F.col("from_").alias("owed_before"))

    def episode_payments(self, episodes: DataFrame) -> DataFrame:
        """KEYS, episode, n, paid: number and sum of the payments within opened < hour <= closed, of episodes that have any.

        ``episodes``: KEYS, episode (from 1), opened, closed (null: still open); those of a key do not overlap. Between two
        instants a key holds one size in one episode, so two readings of the index stand for all payments between them.
        """
        zero, turn = F.lit(0).cast("long"), lambda t, n: F.struct(F.col(t).alias("t"), zero.alias("units"), n.cast("long").alias("turn"))
        turns = episodes.select(*KEYS, F.explode(F.array(turn("opened", F.col("episode")), turn("closed", -F.col("episode")))).alias("x")).select(*KEYS, "x.*").where("t is not null")
        at = self.orders.select(*KEYS, F.col("exec_t").alias("t"), "units", zero.alias("turn")).unionByName(turns)
        at = at.groupBy(*KEYS, "t").agg(F.sum("units").alias("units_"), F.sum("turn").alias("turn_"))
        rows = Runs(at, KEYS, "t", [], self.width).annotate(following=["t"], running={"size": F.col("units_"), "episode": F.col("turn_")})
        last = F.lit(self.end_ms - 1).cast("long")
        rows = rows.where("size != 0 and episode != 0").select(*KEYS, "episode", "size", hour_floor("t").alias("a_"), hour_floor(F.least(F.coalesce("next_t", last), last)).alias("b_"))
        rows = written(rows.where("a_ < b_"), "stretches")
        for tag in "ab":
            rows = as_of(rows, self.index(), ["coin"], f"{tag}_", "hour_ms", ["owed", "known"], prefix=f"{tag}_")
        past = lambda c: F.coalesce(f"b_{c}", zero) - F.coalesce(f"a_{c}", zero)
        return rows.groupBy(*KEYS, "episode").agg(F.sum(past("known")).alias("n"), F.sum(F.col("size") * past("owed")).alias("paid")).where("n > 0")

    # -- equity ----------------------------------------------------------------------------------------------------------------

    def curve(self) -> DataFrame:
        """ACCOUNT, t, equity, gross, frozen: marked at every midnight after which a wallet has traded or holds something.

        A curve starts with the capital at the window's start and ends at its end, or where equity is first not positive.
        Amounts are in millionths.
        """
        index, held = self.index(), written(self.funding(), "positions")
        day = lambda c: ceil_to(c, DAY_MS)
        last = day(F.lit(self.end_ms).cast("long"))
        flows = self.orders.groupBy(*ACCOUNT, day(F.col("exec_t")).alias("t")).agg(F.sum(-F.col("units") * F.col("px") - F.col("fee")).alias("cash"))
        flows = flows.select(*ACCOUNT, "t", "cash", *(F.lit(0).cast("long").alias(c) for c in ("paid", "value", "gross", "owing")))
        # an interval has paid in full at the first midnight not before its end
        done = held.where("until < " + str(self.end_ms)).groupBy(*ACCOUNT, day(F.col("until")).alias("t")).agg(F.sum("paid").alias("paid"))
        done = done.select(*ACCOUNT, "t", F.lit(0).cast("long").alias("cash"), "paid", *(F.lit(0).cast("long").alias(c) for c in ("value", "gross", "owing")))
        spans = held.where("size != 0").withColumn("a_", day(F.col("t"))).withColumn("b_", F.least(day(F.col("until")) - DAY_MS, last) + F.when(F.col("until") == self.end_ms, DAY_MS).otherwise(0)).where("a_ <= b_")
        open_ = spans.select(*KEYS, "size", "owed_before", F.explode(F.sequence("a_", "b_", F.lit(DAY_MS))).alias("t")).withColumn("read_", F.least("t", F.lit(self.end_ms - 1)))
        open_ = self._owed(self.marks(open_, "t"), F.col("read_"), index, "now_")
        value = F.coalesce(F.col("size") * F.col("mark"), F.lit(0))
        open_ = open_.groupBy(*ACCOUNT, "t").agg(F.sum(value).alias("value"), F.sum(F.abs(value)).alias("gross"), F.sum(F.col("size") * (F.col("now_") - F.col("owed_before"))).alias("owing"))
        open_ = open_.select(*ACCOUNT, "t", *(F.lit(0).cast("long").alias(c) for c in ("cash", "paid")), "value", "gross", "owing")
        rows = flows.unionByName(done).unionByName(open_).groupBy(*ACCOUNT, "t").agg(*(F.sum(c).alias(c) for c in ("cash", "paid", "value", "gross", "owing")))
        rows = Runs(rows, ACCOUNT, "t", [], 64 * DAY_MS).annotate(running={"cash_": F.col("cash"), "paid_": F.col("paid")})
        equity = F.lit(self.capital * MICRO).cast("long") + F.col("cash_") + F.col("value") - floor_div(F.col("paid_") + F.col("owing"), MICRO)
        rows = rows.withColumn("t", F.least("t", F.lit(self.end_ms).cast("long"))).select(*ACCOUNT, "t", equity.alias("equity"), "gross")
        start = self.orders.select(*ACCOUNT).distinct().select(*ACCOUNT, F.lit(self.start_ms).cast("long").alias("t"), F.lit(self.capital * MICRO).cast("long").alias("equity"), F.lit(0).cast("long").alias("gross"))
        rows = written(start.unionByName(rows), "marked")
        gone = rows.where("equity <= 0").groupBy(*ACCOUNT).agg(F.min("t").alias("frozen_at"))
        return join_same(rows, gone, ACCOUNT, "left").where("frozen_at is null or t <= frozen_at").select(*ACCOUNT, "t", "equity", "gross", (F.col("t") == F.col("frozen_at")).alias("f_")).select(*ACCOUNT, "t", "equity", "gross", F.coalesce("f_", F.lit(False)).alias("frozen"))

    def ends(self) -> DataFrame:
        """KEYS, size, mark: what is held at the window's end."""
        at = self.orders.groupBy(*KEYS).agg(F.sum("units").alias("size"))
        return self.marks(at.where("size != 0").withColumn("t", F.lit(self.end_ms).cast("long")), "t").drop("t")

    def costs(self) -> DataFrame:
        """KEYS, episode, realized, size, cost: results of every episode at average cost, from the same whole prices."""
        rows = self.orders.select(*KEYS, "order_no", "exec_t", (F.col("px") / 10_000).alias("price"), (F.col("units") / 100).alias("signed"))
        runs = written(order_runs(rows, KEYS, "exec_t", ["order_no"], F.col("signed"), self.width), "order-runs")
        return average_cost(runs, KEYS, "exec_t", ["order_no"], bucket_ms=self.width)

    def identity(self, tolerance: float = 1e-9) -> DataFrame:
        """ACCOUNT, gained, rebuilt, fees, paid, ok: cash flows and marks against results at average cost, two ways to one number."""
        costs = written(self.costs(), "costs")
        left = self.ends().withColumn("value", F.coalesce(F.col("size") * F.col("mark"), F.lit(0)))
        cash = self.orders.groupBy(*ACCOUNT).agg(F.sum(-F.col("units") * F.col("px")).alias("cash"), F.sum("fee").alias("fees"))
        paid = self.funding().groupBy(*ACCOUNT).agg(F.sum("paid").alias("paid"))
        held = left.groupBy(*ACCOUNT).agg(F.sum("value").alias("value"))
        open_ = costs.where("size != 0").join(left.select(*KEYS, "mark"), KEYS, "left").withColumn("u", F.col("size") * (F.col("mark") / 10_000 - F.col("cost")))
        made = costs.groupBy(*ACCOUNT).agg(F.sum("realized").alias("realized")).join(open_.groupBy(*ACCOUNT).agg(F.sum("u").alias("unrealized")), ACCOUNT, "left")
        out = cash.join(held, ACCOUNT, "left").join(paid, ACCOUNT, "left").join(made, ACCOUNT)
        gross = F.col("cash") + F.coalesce("value", F.lit(0))
        gained = gross - F.col("fees") - floor_div(F.coalesce("paid", F.lit(0)), MICRO)
        rebuilt = F.col("realized") + F.coalesce("unrealized", F.lit(0.0))
        scale = F.greatest(F.lit(1.0), F.abs(gross / MICRO), F.abs("realized"), F.abs("unrealized"))
        return out.select(*ACCOUNT, gained.alias("gained"), rebuilt.alias("rebuilt"), "fees", F.coalesce("paid", F.lit(0)).alias("paid"), (F.abs(gross / MICRO - rebuilt) <= tolerance * scale).alias("ok"))


# -- portfolios ------------------------------------------------------------------------------------------------------------


def portfolio(curves: DataFrame, group: Sequence[str], member: str, capital: DataFrame) -> DataFrame:
    """group, t, equity, idle: the sum of members' curves at every instant of any, with the capital that none of them uses.

    ``capital``: group, capital. A frozen member keeps its last value. Members that start at different instants, or that
    hold more than the capital, are an error.
    """
    first = curves.groupBy(*group, member).agg(F.min("t").alias("t"), F.min_by("equity", "t").alias("equity"))
    invested = first.groupBy(*group).agg(F.sum("equity").alias("invested"), F.countDistinct("t").alias("starts"))
    rows = invested.join(capital, list(group)).withColumn("idle", F.col("capital") - F.col("invested"))
    bad = rows.where("starts > 1 or idle < 0").limit(1).collect()
    if bad:
        raise ValueError(f"members do not fit: {bad[0]}")
    return together(curves, group, member).join(rows.select(*group, "idle"), list(group)).select(*group, "t", (F.col("equity") + F.col("idle")).alias("equity"), "idle")


def metrics(curves: DataFrame, keys: Sequence[str], notional: DataFrame, periods: int = 365) -> DataFrame:
    """keys, net_return, sharpe, depth, turnover, max_leverage, frozen: one row per curve.

    Sharpe and drawdown only of curves that stay positive; turnover is traded notional (``notional``: keys, notional) over
    mean equity; ``curves`` needs gross and frozen.
    """
    by = curves.groupBy(*keys).agg(
        F.min_by("equity", "t").alias("first_"), F.max_by("equity", "t").alias("last_"), F.avg("equity").alias("mean_"), F.min("equity").alias("least_"), F.bool_or("frozen").alias("frozen"),
        F.max(F.when(F.col("equity") > 0, F.col("gross") / F.col("equity"))).alias("max_leverage"),
    )
    positive = F.col("least_") > 0
    ratio = sharpe(returns(curves.select(*keys, "t", F.col("equity").cast("double").alias("equity")), keys), keys, periods)
    fall = drawdowns(curves.select(*keys, "t", F.col("equity").cast("double").alias("equity")), keys)
    out = by.join(ratio.drop("n"), list(keys), "left").join(fall.select(*keys, "depth"), list(keys), "left").join(notional, list(keys), "left")
    return out.select(*keys, (F.col("last_") / F.col("first_") - 1).alias("net_return"), F.when(positive, F.col("sharpe")).alias("sharpe"), F.when(positive, F.col("depth")).alias("depth"), F.when(F.col("mean_") > 0, F.col("notional") / F.col("mean_")).alias("turnover"), "max_leverage", "frozen")


def cohort(curves: DataFrame, members: DataFrame, k: int, capital: int) -> DataFrame:
    """``curves`` of the first ``k`` members of each run (``members``: run_id, wallet, place from 0), each scaled to capital / k."""
    first = curves.groupBy(*ACCOUNT).agg(F.min_by("equity", "t").alias("first_"))
    chosen = curves.join(members.where(F.col("place") < k).select(*ACCOUNT), ACCOUNT).join(first, ACCOUNT)
    share = capital * MICRO // k
    return chosen.withColumn("equity", F.floor(F.col("equity") * (F.lit(float(share)) / F.col("first_")) + 0.5).cast("long")).drop("first_")


def cap_excess(curves: DataFrame, keys: Sequence[str], cap_pct: int) -> DataFrame:
    """keys, n, most, share: instants at which gross exposure is above the cap on equity, by how much at most, and as a share of it."""
    over = F.col("gross") * 100 - F.col("equity") * cap_pct
    rows = curves.withColumn("over_", F.when((F.col("equity") > 0) & (over > 0), over))
    return rows.groupBy(*keys).agg(F.count("over_").alias("n"), F.coalesce(F.max("over_"), F.lit(0)).alias("most_hundredths"), F.coalesce(F.max(F.col("over_") / F.col("equity")), F.lit(0.0)).alias("most_share_pct"))


# -- ladders that several orders share ---------------------------------------------------------------------------------------


def shared_ladder(orders: DataFrame, levels: DataFrame, book: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``orders`` with filled, value, levels_used: orders of one book and side eat its levels one after the other.

    ``orders``: book columns, ``order``, wanted (hundredths). ``levels``: book columns, level, units, px. What an order
    takes of a level is where its stretch of the demand overlaps the level's stretch of the supply.
    """
    demand = W.partitionBy(*book).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # the orders of one instant
    supply = W.partitionBy(*book).orderBy("level").rowsBetween(W.unboundedPreceding, 0)  # the few levels of a book
    asked = orders.withColumn("to_", F.sum("wanted").over(demand)).withColumn("from_", F.col("to_") - F.col("wanted"))
    there = levels.where("units > 0 and px is not null").withColumn("high_", F.sum("units").over(supply)).withColumn("low_", F.col("high_") - F.col("units"))
    both = asked.join(there.select(*book, "low_", "high_", "px"), list(book), "left")
    take = F.greatest(F.lit(0).cast("long"), F.least("to_", "high_") - F.greatest("from_", "low_"))
    rows = both.withColumn("take_", F.coalesce(take, F.lit(0)))
    rows = rows.withColumn("take_", F.when(F.col("low_").isNull(), 0).otherwise(F.col("take_")))
    return rows.groupBy(*orders.columns).agg(F.sum("take_").alias("filled"), F.sum(F.col("take_") * F.coalesce("px", F.lit(0))).alias("value"), F.count(F.when(F.col("take_") > 0, 1)).alias("levels_used"))


# -- buying and holding, scenario by scenario ----------------------------------------------------------------------------------


def hold(scenarios: DataFrame, bars: DataFrame, index: DataFrame, marks: DataFrame, start_ms: int, capital: int) -> DataFrame:
    """coin, scenario columns, exec_t, px, units, fee, paid, gained: one purchase at the start, held to the end, per coin and scenario.

    ``scenarios``: scenario, delay_ms, slippage_bps, fee_bps, funding, constraints; a stated few, so each coin is worked
    on in each. With constraints sizes are whole hundredths that leave room for the fee, else any. ``index``: coin,
    hour_ms, owed; ``marks``: coin, mark at the end.
    """
    from tideline.operators.panel import executions

    coins = marks.where("mark is not null").select("coin", F.col("mark").alias("end_mark"))
    packed = scenarios.agg(F.collect_list(F.struct(*scenarios.columns)).alias("s_"), F.lit(0).alias("k_"))
    rows = coins.withColumn("k_", F.lit(0)).join(F.broadcast(packed), "k_").select("coin", "end_mark", F.explode("s_").alias("s")).select("coin", "end_mark", "s.*")
    rows = rows.withColumn("side", F.lit("buy")).withColumn("nominal_t", F.lit(start_ms).cast("long") + F.col("delay_ms"))
    done = executions(rows, bars).where("exec_t is not null and exec_px > 0").drop("side")
    px = whole(F.col("exec_px"), 10_000)
    done = done.withColumn("px", floor_div(px * (10_000 + F.col("slippage_bps")), 10_000))
    money = F.lit(capital * MICRO).cast("long")
    room = F.when(F.col("constraints"), floor_div(money * 10_000, 1) / (F.col("px") * (10_000 + F.col("fee_bps")))).otherwise(money / F.col("px"))
    done = done.withColumn("units", F.floor(room + 1e-9).cast("long"))
    done = done.withColumn("fee", F.floor(F.col("units") * F.col("px") * F.col("fee_bps") / 10_000 + 0.5).cast("long"))
    last = index.groupBy("coin").agg(F.max_by("owed", "hour_ms").alias("to_"))
    before = index.select("coin", F.col("hour_ms").alias("h_"), F.col("owed").alias("from_"))
    done = done.withColumn("h_", hour_floor("exec_t")).join(before, ["coin", "h_"], "left").join(last, "coin", "left")
    paid = F.when(F.col("funding"), F.col("units") * (F.coalesce("to_", F.lit(0)) - F.coalesce("from_", F.lit(0)))).otherwise(0).cast("long")
    done = done.withColumn("paid", paid)
    gained = F.col("units") * (F.col("end_mark") - F.col("px")) - F.col("fee") - floor_div("paid", MICRO)
    return done.select("coin", *scenarios.columns, "exec_t", "px", "units", "fee", "paid", gained.alias("gained"))


def steps(primary: dict) -> list[tuple[int, str, int, int, int, bool, bool, str | None]]:
    """The ladder of scenarios from an ideal copy to ``primary``: step, name, delay, slippage, fee, funding, constraints, and why it adds nothing."""
    order = [("ideal", None, None), ("delay", "delay_ms", "delay_zero"), ("slippage", "slippage_bps", "no_slippage"), ("fees", "fee_bps", "fee_zero"), ("funding", "funding", "funding_off"), ("size_constraints", "constraints", "size_constraints_off")]
    now = {"delay_ms": 0, "slippage_bps": 0, "fee_bps": 0, "funding": False, "constraints": False}
    out = []
    for n, (name, field, inert) in enumerate(order):
        if field:
            now = now | {field: primary[field]}
        out.append((n, name, *now.values(), inert if field and not primary[field] else None))
    return out


def warnings(scenarios: DataFrame) -> DataFrame:
    """``scenarios`` with the names of what no real market offers: no fee, no slippage."""
    return scenarios.withColumn("warnings", F.filter(F.array(F.when(F.col("fee_bps") == 0, "fee_zero"), F.when(F.col("slippage_bps") == 0, "slippage_zero")), lambda x: x.isNotNull()))


def groups_for(capital: Column, unit: int, least: int, most: int) -> Column:
    """How many accounts a capital is spread over: one per ``unit``, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(capital / unit))).cast("long")


def floor_lot(size: Column, lot: Column) -> Column:
    """``size`` cut to whole lots; what floating point lost just below a lot counts as whole."""
    return F.floor(size / lot + 1e-9) * lot
