"""Copied accounts against a replay, hour by hour and order by order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS
from tideline.operators import copies as cp

START, END, CAPITAL = 0, 4 * DAY_MS, 1000
ORDER = "run_id long, wallet string, coin string, order_no long, exec_t long, signed double, price double, fee double"


def world(seed, frozen=False):
    rng = random.Random(seed)
    orders, pos, n = [], {}, 0
    for t in sorted(rng.sample(range(0, END, 1_800_000), 60)):
        w, c = rng.choice("uv"), rng.choice(["a", "b"])
        p = pos.get((w, c), 0)
        d = rng.choice([-p, 1, 2, -1, -3]) or 1
        pos[w, c] = p + d
        orders.append((1, w, c, n, t, d / 4, round(100 + rng.random() * 10, 4) * (90 if frozen else 1), 0.01))
        n += 1
    prices = [(c, s, round(100 + rng.random() * 10, 4)) for c in "ab" for s in sorted(rng.sample(range(0, END // 1000), 200))]
    rates = [(c, h, rng.randrange(-5, 6)) for c in "ab" for h in range(START, END, HOUR_MS)]
    return orders, prices, rates


def make(spark, orders, prices, rates):
    more = [(1, "u", "a", 999, None, 1.0, 1.0, 0.0), (1, "u", "a", 998, 5, 0.001, 1.0, 0.0), (None, "u", "a", 997, 5, 1.0, 1.0, 0.0), (1, "u", "a", 996, END, 1.0, 1.0, 0.0), *orders[:2]]  # none of these counts, or counts again
    return cp.Copies(spark.createDataFrame(orders + more, ORDER), spark.createDataFrame(prices + [("a", 5, -1.0), (None, 5, 1.0)], "coin string, second long, last double"), spark.createDataFrame(rates + rates[:1], "coin string, hour_ms long, rate long"), START, END, CAPITAL)


def replay(orders, prices, rates):
    """Payments, equity at midnights, cash: in whole numbers, one step after the other."""
    up = lambda x, k: math.floor(x * k + 0.5)
    mark = lambda c, t: max(((s, p) for k, s, p in prices if k == c and s < t // 1000), default=(None, None))[1]
    rate = {(c, h): r for c, h, r in rates}
    size, cash, paid, payments, curve = {}, {}, {}, [], []
    instants = sorted({(h, 0, None) for h in range(START, END, HOUR_MS)} | {(o[4], 1, i) for i, o in enumerate(orders)} | {(d, 2, None) for d in range(DAY_MS, END + 1, DAY_MS)}, key=lambda x: (x[0], x[1], x[2] or 0))
    for t, kind, i in instants:
        if kind == 0:
            for (w, c), u in sorted(size.items()):
                m = mark(c, t)
                if u and m is not None:
                    a = u * up(m, 10_000) * rate[c, t]
                    payments.append((w, c, t, a))
                    paid[w] = paid.get(w, 0) + a
        elif kind == 1:
            _, w, c, _, _, s, p, fee = orders[i]
            u = up(s, 100)
            size[w, c] = size.get((w, c), 0) + u
            cash[w] = cash.get(w, 0) - u * up(p, 10_000) - up(fee, 10**6)
        else:
            for w in "uv":
                held = {c: u * up(mark(c, t) or 0, 10_000) for (x, c), u in size.items() if x == w and u}
                curve.append((w, t, CAPITAL * 10**6 + cash.get(w, 0) + sum(held.values()) - (paid.get(w, 0) // 10**6), sum(map(abs, held.values()))))
    return payments, curve


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_replay(spark, seed):
    w = world(seed)
    c = make(spark, *w)
    payments, curve = replay(*w)
    assert sorted((r.wallet, r.coin, r.hour_ms, r.amount) for r in c.payments().collect()) == sorted(payments)
    by = {}
    for x, y, _, a in payments:
        by[x, y] = by.get((x, y), 0) + a
    assert {(r.wallet, r.coin): r.p for r in c.funding().groupBy("wallet", "coin").agg(F.sum("paid").alias("p")).collect() if r.p} == {k: v for k, v in by.items() if v}
    want = {(x, t): (e, g) for x, t, e, g in curve}
    got = {(r.wallet, r.t): (r.equity, r.gross) for r in c.curve().collect()}
    assert got.pop(("u", START)) == got.pop(("v", START)) == (CAPITAL * 10**6, 0)
    assert got and all(want[k] == v for k, v in got.items())
    last = {}
    for k in sorted(want):  # midnights without a row are those at which nothing changed
        if k in got:
            last[k[0]] = want[k]
        elif k[0] in last:
            assert want[k][0] == last[k[0]][0]
    assert c.identity().where("not ok").count() == 0 and c.missing().count() == 0


def test_a_curve_ends_where_equity_is_used_up(spark):
    rows = make(spark, *world(4, frozen=True)).curve().collect()
    for w in "uv":
        mine = sorted((r.t, r.equity, r.frozen) for r in rows if r.wallet == w)
        assert all(e > 0 and not f for _, e, f in mine[:-1]) and (mine[-1][1] <= 0) == mine[-1][2]
    assert any(r.frozen for r in rows)


def test_empty(spark):
    c = cp.Copies(spark.createDataFrame([], ORDER), spark.createDataFrame([], "coin string, second long, last double"), spark.createDataFrame([], "coin string, hour_ms long, rate long"), 0, DAY_MS, 10)
    assert c.curve().count() == c.payments().count() == c.identity().count() == c.ends().count() == 0


def test_shared_ladder(spark):
    rng = random.Random(6)
    levels = [(b, k, rng.randrange(1, 30), 1000 + k) for b in "xy" for k in range(5)] + [("x", 5, 0, 1), ("y", 5, 9, None)]
    orders = [(b, i, rng.randrange(1, 25)) for b in "xyz" for i in range(6)]
    want = {}
    for b in "xyz":
        left = [[n, p] for k, _, n, p in levels if k == b and n and p]
        for _, i, n in [o for o in orders if o[0] == b]:
            got = value = used = 0
            for lv in left:
                take = min(lv[0], n - got)
                lv[0], got, value, used = lv[0] - take, got + take, value + take * lv[1], used + (take > 0)
            want[b, i] = (got, value, used)
    out = cp.shared_ladder(spark.createDataFrame(orders, "b string, i int, wanted long"), spark.createDataFrame(levels, "b string, level int, units long, px long"), ["b"], ["i"])
    assert {(r.b, r.i): (r.filled, r.value, r.levels_used) for r in out.collect()} == want


def test_portfolio(spark):
    curves = spark.createDataFrame([("g", "u", 0, 100), ("g", "u", 5, 90), ("g", "v", 0, 100), ("g", "v", 3, 130)], "g string, w string, t long, equity long")
    cap = lambda n: spark.createDataFrame([("g", n)], "g string, capital long")
    assert sorted((r.t, r.equity, r.idle) for r in cp.portfolio(curves, ["g"], "w", cap(250)).collect()) == [(0, 250, 50), (3, 280, 50), (5, 270, 50)]
    with pytest.raises(ValueError):
        cp.portfolio(curves, ["g"], "w", cap(199))
    with pytest.raises(ValueError):
        cp.portfolio(curves.where("not (w = 'v' and t = 0)"), ["g"], "w", cap(999))


def test_cap_and_metrics(spark):
    rows = spark.createDataFrame([("u", 0, 100, 0, False), ("u", 1, 100, 150, False), ("u", 2, 200, 100, False), ("v", 0, 100, 0, False), ("v", 1, -5, 50, True)], "w string, t long, equity long, gross long, frozen boolean")
    got = {r.w: tuple(r)[1:] for r in cp.cap_excess(rows, ["w"], 100).collect()}
    assert got == {"u": (1, 5000, 50.0), "v": (0, 0, 0.0)}
    m = {r.w: r for r in cp.metrics(rows, ["w"], spark.createDataFrame([("u", 400)], "w string, notional long")).collect()}
    assert (m["u"].net_return, m["u"].depth, m["u"].turnover, m["u"].max_leverage, m["u"].frozen) == (1.0, 0.0, 3.0, 1.5, False)
    assert (m["v"].sharpe, m["v"].depth, m["v"].turnover, m["v"].frozen) == (None, None, None, True)


def test_hold_and_steps(spark):
    bars = spark.createDataFrame([("a", 10, 9.0, 10.0, 9.5), ("a", 20, 11.0, 12.0, 11.5), ("b", 90, 1.0, 1.0, 1.0)], "coin string, second long, low double, high double, last double")
    index = spark.createDataFrame([("a", 0, 0), ("a", HOUR_MS, 50_000_000)], "coin string, hour_ms long, owed long")
    marks = spark.createDataFrame([("a", 150_000), ("b", None)], "coin string, mark long")
    plan = [(0, 0, 0, 0, False, False), (1, 5_000, 0, 0, False, False), (2, 15_000, 100, 10, True, True)]
    s = spark.createDataFrame(plan, "scenario int, delay_ms long, slippage_bps long, fee_bps long, funding boolean, constraints boolean")
    got = {r.scenario: r for r in cp.hold(s, bars, index, marks, 5_000, 1000).collect()}
    assert (got[0].exec_t, got[0].px, got[0].units, got[0].gained) == (10_000, 100_000, 10_000, 10_000 * 50_000)
    assert got[1].exec_t == 10_000 and got[2].px == 121_200 and got[2].units == 1_000_000_000 * 10_000 // (121_200 * 10_010)
    assert got[2].paid == got[2].units * 50_000_000 and got[2].gained == got[2].units * (150_000 - 121_200) - got[2].fee - got[2].paid // 10**6
    ladder = cp.steps({"delay_ms": 5, "slippage_bps": 0, "fee_bps": 5, "funding": False, "constraints": True})
    assert [(x[1], x[-1]) for x in ladder] == [("ideal", None), ("delay", None), ("slippage", "no_slippage"), ("fees", None), ("funding", "funding_off"), ("size_constraints", None)]
    assert ladder[-1][2:7] == (5, 0, 5, False, True)
    w = {r.scenario: r.warnings for r in cp.warnings(s).collect()}
    assert w == {0: ["fee_zero", "slippage_zero"], 1: ["fee_zero", "slippage_zero"], 2: []}
    df = spark.createDataFrame([(0.0,), (7_500.0,), (9e9,)], "c double")
    assert [r.k for r in df.select(cp.groups_for(F.col("c"), 5_000, 2, 20).alias("k")).collect()] == [2, 2, 20]
    lots = spark.createDataFrame([(0.3, 0.1), (0.29, 0.1), (0.7, 0.1)], "s double, l double")
    assert [round(r.x * 10) for r in lots.select(cp.floor_lot(F.col("s"), F.col("l")).alias("x")).collect()] == [3, 2, 7]
