from pyspark.sql import functions as F

from tideline.operators.curves import average_cost, decomposition, drawdowns, ladder_fill, order_runs, returns, sharpe, to_episodes, together
from tideline.operators.panel import executions, quotes_around, rates_at, scenarios
from tideline.operators.storage import add_only


def curve(spark, *points, k="a"):
    return spark.createDataFrame([(k, t, float(e)) for t, e in points], "k string, t long, equity double")


def test_drawdown(spark):
    c = curve(spark, (1, 100), (2, 120), (3, 90), (4, 120), (5, 60), (6, 119)).union(curve(spark, (1, 1), (2, 2), k="b"))
    got = {r.k: tuple(r)[1:] for r in drawdowns(c, ["k"]).collect()}
    assert got == {"a": (0.5, 2, 5, None), "b": (0.0, None, None, None)}
    assert {r.k: r.recovery_t for r in drawdowns(c.union(curve(spark, (7, 120))), ["k"]).collect()}["a"] == 7


def test_returns_and_sharpe(spark):
    c = curve(spark, (1, 100), (2, 110), (3, 99))
    assert [round(r.ret, 9) for r in returns(c, ["k"]).orderBy("t").collect()] == [0.1, -0.1]
    assert [round(r.sharpe, 9) for r in sharpe(returns(c, ["k"]), ["k"], 365).collect()] == [0.0]
    assert [r.sharpe for r in sharpe(returns(curve(spark, (1, 1), (2, 2), (3, 4)), ["k"]), ["k"], 365).collect()] == [None]


def test_together(spark):
    df = spark.createDataFrame([("g", "x", 1, 10.0), ("g", "y", 1, 5.0), ("g", "x", 3, 12.0), ("g", "y", 2, 6.0)], "g string, m string, t long, equity double")
    assert sorted((r.t, r.equity) for r in together(df, ["g"], "m").collect()) == [(1, 15.0), (2, 16.0), (3, 18.0)]


def test_average_cost(spark):
    o = spark.createDataFrame([("a", 1, 1, 100.0, 2.0), ("a", 2, 2, 110.0, -1.0), ("a", 3, 3, 90.0, -2.0), ("a", 4, 4, 80.0, 1.0)], "k string, t long, n long, price double, s double")
    runs = order_runs(o, ["k"], "t", ["n"], F.col("s"))
    got = [(r.episode, r.n_parts, r.realized, r.size) for r in average_cost(runs, ["k"], "t", ["n"]).orderBy("episode").collect()]
    assert got == [(1, 3, 0.0, 0.0), (2, 2, 10.0, 0.0)]


def test_ladder(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10.0), ("a", 2, 5.0, 11.0), ("a", 3, 9.0, 12.0), ("a", 4, None, None)], "k string, lv int, sz double, px double")
    assert [tuple(r) for r in ladder_fill(df, ["k"], "lv", "sz", "px", 3.0).collect()] == [("a", 3.0, 32.0 / 3, 2)]


def test_payments_belong_to_the_episode_open_before_them(spark):
    e = spark.createDataFrame([("a", 10, 20, 1), ("a", 20, None, 2)], "k string, opened long, closed long, episode long")
    p = spark.createDataFrame([("a", 10, 1.0), ("a", 11, 2.0), ("a", 20, 3.0), ("a", 21, 4.0), ("b", 15, 5.0)], "k string, t long, amount double")
    hit, lost = to_episodes(p, e, ["k"], "t")
    assert sorted((r.t, r.episode) for r in hit.collect()) == [(11, 1), (20, 1), (21, 2)]
    assert sorted((r.k, r.t) for r in lost.collect()) == [("a", 10), ("b", 15)]


def test_decomposition(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 7.0)], "k string, step int, net double")
    assert [tuple(r)[3:] for r in decomposition(df, ["k"], "step", "net").orderBy("step").collect()] == [(10.0, False), (0.0, True), (-3.0, False)]


def test_add_only(spark):
    have = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    added, clashes = add_only(have, spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 4.0)], "k string, v double"), "k")
    assert sorted(map(tuple, added.collect())) == [("a", 1.0), ("b", 2.0), ("c", 4.0)]
    assert [tuple(r) for r in clashes.collect()] == [("b", 3.0)]


def test_panel(spark):
    bars = spark.createDataFrame([("a", 10, 1.0, 3.0, 2.0), ("a", 12, 4.0, 6.0, 5.0)], "coin string, second long, low double, high double, last double")
    rows = spark.createDataFrame([("a", 10_500, "buy"), ("a", 10_999, "sell"), ("a", 11_000, "buy"), ("a", 13_000, "buy"), ("b", 1, "buy")], "coin string, nominal_t long, side string")
    got = {(r.coin, r.nominal_t): (r.exec_t, r.exec_px, r.mark) for r in executions(rows, bars).collect()}
    assert got == {("a", 10_500): (10_500, 3.0, None), ("a", 10_999): (10_999, 1.0, None), ("a", 11_000): (12_000, 6.0, 2.0), ("a", 13_000): (None, None, None), ("b", 1): (None, None, None)}
    # what comes later never changes an earlier mark
    later = bars.unionByName(spark.createDataFrame([("a", 12, 0.1, 99.0, 99.0), ("a", 20, 1.0, 1.0, 1.0)], bars.schema))
    assert {(r.nominal_t): r.mark for r in executions(rows.where("nominal_t = 11000"), later).collect()} == {11_000: 2.0}
    assert scenarios([1, 5], [0.0, 2.0]) == [(0, 1, 0.0), (1, 5, 0.0), (2, 1, 2.0)]


def test_quotes_and_rates(spark):
    q = spark.createDataFrame([("a", 1, 9.0, 10.0), ("a", 5, 8.0, 12.0)], "coin string, time_ms long, bid double, ask double")
    rows = spark.createDataFrame([("a", 3, "buy"), ("a", 3, "sell"), ("a", 9, "buy")], "coin string, t long, side string")
    assert sorted((r.t, r.side, r.px) for r in quotes_around(rows, q, "t").collect()) == [(3, "buy", 12.0), (3, "sell", 8.0), (9, "buy", 12.0)]
    hit, missing = rates_at(rows, spark.createDataFrame([("b", 0, 0.1)], "coin string, hour_ms long, rate double"), "t")
    assert hit.count() == 0 and [tuple(r) for r in missing.collect()] == [("a", 0)]
