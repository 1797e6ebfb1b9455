"""Payments of episodes, counted and summed without listing them."""

import random

import pytest
from compare import compare
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS
from tideline.operators import copies as cp
from tideline.operators.curves import order_runs, to_episodes
from tideline.plans import simulating
from tideline.sources.tables import SCHEMAS

END = 4 * DAY_MS
ORDER = "run_id long, wallet string, coin string, order_no long, exec_t long, signed double, price double, fee double"


def copies(spark, orders, prices, rates):
    return cp.Copies(spark.createDataFrame(orders, ORDER), spark.createDataFrame(prices, "coin string, second long, last double"), spark.createDataFrame(rates, "coin string, hour_ms long, rate long"), 0, END, 1000)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_payment_by_payment(spark, seed):
    rng = random.Random(seed)
    orders = [(1, rng.choice("uv"), rng.choice("ab"), n, t, rng.choice([1, 2, -1, -3]) / 4, 100.0, 0.01) for n, t in enumerate(sorted(rng.sample(range(0, END, 1_800_000), 60)))]
    prices = [(x, s, 100 + rng.random()) for x in "ab" for s in rng.sample(range(DAY_MS // 1000 * (x == "b"), END // 1000), 200)]  # b has no mark on its first day
    rates = [(x, h, rng.randrange(-5, 6)) for x in "ab" for h in range(0, END, HOUR_MS) if rng.random() < 0.7]  # hours without a rate
    c = copies(spark, orders, prices, rates)
    runs = order_runs(spark.createDataFrame(orders, ORDER), cp.KEYS, "exec_t", ["order_no"], F.col("signed"))
    ep = runs.groupBy(*cp.KEYS, "episode").agg(F.min("exec_t").alias("opened"), F.when(F.sum("units") == 0, F.max("exec_t")).alias("closed"))
    hit, _ = to_episodes(c.payments(), ep, cp.KEYS, "hour_ms")
    want = hit.groupBy(*cp.KEYS, "episode").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("paid"))
    got = sorted(map(tuple, c.episode_payments(ep).select(want.columns).collect()))
    assert len(got) > 5 and got == sorted(map(tuple, want.collect()))


def test_episodes_of_their_own(spark):
    """Episodes that begin and end between orders, one that has no length, and one that closes where the next opens."""
    c = copies(spark, [(1, "u", "a", 0, 30, 1.0, 100.0, 0.0)], [("a", 0, 100.0)], [("a", h, 1) for h in range(0, END, HOUR_MS)])
    ep = spark.createDataFrame([(1, "u", "a", 1, 0, 2 * HOUR_MS), (1, "u", "a", 2, 2 * HOUR_MS, 2 * HOUR_MS), (1, "u", "a", 3, 2 * HOUR_MS, 5 * HOUR_MS + 7), (1, "u", "a", 4, 90 * HOUR_MS, None)], "run_id long, wallet string, coin string, episode long, opened long, closed long")
    assert sorted((r.episode, r.n, r.paid) for r in c.episode_payments(ep).collect()) == [(1, 2, 2 * 10**8), (3, 3, 3 * 10**8), (4, 5, 5 * 10**8)]


def test_query_lists_no_hours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cp.Copies, "hours", lambda self: pytest.fail("a row for every hour of every position"))
    row = lambda n, t, side, size, fee=0.0, reason=None: (1, n, "w", t, t, t, "BTC", side, size, size, 10.0, fee, reason)
    turned = [row(1, 5, "buy", 2.0), row(1, 5, "buy", 2.0, reason="cap"), row(2, 3 * HOUR_MS, "sell", 3.0), row(3, 3 * HOUR_MS, "buy", 1.0), row(4, 9 * HOUR_MS, "buy", 1.0), row(5, DAY_MS, "sell", 1.0)]
    spark.createDataFrame(turned, SCHEMAS["copy_orders"]).write.parquet(f"{tmp_path}/copy_orders.parquet")
    spark.createDataFrame([("BTC", s, 1.0, 1.0, 10.0 + s, 1) for s in range(0, 90_000, 7_000)], SCHEMAS["proxy"]).write.parquet(f"{tmp_path}/proxy.parquet")
    ours, theirs, _, diff = compare(spark, str(tmp_path), "episode_payments", simulating.QUERIES["episode_payments"], simulating.SQL["episode_payments"])
    assert not diff and ours == theirs > 1
