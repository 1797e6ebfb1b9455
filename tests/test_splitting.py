"""Cut and uncut ways give the same, and a hot key is really cut."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.search import FEW, count_upto
from tideline.functions.timeops import DAY_MS, HOUR_MS
from tideline.operators.account import KEYS, Measures, steps, usable
from tideline.operators.curves import average_cost, cost_fold, drawdowns, order_runs, together
from tideline.operators.ordered import BUCKET, UNCUT, Runs, split_ms
from tideline.operators.stats import interpolated, nearest_ranks, ratio_summary, weighted_percentile
from tideline.sources.tables import SCHEMAS


def rows(df):
    return sorted((tuple(repr(v) for v in r) for r in df.collect()), key=str)


def test_width_follows_from_the_busiest_run(spark):
    df = spark.createDataFrame([("a", i * HOUR_MS) for i in range(240)] + [("b", 5), ("b", None)], "k string, t long")
    assert split_ms(df, ["k"], "t", share=0, least=240) == UNCUT
    assert split_ms(df, ["k"], "t", share=0, least=72) == 3 * DAY_MS  # three days of 24 rows fit
    assert split_ms(df, ["k"], "t", share=0, least=5) == HOUR_MS
    assert split_ms(df, ["k"], "t", share=0.5, least=1) == 5 * DAY_MS
    assert split_ms(df.limit(0), ["k"], "t") == UNCUT


def test_cut_runs_are_the_uncut_ones(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-50, 400)]), i, rng.choice([None, rng.randrange(9)])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t long, n long, v long")
    made = lambda w: Runs(df, ["k"], "t", ["n"], w).annotate(previous=["n"], following=["v"], running={"s": F.col("v")}, highest={"m": F.col("v")}, whole={"w": F.col("v")})
    assert rows(made(UNCUT)) == rows(made(7)) == rows(made(10_000))


def test_histograms_in_pieces(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 6 + ["cold", None]), rng.choice([None, -1.5, 0.0, 7.0, rng.gauss(100, 1), rng.gauss(0, 1e6)]), rng.randrange(0, 5)) for _ in range(900)]
    df = spark.createDataFrame(data, "k string, v double, w long")
    cut = {"pieces": 16, "least": 0}
    assert rows(nearest_ranks(df, ["k"], F.col("v"), [1, 50, 95, 100])) == rows(nearest_ranks(df, ["k"], F.col("v"), [1, 50, 95, 100], **cut))
    assert rows(interpolated(df, ["k"], F.col("v"), {"a": 0.5, "b": 0.9})) == rows(interpolated(df, ["k"], F.col("v"), {"a": 0.5, "b": 0.9}, **cut))
    assert rows(weighted_percentile(df, ["k"], "v", "w", 95, "p")) == rows(weighted_percentile(df, ["k"], "v", "w", 95, "p", **cut))
    assert rows(ratio_summary(df, F.col("v"), 7.0)) == rows(ratio_summary(df, F.col("v"), 7.0, **cut))
    by = {}
    for k, v, _ in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    for r in interpolated(df, ["k"], F.col("v"), {"a": 0.5}, **cut).collect():
        v = sorted(by[r.k])
        assert r.n == len(v) and math.isclose(r.a, (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, rel_tol=1e-12)
    empty = ratio_summary(df.limit(0), F.col("v"), 1.0).first()
    assert empty.n == 0 and empty["median"] is None and empty.share_above is None


def test_average_cost_over_buckets(spark):
    rng = random.Random(8)
    data, size = [], {}
    for i in range(400):
        k = rng.choice("abc")
        change = rng.choice([-1, 1, 2, -2]) if size.get(k, 0) else rng.choice([1, -1])
        if size.get(k, 0) * (size.get(k, 0) + change) < 0:
            change = -size[k]
        size[k] = size.get(k, 0) + change
        data.append((k, i * 10, i, float(rng.randrange(90, 110)), float(change)))
    df = spark.createDataFrame(data, "k string, t long, n long, px double, change double")
    want = {}
    for k, _, _, px, d in data:
        s, c, g = want.get(k, (0.0, 0.0, 0.0))
        if abs(s + d) > abs(s):
            want[k] = (s + d, (s * c + d * px) / (s + d), g)
        else:
            want[k] = (s + d, c, g - d * (px - c))
    for width in (UNCUT, 50, 1_000_000):
        got = {r.k: r for r in cost_fold(df, ["k"], "t", ["n"], "px", "change", 1e-9, width).collect()}
        for k, (s, c, g) in want.items():
            assert math.isclose(got[k]["size"], s, abs_tol=1e-9) and math.isclose(got[k].realized, g, rel_tol=1e-9, abs_tol=1e-6)
            assert not s or math.isclose(got[k].cost, c, rel_tol=1e-9)
    o = df.select("k", "t", "n", F.col("px").alias("price"), F.col("change").alias("signed"))
    runs = order_runs(o, ["k"], "t", ["n"], F.col("signed"), 50)
    pick = lambda w: sorted((r.k, r.episode, r.n_parts, round(r.realized, 6), round(r["size"], 6)) for r in average_cost(runs, ["k"], "t", ["n"], bucket_ms=w).collect())
    assert pick(UNCUT) == pick(70) and len(pick(UNCUT)) > 3


def test_curves_cut_and_together(spark):
    rng = random.Random(2)
    data = [("r", w, t, 100.0 + rng.randrange(-20, 20)) for w in "xyz" for t in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(data, "g string, w string, t long, equity double")
    assert rows(drawdowns(df, ["g", "w"], UNCUT)) == rows(drawdowns(df, ["g", "w"], 7))
    got = {r.t: r.equity for r in together(df, ["g"], "w", 9).collect()}
    for t in {t for _, _, t, _ in data}:
        last = [max((u, e) for _, w2, u, e in data if w2 == w and u <= t)[1] for w in "xyz" if any(w2 == w and u <= t for _, w2, u, _ in data)]
        assert math.isclose(got[t], sum(last))
    assert len(got) == len({t for _, _, t, _ in data})


@pytest.fixture(scope="module")
def hot(spark):
    """One account with a third of all fills, all of them in one coin, over 60 days; twenty others."""
    fill = lambda a, i, t, side, start: (a, i, t, "BTC", "perp", 100.0 + i % 7, 1.0, side, start, True, None, 0.0, 0.0, i, i, None, None)
    data = []
    for a, n in [("hot", 1000)] + [(f"w{i}", 100) for i in range(20)]:
        gap = 60 * DAY_MS // n
        data += [fill(a, i, i * gap + 5, "B" if i % 2 == 0 else "A", float(i % 2)) for i in range(n)]
    fields = [f.name for f in SCHEMAS["fills"].fields]
    kinds = {"address": 0, "seq": 1, "time_ms": 2, "coin": 3, "kind": 4, "px": 5, "sz": 6, "side": 7, "start_position": 8, "crossed": 9, "dir": 10, "closed_pnl": 11, "fee": 12, "tid": 13, "oid": 14, "twap_id": 15, "liquidated_user": 16}
    return spark.createDataFrame([tuple(r[kinds[f]] for f in fields) for r in data], SCHEMAS["fills"])


def test_a_hot_account_is_cut(hot):
    """No bucket, and so no task's run, holds more than a few per cent of all fills."""
    width = split_ms(hot, KEYS, "time_ms", share=1 / 64, least=10)
    sizes = usable(hot, width).groupBy(*KEYS, BUCKET).count()
    assert sizes.agg(F.max("count")).first()[0] <= 3000 / 64 and sizes.where("address = 'hot'").count() > 20
    one, many = steps(hot, bucket_ms=UNCUT).drop(BUCKET), steps(hot, bucket_ms=width).drop(BUCKET)
    assert rows(one) == rows(many)


def test_measures_do_not_depend_on_the_cut(hot):
    pick = lambda m: (rows(m.facts().select(*sorted(m.facts().columns))), rows(m.exposure()))
    whole = pick(Measures(hot, 0, 61 * DAY_MS))
    assert whole == pick(Measures(hot, 0, 61 * DAY_MS, share=1 / 64, least=10))
    facts = {r.address: r for r in Measures(hot, 0, 61 * DAY_MS).facts().collect()}
    assert facts["hot"].closed_episodes == 500 and facts["hot"].n_fills == 1000 and facts["hot"].median_open == 1


def test_count_upto(spark):
    import bisect

    rng = random.Random(1)
    data = [(sorted(rng.randrange(50) for _ in range(n)), rng.randrange(-5, 55)) for n in (0, 1, 2, FEW, FEW + 1, 17, 64, 200) for _ in range(5)] + [(None, 3)]
    df = spark.createDataFrame(data, "v array<long>, k long")
    for v, k, a, b in df.select("v", "k", count_upto(F.col("v"), F.col("k")), count_upto(F.col("v"), F.col("k"), strict=True)).collect():
        assert (a, b) == (bisect.bisect_right(v or [], k), bisect.bisect_left(v or [], k))
