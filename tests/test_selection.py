import pytest

from tideline.functions.timeops import DAY_MS
from tideline.operators import selection as sel
from tideline.operators.choosing import failed, funnel
from tideline.sources.tables import SCHEMAS


def fills(spark, *rows):
    """(address, coin, kind, time_ms, px, sz)"""
    fields = [f.name for f in SCHEMAS["fills"].fields]
    return spark.createDataFrame([tuple({"address": a, "seq": i, "coin": c, "kind": k, "time_ms": t, "px": p, "sz": s, "side": "B"}.get(f) for f in fields) for i, (a, c, k, t, p, s) in enumerate(rows)], SCHEMAS["fills"])


def test_proxy_check_by_hand(spark):
    """18 fills at 128, one at 129, one at 256 against 128: rank 19 of 20 is 78.125 bps, and the limit is inclusive."""
    f = fills(spark, *[("w", "C", "perp", i * 1000, px, 1.0) for i, px in enumerate([128.0] * 18 + [129.0, 256.0])], ("w", "C", "perp", 99_000, 128.0, 1.0), ("w", "C", "perp", 5_000, None, 1.0), ("w", "D", "perp", 0, 1.0, 1.0), ("w", None, "perp", 0, 1.0, 1.0))
    proxy = spark.createDataFrame([("C", i, 128.0, 128.0, 128.0, 1) for i in range(20)] + [("C", 3, 1.0, 1.0, 0.0, 1), ("D", 0, 1.0, 1.0, None, 1)], SCHEMAS["proxy"])
    got = {r.coin: r for r in sel.proxy_check(f, proxy, 95, 78.125, 0.0).collect()}
    c = got["C"]
    assert (c.compared, c.skipped, c.deviation_bps, c.level_bps, c.shift_bps, c.valid) == (20, 2, 78.125, 0.0, 0.0, True)
    assert (got["D"].compared, got["D"].skipped, got["D"].deviation_bps, got["D"].valid) == (0, 1, None, False)
    assert not sel.proxy_check(f, proxy, 95, 78.0, 0.0).where("coin = 'C'").first().valid
    assert sel.proxy_check(f.limit(0), proxy).count() == 0


def test_levels_are_means_of_the_two_central(spark):
    days = [(0, 127.0), (DAY_MS, 128.0), (DAY_MS + 1000, 129.0), (2 * DAY_MS, 256.0)]
    f = fills(spark, *[("w", "C", "perp", t, p, 1.0) for t, p in days])
    proxy = spark.createDataFrame([("C", t // 1000, 1.0, 1.0, 128.0, 1) for t, _ in days], SCHEMAS["proxy"])
    assert sorted((r.day, r.n, r.median_bps) for r in sel.day_levels(sel.compared(f, proxy)).collect()) == [(0, 1, -78.125), (1, 2, 39.0625), (2, 1, 10000.0)]
    assert sel.proxy_check(f, proxy).first().shift_bps == 10078.125


def test_universe_takes_the_first_condition_that_fails(spark):
    assets = spark.createDataFrame([("a", 900, 50, True), ("b", 800, 50, False), ("c", 700, 5, True), ("d", 700, 50, True), ("e", 600, 50, True), ("f", 500, 50, True), ("g", 400, 50, True)], "coin string, cents long, n_fills long, meets_i boolean")
    checks = spark.createDataFrame([("a", True), ("c", True), ("d", False), ("e", True), ("f", True), ("g", True)], "coin string, valid boolean")
    costs = spark.createDataFrame([("a",), ("a",), ("f",)], "coin string")
    got = {r.coin: (r.place, r.excluded_by) for r in sel.form_universe(assets, checks, costs, 5, 10).collect()}
    assert got == {"a": (1, None), "b": (None, "i"), "c": (2, "iii"), "d": (3, "iv"), "e": (4, "v"), "f": (5, None), "g": (6, "ii")}
    walk = {r.coin: r.met_before for r in sel.market_walk(assets, 2, ["g"]).collect()}
    assert walk == {"a": 0, "b": 1, "c": 1, "g": 5}
    decisions = sel.form_universe(assets, checks, costs, 5, 10)
    f = fills(spark, ("w", "a", "perp", 0, 10.0, 1.0), ("w", "x", "spot", 0, 20.0, 1.0), ("v", "a", "perp", 0, 99.0, 1.0))
    wallets = spark.createDataFrame([("w",), ("w",)], "address string")
    assert tuple(sel.universe_cover(decisions, f, wallets).first()) == (1400, 3000, 1000, 1400 / 3000, 1.4)
    assert tuple(sel.universe_cover(decisions.limit(0), f.limit(0), wallets).first()) == (0, 0, 0, None, None)


def test_candidates_need_every_day(spark):
    f = fills(spark, ("w", "a", "perp", 0, 1.0, 2.0), ("w", "a", "perp", 0, None, 2.0), ("w", "b", "perp", 0, 1.0, 1.0), ("w", "h:x", "hip3", 0, 1.0, 1.0), ("other", "a", "perp", 0, 5.0, 5.0), ("w", None, "perp", 0, 5.0, 5.0))
    days = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("a", 9, True)], "coin string, day long, found boolean")
    got = sel.candidates(f, spark.createDataFrame([("w",)], "address string"), days, 1, 2)
    assert sorted(map(tuple, got.collect())) == [("a", 200, 2, True), ("b", 100, 1, False)]


FACTS = {"role": "user", "account_value": 20_000.0, "coverage_ok": True, "n_fills": 10, "invalid_perp_fills": 0, "n_breaks": 0, "unreconciled_episodes": 0, "max_divergence_bps": None, "closed_episodes": 30, "active_blocks": 8, "median_duration_ms": 3.6e6, "taker_share": 0.5, "median_open": 3, "universe_share": 0.8, "liquidated_fills": 0}
KIND = "role string, account_value double, coverage_ok boolean, n_fills long, invalid_perp_fills long, n_breaks long, unreconciled_episodes long, max_divergence_bps double, closed_episodes long, active_blocks long, median_duration_ms double, taker_share double, median_open long, universe_share double, liquidated_fills long, exposure double"


def test_every_filter(spark):
    change = [{}, {"role": "vault"}, {"account_value": None}, {"n_breaks": 1}, {"max_divergence_bps": 10.1}, {"closed_episodes": 19}, {"active_blocks": 5}, {"median_duration_ms": None}, {"taker_share": 0.49}, {"median_open": 4}, {"universe_share": None}, {"liquidated_fills": 1}, {"role": None, "coverage_ok": False}]
    data = [tuple((FACTS | {"exposure": None if i == 0 else 5.0} | c)[k.split()[0]] for k in KIND.split(", ")) for i, c in enumerate(change)]
    df = spark.createDataFrame(data, KIND).coalesce(1)
    got = [r.f for r in df.select(failed(sel.filters(sel.Limits())).alias("f")).collect()]
    assert got == [[], ["F1"], ["F2"], ["F3"], ["F3"], ["F4"], ["F5"], ["F6"], ["F7"], ["F8"], ["F9"], ["F10"], ["F3", "F1"]]
    stages = [(r.stage, r.entered, r.removed) for r in funnel(df, [*sel.filters(sel.Limits()), sel.reference_stage()]).orderBy("stage_no").collect()]
    assert stages == [("F2", 13, 1), ("F3", 12, 3), ("F4", 9, 1), ("F5", 8, 1), ("F6", 7, 1), ("F7", 6, 1), ("F8", 5, 1), ("F9", 4, 1), ("F10", 3, 1), ("F1", 2, 1), ("N*", 1, 1)]
    with pytest.raises(ValueError):
        sel.filters(sel.Limits(), ("F1", "F2"))


def test_pool_growth():
    assert [sel.pool_growth(e, 1, 250, 100, 10) for e in (10, 9)] == [("enough", None), ("grow", 1)]
    assert sel.pool_growth(0, 3, 250, 100, 10) == ("exhausted", None)
