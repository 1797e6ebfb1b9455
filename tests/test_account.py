"""Ledger operators against a row-by-row model, and hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import account as acc
from tideline.operators.stats import level_changes, nearest_ranks, step_levels, weighted_percentile
from tideline.sources.tables import SCHEMAS

LOT = 0.01


def fill(seq, t, coin="BTC", px=100.0, sz=1.0, side="B", start=0.0, crossed=True, pnl=0.0, address="w", kind=None, twap=None):
    return (address, seq, t, coin, kind or ("hip3" if ":" in coin else "perp"), px, sz, side, start, None, crossed, pnl, 0.0, 1, 1, twap, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMAS["fills"])


def ledger(seed, n=150):
    """Random trading of two coins with breaks, turns, sub-lot rests and busy milliseconds."""
    rng = random.Random(seed)
    pos, rows, t = {"BTC": 0.0, "x:E": 3.0}, [], 0
    for seq in range(n):
        coin = rng.choice(sorted(pos))
        t += rng.choice([0, 0, 1, 40_000_000])
        start = pos[coin]
        if rng.random() < 0.08:
            start = rng.choice([0.0, -start, start + 1, 0.004])
        side = rng.choice("AB")
        size = rng.choice([1.0, 2.0, abs(start) or 1.0, 0.5, 0.01])
        rows.append(fill(seq, t, coin, 100.0 + seq % 7, size, side, start, rng.choice([True, False, None])))
        pos[coin] = round(start + (size if side == "B" else -size), 10)
    return rows


def model(rows):
    """Episodes by walking one row at a time: what is open, on which side, and what each row does to it."""
    done = []
    sgn = lambda x: (x > 0) - (x < 0)
    for coin in sorted({r[3] for r in rows}):
        run, last = None, None
        for _, seq, t, _, kind, px, sz, side, start, _, crossed, *_ in sorted((r for r in rows if r[3] == coin), key=lambda r: (r[2], r[1])):
            near = LOT / 2 if kind == "perp" else 1e-9 * sz
            end = start + (sz if side == "B" else -sz)
            b, a = (0.0 if abs(x) < near else x for x in (start, end))
            room = LOT * (1 + 1e-9) if kind == "perp" else 1e-9 * max(abs(last or 0), sz)
            broke = last is not None and abs(start - last) > room
            last, way = a, sgn(end - start)
            if run and (b == 0 or sgn(b) != run["side"]):
                done.append(run | {"closed": t, "broken": True})
                run = None
            elif run and broke:
                run["broken"] = True
            if not run and b != 0:
                run = dict(coin=coin, opened=t, side=sgn(b), flat=False, broken=broke, traded=0.0, opening=0.0, taker=0.0, n=0, closed=None)
            adds = b == 0 or sgn(b) == way
            turns = not adds and a != 0 and sgn(a) != sgn(b)
            pieces = [(True, sz)] if adds else [(False, abs(b) if a == 0 or turns else sz)] + [(True, abs(a))] * turns
            for opening, size in pieces:
                if not run:
                    run = dict(coin=coin, opened=t, side=way if adds else sgn(a), flat=True, broken=False, traded=0.0, opening=0.0, taker=0.0, n=0, closed=None)
                run["traded"] += size * px
                run["opening"] += size * px * opening
                run["taker"] += size * px * (opening and bool(crossed))
                run["n"] += 1
                if not opening and (a == 0 or turns):
                    done.append(run | {"closed": t})
                    run = None
        if run:
            done.append(run)
    return sorted(((e["coin"], e["opened"], e["closed"], e["side"], e["flat"], e["broken"], round(e["traded"], 6), round(e["opening"], 6), round(e["taker"], 6), e["n"]) for e in done), key=str)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("bucket", [40_000_000, 10**12])
def test_episodes_like_a_row_by_row_walk(spark, seed, bucket):
    rows = ledger(seed)
    steps = acc.steps(frame(spark, rows + rows[:5]), bucket_ms=bucket)
    got = acc.episodes(acc.parts(steps), bucket).collect()
    flat = sorted(((r.coin, r.opened, r.closed, r.side, r.opened_from_flat, r.broken, round(r.traded_notional, 6), round(r.opening_notional, 6), round(r.opening_taker_notional, 6), r.n_fills) for r in got), key=str)
    assert flat == model(rows)


def test_one_event_per_millisecond(spark):
    rows = [fill(i, 5, px=100.0 + i, sz=0.5, start=i * 0.5) for i in range(256)] + [fill(256, 5, "ETH")]
    got = {r.coin: r for r in acc.events(acc.steps(frame(spark, rows))).collect()}
    assert (got["BTC"].position, got["BTC"].px, got["BTC"].notional, got["BTC"].n_fills) == (128.0, 355.0, 29120.0, 256)


def test_breaks_and_unusable_fills(spark):
    rows = [fill(0, 1), fill(1, 2, start=1.005), fill(2, 3, start=5.0), fill(3, 4, px=None), fill(4, 5, side="X"), fill(5, 6, kind="spot"), fill(6, None), fill(7, 7, coin=None, kind="perp")]
    df = frame(spark, rows)
    assert [(r.t, r.prev_t, r.declared) for r in acc.breaks(acc.steps(df)).collect()] == [(3, 2, 5.0)]
    assert [r.n_ignored for r in acc.ignored(df).collect()] == [2]


def test_pnl_of_a_whole_episode(spark):
    rows = [fill(0, 1, px=100.0, sz=2.0), fill(1, 2, px=110.0, sz=1.0, side="A", start=2.0, pnl=10.0), fill(2, 3, px=90.0, sz=1.0, side="A", start=1.0, pnl=-9.0)]
    parts = acc.parts(acc.steps(frame(spark, rows)))
    got = acc.pnl_divergence(acc.episodes(parts)).collect()
    assert [round(r.divergence_bps, 9) for r in got] == [round(1.0 / 400.0 * 1e4, 9)]


def test_turning_fill_reports_for_the_closing_episode(spark):
    rows = [fill(0, 1, px=100.0), fill(1, 2, px=110.0, sz=2.0, side="A", start=1.0, pnl=10.0), fill(2, 3, px=100.0, sz=1.0, start=-1.0, pnl=10.0)]
    parts = acc.parts(acc.steps(frame(spark, rows)))
    assert [round(r.divergence_bps, 9) for r in acc.pnl_divergence(acc.episodes(parts)).collect()] == [0.0, 0.0]


def test_residue_counts_at_average_cost(spark):
    """Half a lot off: 2 opened at 100 and 110, 1.996 closed at 120."""
    rows = [fill(0, 1, px=100.0), fill(1, 2, px=110.0, start=1.0), fill(2, 3, px=120.0, sz=1.996, side="A", start=2.0, pnl=1.996 * 15)]
    got = acc.pnl_divergence(acc.episodes(acc.parts(acc.steps(frame(spark, rows))))).collect()
    assert [round(r.divergence_bps, 6) for r in got] == [0.0]


def exposure(spark, rows, pct, hours):
    cents = lambda c: F.floor(F.abs(F.col(c)) * F.col("px") * 100 + 0.5).cast("long")
    steps = acc.steps(frame(spark, rows))
    changes = level_changes(steps, ["address"], "coin", "time_ms", ["seq"], cents("before"), cents("after"), 0)
    levels = step_levels(changes, ["address"], "t", "delta", 0, hours * 3_600_000)
    got = [(r.x / 100, r.weight / 3_600_000) for r in weighted_percentile(levels, ["address"], "level", "weight", pct, "x").collect()]
    assert [(r.exposure, r.hours) for r in acc.exposure(steps, 0, hours * 3_600_000, pct).collect()] == got  # two ways to the same
    return got


def test_exposure_over_time(spark):
    h = 3_600_000
    rows = [fill(0, 0, px=100.0), fill(1, 10 * h, px=110.0, start=1.0), fill(2, 20 * h, px=120.0, sz=2.0, side="A", start=2.0)]
    assert exposure(spark, rows, 95, 50) == [(220.0, 20.0)]
    assert exposure(spark, rows, 50, 50) == [(100.0, 20.0)]
    assert exposure(spark, [fill(0, 10 * h, px=105.0, side="A", start=1.0)], 95, 50) == [(105.0, 10.0)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", v) for v in [0.0] * 18 + [78.125, 10_000.0]] + [("b", None)], "k string, v double")
    assert [tuple(r) for r in nearest_ranks(df, ["k"], F.col("v"), [50, 95, 100]).collect()] == [("a", 20, 0.0, 78.125, 10_000.0)]


def test_empty(spark):
    steps = acc.steps(frame(spark, []))
    parts = acc.parts(steps)
    assert acc.events(steps).count() == acc.episodes(parts).count() == acc.pnl_divergence(acc.episodes(parts)).count() == 0


def test_lots(spark):
    meta = spark.createDataFrame([("a", 0), ("b", 2), ("c", None)], "coin string, sz_decimals long")
    assert {r.coin: r.lot for r in acc.lots_from_meta(meta).collect()} == {"a": 1.0, "b": 0.01, "c": None}
