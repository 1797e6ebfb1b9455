import random

import pytest

from tideline.operators.intervals import Intervals, common

SCHEMA = "coin string, start_ms long, end_ms long, key long, bucket string, s string"


def merged(rows):
    """Unions of touching intervals per key, and whether several different ones made them."""
    out = []
    for coin in sorted({r[0] for r in rows}):
        run = []
        for a, b in sorted({(a, b) for c, a, b in rows if c == coin and b > a}):
            if run and a <= run[-1][1]:
                run[-1] = [run[-1][0], max(run[-1][1], b), True]
            else:
                run.append([a, b, False])
        out += [(coin, *r) for r in run]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), s := rng.randrange(-300, 3000), s + rng.choice([0, -5, 1, 7, 100, 100, 350])) for _ in range(250)]
    rows += rows[:40]
    iv = Intervals(frame(spark, rows), "coin", "start_ms", "end_ms", bucket_ms=100)
    want = merged(rows)
    assert sorted(map(tuple, iv.periods().collect())) == sorted(want)
    gaps = [(a[0], a[2], b[1]) for a, b in zip(want, want[1:]) if a[0] == b[0]]
    assert sorted(map(tuple, iv.gaps().collect())) == sorted(gaps)
    totals = {}
    for c, a, b, _ in want:
        for t in range(a, b):
            totals[c, t // 100] = totals.get((c, t // 100), 0) + 1
    assert {(r.key, r.bucket): r.total_ms for r in iv.totals().collect()} == totals


def test_border_cases(spark):
    day = 100
    rows = [("a", 50, day), ("a", day, 150), ("b", 20, day), ("b", 130, 140), ("c", 0, 350), ("c", 0, 350)]
    iv = Intervals(frame(spark, rows), "coin", "start_ms", "end_ms", day)
    assert sorted(map(tuple, iv.periods().collect())) == [("a", 50, 150, True), ("b", 20, 100, False), ("b", 130, 140, False), ("c", 0, 350, False)]
    assert [tuple(r) for r in iv.gaps().collect()] == [("b", 100, 130)]


def test_nulls_and_empty(spark):
    df = frame(spark, [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 3, 3)])
    for d in (df, df.limit(0)):
        iv = Intervals(d, "coin", "start_ms", "end_ms", 10)
        assert iv.periods().count() == iv.gaps().count() == iv.totals().count() == 0


def test_common(spark):
    a = Intervals(frame(spark, [("x", 0, 250), ("y", 0, 10)]), "coin", "start_ms", "end_ms", 100)
    b = Intervals(frame(spark, [("x", 50, 260), ("x", 300, 310), ("y", 10, 20)]), "coin", "start_ms", "end_ms", 100)
    assert [tuple(r) for r in common(a, b).collect()] == [("x", 50, 250)]
