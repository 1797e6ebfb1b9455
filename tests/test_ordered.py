import bisect
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators.ordered import Runs, as_of, exists_between


def sample(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.randrange(-50, 900), i, float(rng.randrange(5))) for i in range(n)]


@pytest.mark.parametrize("bucket", [10, 10_000])
def test_previous_following_running(spark, bucket):
    rows = sample(1)
    df = spark.createDataFrame([*rows, ("a", None, 999, 1.0)], "k string, t long, i long, v double")
    runs = Runs(df, ["k"], "t", ["i"], bucket)
    want_p, want_n, want_s = {}, {}, {}
    for k in ("a", "b", None):
        run = sorted(r[1:] for r in rows if r[0] == k)
        for j, (_, i, _) in enumerate(run):
            want_p[i] = run[j - 1][1] if j else None
            want_n[i] = run[j + 1][1] if j + 1 < len(run) else None
            want_s[i] = sum(x[2] for x in run[: j + 1])
    assert {r.i: r.prev_i for r in runs.previous(["i"]).collect()} == want_p
    assert {r.i: r.next_i for r in runs.following(["i"]).collect()} == want_n
    assert {r.i: r.s for r in runs.running(s=F.col("v")).collect()} == want_s


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [7, 10_000])
def test_as_of(spark, forward, strict, bucket):
    left, right = sample(2), sample(3)
    times = {k: sorted({r[1] for r in right if r[0] == k}) for k in ("a", "b", None)}

    def want(k, t):
        ts = times[k]
        if forward:
            j = (bisect.bisect_right if strict else bisect.bisect_left)(ts, t)
            return ts[j] if j < len(ts) else None
        j = (bisect.bisect_left if strict else bisect.bisect_right)(ts, t)
        return ts[j - 1] if j else None

    schema = "k string, t long, i long, v double"
    out = as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "t", "t", ["v"], forward, strict, bucket)
    got = {r.i: (r.r_t, r.r_v) for r in out.collect()}
    assert {i: x[0] for i, x in got.items()} == {i: want(k, t) for k, t, i, _ in left}
    best = min if forward else max
    assert all(x[1] == best(r[3] for r in right if r[0] == k and r[1] == x[0]) for k, _, i, _ in left for x in [got[i]] if x[0] is not None)


def test_exists_between(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 6, 8), ("b", 1, 5), ("a", None, 5)], "k string, lo long, hi long")
    right = spark.createDataFrame([("a", 5), ("b", 6)], "k string, t long")
    got = exists_between(left, right, ["k"], "lo", "hi", "t", "yes").collect()
    assert sorted((r.k, str(r.lo), r.yes) for r in got) == [("a", "1", True), ("a", "6", False), ("a", "None", False), ("b", "1", False)]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long, i long, v double")
    assert as_of(df, df, ["k"], "t", "t", ["v"]).count() == 0
    assert Runs(df, ["k"], "t", ["i"]).running(s=F.col("v")).count() == 0
