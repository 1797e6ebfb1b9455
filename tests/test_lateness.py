import random

from tideline.operators.lateness import LatePeriods
from tideline.session import shared_path

P = 100


def brute(rows):
    """Outcome of each row by looking at every earlier arrival."""
    out = []
    for k, e, r, v in rows:
        if e is None or r is None:
            continue
        m = max((e2 for k2, e2, r2, _ in rows if k2 == k and e2 is not None and r2 is not None and r2 < r), default=None)
        h = e // P * P
        late = None if m is None or m < h + P else m - (h + P)
        out.append((k, h, "on_time" if late is None else "corrected" if late <= 2 * P else "dropped", v))
    return sorted(out, key=str)


def sample(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        recv = i // 2 * 9
        rows.append((rng.choice(["a", "b", None]), recv + rng.choice([0, -3, -60, -200, -420, P - recv % P]), recv, float(i)))
    rows += [("a", None, 5, 1.0), ("a", 5, None, 1.0), rows[3], rows[3]]
    return rows


def late():
    return LatePeriods(["key"], "event", "recv", ["v"], period_ms=P, cutoff_ms=2 * P, batch_ms=50)


def test_against_brute_force(spark):
    for seed in range(3):
        rows = sample(seed)
        df = spark.createDataFrame(rows, "key string, event long, recv long, v double")
        got = [(r.key, r.period_ms, r.outcome, r.v_v) for r in late().judge_all(df).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_deliveries_one_by_one(spark):
    rows = [r for r in sample(5) if r[1] is not None and r[2] is not None]
    op, store = late(), shared_path(spark, "late")
    schema = "key string, event long, recv long, v double"
    for low in range(0, 800, 250):
        part = [r for r in rows if low <= r[2] < low + 250]
        for _ in range(2):  # as after a failure
            partials = op.ingest(spark, store, spark.createDataFrame(part, schema), low)
    whole = op.partials(op.judge_all(spark.createDataFrame(rows, schema)))
    pick = lambda df: sorted((tuple(r) for r in op.combine(df).collect()), key=str)
    assert pick(partials) == pick(whole)


def test_empty(spark):
    df = spark.createDataFrame([], "key string, event long, recv long, v double")
    op = late()
    assert op.combine(op.partials(op.judge_all(df))).count() == 0
