import random

import numpy as np
import pytest

from tideline.operators.snapshots import SnapshotDiff, hash_long

SCHEMA = "b long, t long, k1 string, k2 long, x double, y string, bucket int, at string"


def brute(rows, listed=()):
    by = {}
    for b, t, *r in rows:
        if b is not None and t is not None:
            by.setdefault(b, {}).setdefault(t, {}).setdefault(tuple(r[:2]), set()).add(repr([None if v is None else "nan" if v != v else v + 0.0 if isinstance(v, float) else v for v in r[2:]]))
    for b, t in listed:
        by.setdefault(b, {}).setdefault(t, {})
    out = []
    for b, ts in by.items():
        order = sorted(ts)
        for p, n in zip(order, order[1:]):
            for k in set(ts[p]) | set(ts[n]):
                if ts[p].get(k) != ts[n].get(k):
                    out.append((b, n, *k, "added" if k not in ts[p] else "removed" if k not in ts[n] else "changed"))
    return sorted(out, key=str)


def sample(seed, n=300):
    rng = random.Random(seed)
    rows, state = [], {(f"a{i % 7}", i): [float(i), "v"] for i in range(n)}
    state["", None] = [None, None]
    state[None, 3] = [float("nan"), ""]
    for t in range(4):
        for k, v in state.items():
            rows += [(1, t, *k, *v, 0, "z")] * (1 + (rng.random() < 0.05))
        for k in rng.sample(sorted(state, key=str), 40):
            what = rng.random()
            if what < 0.3:
                del state[k]
            else:
                state[k] = [rng.choice([None, float("nan"), -0.0, 0.0, 1.0]), rng.choice([None, "", "w"])]
        state[f"n{t}", t] = [0.5, "n"]
    rng.shuffle(rows)
    return rows + [(2, 5, "only", 1, 1.0, "", 0, ""), (None, 5, "q", 1, 1.0, "", 0, ""), (1, None, "q", 1, 1.0, "", 0, "")]


@pytest.mark.parametrize("seed,buckets,cells,rounds", [(0, 64, 192, 4), (1, 400, 12, 3), (2, 400, 3, 1)])
def test_against_brute_force(spark, seed, buckets, cells, rounds):
    """Roomy tables, tables that must be enlarged, and tables that never come out and are compared pair by pair."""
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    listed = spark.createDataFrame([(2, 9), (1, 0), (2, 9)], "b long, t long")
    got = SnapshotDiff(df, "b", "t", ["k1", "k2"], listed, bucket_keys=buckets, cells=cells, rounds=rounds).changes()
    assert got.columns == ["b", "t", "k1", "k2", "change"]
    assert sorted(((int(r.b), *tuple(r)[1:]) for r in got.collect()), key=str) == brute([r[:6] for r in rows], [(2, 9)])


def test_zero_and_minus_zero_are_one(spark):
    df = spark.createDataFrame([(1, 0, "a", 1, 0.0, "", 0, ""), (1, 1, "a", 1, -0.0, "", 0, ""), (1, 2, "a", 1, float("nan"), "", 0, ""), (1, 3, "a", 1, float("nan"), "", 0, "")], SCHEMA)
    got = SnapshotDiff(df, "b", "t", ["k1", "k2"]).changes().collect()
    assert [(r.t, r.change) for r in got] == [(2, "changed")]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert SnapshotDiff(df, "b", "t", ["k1", "k2"]).changes().count() == 0


def test_hash_is_the_jvms(spark):
    x = [0, 1, -1, 2**62, -(2**63), 1234567890123]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x long").selectExpr("xxhash64(x)").collect()]
    assert hash_long(np.array(x), 42).view(np.int64).tolist() == want
