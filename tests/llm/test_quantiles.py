import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm.quantiles import Quantiles, median, merge, percentile, reached, thin


def exact_error(sorted_values, value, rank):
    """Distance of ``rank`` from the ranks that ``value`` has."""
    low, high = np.searchsorted(sorted_values, value, "left") + 1, np.searchsorted(sorted_values, value, "right")
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("seed", range(4))
def test_merged_intervals_hold_true_ranks(seed):
    rng = np.random.default_rng(seed)
    parts, values = [], []
    for _ in range(rng.integers(2, 9)):
        v = np.sort(rng.integers(0, 400, rng.integers(1, 3000)).astype(float))
        r = np.arange(1, len(v) + 1)
        k = thin(v, r, r, len(v), 0.01)
        parts.append((len(v), v[k], r[k], r[k]))
        values.append(v)
    alls = np.sort(np.concatenate(values))
    n, err, v, lo, hi = merge(parts, 0.02)
    assert n == len(alls) and v[0] == alls[0] and v[-1] == alls[-1]
    low, high = np.searchsorted(alls, v, "left") + 1, np.searchsorted(alls, v, "right")
    assert ((lo <= high) & (hi >= low)).all() and (lo <= hi).all()
    assert err <= 0.02 * n + 1 and err == reached(lo, hi)
    for rank in range(1, n + 1, 37):
        best = v[np.argmin(np.maximum(rank - lo, hi - rank))]
        assert exact_error(alls, best, rank) <= err


def test_few_values_are_exact():
    parts = [(3, np.array([1.0, 2, 9]), np.arange(1, 4), np.arange(1, 4)), (2, np.array([2.0, 5]), np.arange(1, 3), np.arange(1, 3))]
    n, err, v, lo, hi = merge(parts, 0.001)
    assert (n, err, v.tolist(), lo.tolist(), hi.tolist()) == (5, 0, [1, 2, 2, 5, 9], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5])


@pytest.mark.parametrize("fan_in", [2, 1024])
def test_bound_holds_over_partitions_and_days(spark, fan_in):
    rng = np.random.default_rng(5)
    data = [(("hot" if i % 3 else "cold"), int(i % 4), float(x)) for i, x in enumerate(rng.lognormal(size=40_000))]
    df = spark.createDataFrame(data, "k string, day int, x double").repartition(9)
    q = Quantiles(["k", "day"], eps=0.005, fan_in=fan_in)
    days = q.combined(q.summaries(df, F.col("x")))
    for keys, got in ((["k", "day"], days), (["k"], q.combined(days, ["k"]))):
        for r in got.select(*keys, "n", "err", *(percentile(p).alias(f"p{p}") for p in (1, 50, 99))).collect():
            own = np.sort([x for k, d, x in data if k == r.k and ("day" not in keys or d == r.day)])
            assert r.n == len(own) and r.err <= 0.005 * r.n + 1
            for p in (1, 50, 99):
                assert exact_error(own, r[f"p{p}"], max(1, -(-r.n * p // 100))) <= r.err


def test_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), (None, 4.0), ("b", None), ("a", 3.0)], "k string, v double")
    q = Quantiles(["k"])
    got = q.combined(q.summaries(df, F.col("v"))).select("k", "n", median().alias("m"), percentile(99).alias("p")).collect()
    assert sorted(map(tuple, got), key=str) == [("a", 4, 1.5, 3.0), (None, 1, 4.0, 4.0)]
    assert q.combined(q.summaries(df.limit(0), F.col("v"))).count() == 0
