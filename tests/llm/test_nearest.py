import random

import pytest

from tideline.llm.nearest import nearest


@pytest.mark.parametrize("tolerance,tick", [(3, None), (3, 1), (25, None), (25, 7), (400, None), (400, 1000), (400, 90)])
def test_against_brute_force(spark, tolerance, tick):
    rng = random.Random(tolerance)
    right = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-300, 2000)]), "r") for _ in range(150)]
    right += right[:20]
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(-400, 2100)]), 0, "x") for i in range(200)] + [(7, "a", 5, 0, "x")] * 2
    want = []
    for i, c, t, *_ in left:
        near = [u for e, u, _ in right if c is not None and e == c and t is not None and u is not None and abs(u - t) <= tolerance]
        if near:
            want.append((i, min(near, key=lambda u: (abs(u - t), u))))
    df = spark.createDataFrame(left, "i int, coin string, t long, tick long, inside string")
    got = nearest(df, spark.createDataFrame(right, "coin string, t long, before string"), "coin", "t", "coin", "t", tolerance, tick_ms=tick)
    assert got.columns == ["i", "coin", "t", "tick", "inside", "nearest_ms"]
    assert sorted((r.i, r.nearest_ms) for r in got.collect()) == sorted(want)


def test_tie_takes_the_earlier(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20)], "c string, t long")
    right = spark.createDataFrame([("a", 5), ("a", 15), ("a", 25)], "c string, t long")
    assert sorted((r.t, r.nearest_ms) for r in nearest(left, right, "c", "t", "c", "t", 5).collect()) == [(10, 5), (20, 15)]


def test_empty(spark):
    df = spark.createDataFrame([], "c string, t long")
    assert nearest(df, df, "c", "t", "c", "t", 5).count() == 0


def test_names_of_ours_may_be_theirs(spark):
    left = spark.createDataFrame([("a", 10, 1, 2, 3, 4, 5)], "e_ string, t_ long, l_ int, b_ int, best_ int, place_ int, tick_ int")
    right = spark.createDataFrame([("a", 12, 9), ("a", 40, 9)], "entity_ string, t long, inside_ int")
    assert [tuple(r) for r in nearest(left, right, "e_", "t_", "entity_", "t", 5).collect()] == [("a", 10, 1, 2, 3, 4, 5, 12)]
