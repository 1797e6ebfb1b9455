"""What happens later changes nothing that was known before."""

import random

import pytest

from tideline.operators.ordered import as_of
from tideline.operators.panel import delayed, executions
from tideline.operators.storage import Cursor, LookaheadError


def test_cursor(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "t long")
    c = Cursor(0, delay_ms=2)
    assert c.view(df, "t").count() == 0
    c.advance(7)
    assert sorted(r.t for r in c.view(df, "t").collect()) == [1, 5]
    with pytest.raises(LookaheadError):
        c.advance(6)
    c.close()
    with pytest.raises(LookaheadError):
        c.advance(8)


@pytest.mark.parametrize("seed", [1, 2])
def test_later_prices_do_not_matter(spark, seed):
    rng = random.Random(seed)
    bars = [(c, s, 9.0 + rng.random(), 11.0 + rng.random(), 10.0 + rng.random()) for c in "ab" for s in sorted(rng.sample(range(7200), 800))]
    cut = 4000
    changed = [(c, s, a * 5, b * 5, x * 5) if s > cut else (c, s, a, b, x) for c, s, a, b, x in bars if s <= cut or rng.random() < 0.7]
    events = spark.createDataFrame([(i, rng.choice("ab"), rng.choice(["buy", "sell"]), rng.randrange(7_000_000)) for i in range(60)], "n int, coin string, side string, t long")
    kind = "coin string, second long, low double, high double, last double"
    out = lambda b: {(r.n, r.delay_ms): tuple(r) for r in executions(delayed(events, "t", [0, 5_000]), spark.createDataFrame(b, kind)).collect() if r.exec_t is not None and r.exec_t // 1000 <= cut}
    assert out(bars) == out(changed) and len(out(bars)) > 30
    marks = lambda b: {r.n: r["r_last"] for r in as_of(events.selectExpr("n", "coin", "t div 1000 as s"), spark.createDataFrame(b, kind), ["coin"], "s", "second", ["last"], strict=True, bucket_ms=3600).collect() if r.s <= cut}
    assert marks(bars) == marks(changed)
