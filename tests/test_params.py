import pytest

from tideline.session import shared_path
from tideline.sources import params as P
from tideline.sources import services as S
from tideline.sources.ingest import collect_pages
from tideline.sources.store import Conflict, Repository, Store

TEXT = """
selection = { start = 2013-01-01, days = 10 }
evaluation = { start = "2013-01-11", days = 5 }
capital = { unit = 5000, least = 2, most = 20, grid = [1000, 50000, 900000], groups = [2, 10, 20], primary = 50000 }
delays = { primary_s = 5.0, grid_s = [0.0, 1.5] }
archive = { quote = "USDT", exceptions = [{ coin = "X", symbol = "XY" }] }
[filters]
role = "user"
account_value = 1.0
closed_episodes = 2
active_blocks = 3
shortest_h = 0.5
longest_days = 2.0
taker_pct = 50.0
open_coins = 3
universe_pct = 80.0
liquidated_fills = 0
max_fills = 10
tolerance_bps = 10.0
"""


def test_params():
    p = P.params(TEXT)
    assert p.selection.span == (15706 * 86_400_000, 15716 * 86_400_000) and p.delays.grid_ms == (0, 1500) and p.filters.limits.shortest_ms == 1_800_000
    moved = "# note\n" + TEXT.replace("unit = 5000, least = 2", "least = 2, unit = 5000")
    assert P.params(moved).hash() == p.hash() != P.params(TEXT.replace("days = 5 ", "days = 6 ")).hash()
    for old, new in (("days = 5 ", "days = true "), ("days = 5 ", "days = 5.0 "), ("days = 5 ", "day = 5 "), ("days = 5 ", "days = 5, more = 1 "), ("groups = [2, 10", "groups = [2, 11"), ("primary = 50000", "primary = 1"), ('"2013-01-11"', '"2013-01-10"'), ('"2013-01-11"', '"2013-1-11"'), ("open_coins = 3\n", ""), ("taker_pct = 50.0", "taker_pct = 50"), ("[filters]", "[filters"), ('symbol = "XY" }', 'symbol = "XY" }, { coin = "X", symbol = "Z" }')):
        assert old in TEXT
        with pytest.raises(P.ConfigError):
            P.params(TEXT.replace(old, new))


def test_documents():
    assert P.assets('coins = ["a", "b"]', ["b"]) == ("a", "b")
    for bad in ('coins = ["a", "a"]', 'coins = [1]', "coin = []", 'coins = ["a"]\nx = 1'):
        with pytest.raises(P.ConfigError):
            P.assets(bad)
    with pytest.raises(P.ConfigError):
        P.assets('coins = ["a"]', ["b"])
    costs = {"b": P.Cost(1.5, (3, 4)), "a": P.Cost(2.0)}
    assert P.parse_costs(P.dump_costs(costs)) == costs and P.dump_costs(costs).index('"a"') < P.dump_costs(costs).index('"b"')
    assert set(P.add_costs(costs, {"c": P.Cost(1.0), "a": P.Cost(2.0)})) == {"a", "b", "c"}
    for bad in ('{"a": {"half_spread_bps": 1.0}, "a": {"half_spread_bps": 1.0}}', '{"a": {"half_spread_bps": -1.0}}', '{"a": {"half_spread_bps": 1}}', "{"):
        with pytest.raises(P.ConfigError):
            P.parse_costs(bad)
    with pytest.raises(P.ConfigError):
        P.add_costs(costs, {"a": P.Cost(2.5)})
    assert P.settings({"N": int, "M": int}, {"N": "5"}) == {"N": 5, "M": None}
    with pytest.raises(P.ConfigError):
        P.settings({"N": int}, {"N": "x"})


def test_budget():
    now = [0.0]
    b = S.Budget(100, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    first = b.reserve(60)
    b.settle(first, 80)
    now[0] = 10.0
    b.reserve(20)
    b.reserve(30)  # waits until the first is a minute old
    assert 60 <= now[0] < 61 and b.total == 130 and b.peak == 100 and 50 <= b.waited_s < 51
    with pytest.raises(ValueError):
        b.reserve(101)
    assert S.items_weight(0) == 20 and S.items_weight(21) == 22
    assert S.hour_chunks(0, 1001 * 3_600_000)[-1] == (1000 * 3_600_000, 1001 * 3_600_000)


def test_budget_report(spark):
    calls = [(0, 50), (59_999, 40), (60_000, 30), (60_000, 5), (200_000, 1), (None, 9)]
    df = spark.createDataFrame(calls, "t long, w long")
    assert tuple(S.budget_report(df, "t", "w", 80).first()) == (5, 126, 90, 1)
    assert tuple(S.budget_report(df.limit(0), "t", "w", 80).first()) == (0, 0, 0, 0)


def test_look_ups_and_snapshots(spark):
    def ask(k):
        if k == "b":
            raise KeyError(k)
        return k.upper()

    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "address string")
    good, bad = S.roles(keys, ask, 5)
    assert [tuple(r) for r in good.collect()] == [(5, "a", "A")] and [r.address for r in bad.collect()] == ["b"]
    store = Store(spark, shared_path(spark, "snap"))
    one = "0x" + "a" * 40
    assert S.snapshot(spark, store, b'{"leaderboardRows":[{"ethAddress":"%s","accountValue":"5"}]}' % one.encode(), 7) == 1
    repo = Repository(store)
    assert repo.snapshots("leaderboard") == [7] and repo.snapshot("leaderboard", 7).first().account_value == 5.0
    with pytest.raises(Conflict):
        S.snapshot(spark, store, b"{}", 7)
    with pytest.raises(ValueError):
        S.snapshot(spark, store, b'{"leaderboardRows":[{"ethAddress":"x","accountValue":"5"}]}', 8)
    assert repo.snapshots("raw_leaderboard") == [7, 8] and repo.snapshots("leaderboard") == [7]
    fake = S.Pages({"k": [{"time": t, "tid": t} for t in range(5)]}, 3, fails=["z"])
    assert len(collect_pages(lambda a, b: fake("k", a, b), 0, 9, 3, 99)[0]) == 5 and len(fake.calls) == 3
    with pytest.raises(ConnectionError):
        fake("z", 0, 1)
