"""Windows are those of the tables."""

import pytest

from compare import compare
from tideline.functions.timeops import DAY_MS
from tideline.plans import account, relational, selecting
from tideline.sources.tables import SCHEMAS

FIRST, LAST = 15698, 15711
HOUR = 3_600_000


def fill(seq, day, hour, sz=1.0, side="B", start=0.0, coin="BTC", address="w"):
    return (address, seq, day * DAY_MS + hour * HOUR, coin, "perp", 100.0, sz, side, start, None, True, 0.0, 0.0, 1, 1, None, None)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rows = [
        fill(0, FIRST, 5), fill(1, 15707, 1, side="A", start=1.0), fill(2, 15709, 2), fill(3, 15709, 3, coin="ETH"), fill(4, LAST, 4, 2.0, start=1.0), fill(5, LAST, 5, 1.0, "A", 9.0),
        fill(0, LAST, 1, address="v"), fill(1, LAST, 7, side="A", start=1.0, address="v"), fill(0, FIRST, 6, side="A", start=3.0, address="u"), fill(1, 15708, 0, start=7.0, address="u"),
    ]
    at = tmp_path_factory.mktemp("fills")
    spark.createDataFrame(rows, SCHEMAS["fills"]).write.parquet(f"{at}/fills.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["open_count_steps", "exposure_steps", "break_ages"])
def test_all_days_count(spark, root, name):
    """As the SQL of the query has it, and as it has it with the window written out."""
    stated = account.SQL[name].replace(account.START, str(FIRST * DAY_MS)).replace(account.END, str((LAST + 1) * DAY_MS))
    for sql in (account.SQL[name], stated):
        rows, _, _, diff = compare(spark, root, name, account.QUERIES[name], sql)
        assert rows and not diff


def test_measures_of_all_days(spark, root):
    got = {r.address: (r.n_fills, r.closed_episodes, r.median_open) for r in selecting.account_measures(spark, root).collect()}
    assert got == {"w": (6, 1, 1), "v": (2, 1, 1), "u": (2, 0, 1)}


def test_no_fills_no_window(spark, tmp_path):
    spark.createDataFrame([], SCHEMAS["fills"]).write.parquet(f"{tmp_path}/fills.parquet")
    assert selecting.account_measures(spark, str(tmp_path)).count() == account.open_count_steps(spark, str(tmp_path)).count() == 0


def test_coverage_reaches_the_last_instant(spark, tmp_path):
    at = lambda day, hour: day * DAY_MS + hour * HOUR
    trade = lambda coin, t: (coin, t, t, 0, 1.0, 1.0, "A", None, None, 1)
    spark.createDataFrame([trade("a", at(15706, 6)), trade("a", at(15709, 3)), trade("late", at(15708, 12)), trade("a", None)], SCHEMAS["trades"]).write.parquet(f"{tmp_path}/trades.parquet")
    gaps = [("a", at(15707, 11), at(15708, 2), "silence"), ("late", at(15709, 1), at(15709, 4), "silence"), ("a", at(15712, 2), at(15712, 1), "silence"), (None, at(15712, 1), at(15712, 2), "silence"), ("a", at(15709, 0), None, "silence")]
    spark.createDataFrame(gaps, SCHEMAS["gaps"]).write.parquet(f"{tmp_path}/gaps.parquet")
    _, _, _, diff = compare(spark, str(tmp_path), "coverage_to_date", relational.coverage_to_date, relational.SQL["coverage_to_date"])
    assert not diff
    got = {(r.coin, r.day): (r.gap_ms // HOUR, r.unrecorded_ms // HOUR, r.observed_ms // HOUR, r.complete) for r in relational.coverage_to_date(spark, str(tmp_path)).collect()}
    assert got == {
        ("a", 15706): (0, 6, 24, True), ("a", 15707): (13, 0, 24, True), ("a", 15708): (2, 0, 24, True), ("a", 15709): (0, 0, 4, False),
        ("late", 15708): (0, 12, 24, True), ("late", 15709): (3, 0, 4, False),
    }
