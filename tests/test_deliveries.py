"""Changes that come and go between the first and the last delivery."""

from compare import compare
from tideline.plans import relational
from tideline.sources.tables import SCHEMAS


def test_every_delivery_counts(spark, tmp_path):
    row = lambda at, tid, px: (1, at, "w", tid, "BTC", 5, px, 1.0, "B", 0.0, None, 0.0, tid)
    rows = [row(10, 1, 2.0), row(20, 1, 3.0), row(20, 2, 9.0), row(30, 1, 2.0)]
    spark.createDataFrame(rows, SCHEMAS["fill_snapshots"]).write.parquet(f"{tmp_path}/fill_snapshots.parquet")
    for name in ("multiset_diff_each", "divergence_log_each"):
        assert not compare(spark, str(tmp_path), name, relational.QUERIES[name], relational.SQL[name])[3]
    assert relational.multiset_diff(spark, str(tmp_path)).count() == 0
    assert sorted((r.snapshot_ms, r.px, r.n) for r in relational.multiset_diff_each(spark, str(tmp_path)).collect()) == [(20, 2.0, 1), (20, 3.0, -1), (20, 9.0, -1), (30, 2.0, -1), (30, 3.0, 1), (30, 9.0, 1)]
    assert sorted((r.snapshot_ms, r.field, r.n) for r in relational.divergence_log_each(spark, str(tmp_path)).collect()) == [(20, "px", 1), (20, "row_added", 1), (30, "px", 1), (30, "row_removed", 1)]
