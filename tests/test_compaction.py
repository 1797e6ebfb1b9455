import json

import duckdb

from tideline.functions.hilbert import grid, hilbert2
from tideline.operators.compaction import SegmentCompactor, wrong_reports
from tideline.sources.tables import SCHEMAS, read
from pyspark.sql import functions as F


def canonical(raw):
    try:
        return "j" + json.dumps(json.loads(raw), sort_keys=True)
    except (TypeError, ValueError):
        return f"t{raw}"


def repeats(segments, records):
    seg = {s["path"]: s for s in segments}
    rows = [(seg[r["path"]], r) for r in records if r["path"] in seg]
    key = lambda s, r: (s["coin"], s["channel"], r["conn_ms"], r["recv_ms"], canonical(r["raw"]))
    first = {}
    for s, r in rows:
        k = key(s, r)
        first[k] = min(first.get(k, (1 << 62, b"")), (s["opened_ms"], s["path"].encode()))
    return sorted((s["hour_ms"], r["path"], r["record_no"]) for s, r in rows if (s["opened_ms"], s["path"].encode()) > first[key(s, r)])


def table(root, name):
    t = duckdb.sql(f"SELECT * FROM '{root}/{name}.parquet'")
    return [dict(zip(t.columns, r)) for r in t.fetchall()]


def test_against_brute_force(spark, small):
    done = SegmentCompactor(read(spark, small, "segments"), read(spark, small, "records"), target_bytes=2000, bits=4).run()
    segments, records = table(small, "segments"), table(small, "records")
    want = repeats(segments, records)
    assert sorted((r.hour_ms, r.path, r.record_no) for r in done.dropped.collect()) == want
    gone = {(p, n) for _, p, n in want}
    kept = sorted((r["path"], r["record_no"], r["recv_ms"], r["conn_ms"], r["raw"]) for r in records if (r["path"], r["record_no"]) not in gone)
    assert sorted((r.path, r.record_no, r.recv_ms, r.conn_ms, r.raw) for r in done.files.collect()) == kept
    assert done.digests.where("not ok").count() == 0
    assert done.digests.agg(F.max("n_files")).first()[0] > 1  # the target was small enough to cut days


def frames(spark, segments, records):
    seg = [(c, ch, 0, o, True, p, 1, 1) for c, ch, o, p in segments]
    return spark.createDataFrame(seg, SCHEMAS["segments"]), spark.createDataFrame(records, SCHEMAS["records"])


def test_spellings_nulls_and_repeats(spark):
    segments, records = frames(
        spark,
        [("a", "bbo", 5, "p2"), ("a", "bbo", 5, "p1"), ("a", "bbo", 5, "p1"), ("b", "bbo", 1, "p0"), (None, None, None, "p3")],
        [("p1", 0, 1, 1, '{"x":1,"y":[2]}'), ("p1", 1, 1, 1, '{"x":1,"y":[2]}'), ("p2", 0, 1, 1, '{ "y": [2], "x": 1.0}'), ("p0", 0, 1, 1, '{"x":1,"y":[2]}'), ("p2", 1, 2, 1, '{"x":'), ("p1", 2, 2, 1, '{"x":'),
         ("p2", 2, 2, 1, '{"x": '), ("p3", None, None, None, None), ("p3", 7, None, None, ""), ("gone", 1, 1, 1, "z"), (None, 1, 1, 1, "z")],
    )
    done = SegmentCompactor(segments, records).run()
    assert sorted((r.path, r.record_no) for r in done.dropped.collect()) == [("p2", 0), ("p2", 1)]
    assert done.files.count() == 7


def test_a_third_of_all_rows_are_copies(spark):
    segments, records = frames(spark, [("a", "bbo", i, f"p{i}") for i in range(40)], [(f"p{i}", n, 1, 1, '{"x":1}') for i in range(40) for n in range(3)] + [(f"p{i}", 9, i, 1, f'{{"x":{i}}}') for i in range(40)])
    done = SegmentCompactor(segments, records).run()
    assert done.dropped.count() == 39 * 3 + 1  # record 9 of p1 equals those of p0
    assert done.files.count() == 40 * 4 - 39 * 3 - 1


def test_empty_tables(spark):
    segments, records = frames(spark, [], [])
    done = SegmentCompactor(segments, records).run()
    assert done.files.count() == done.dropped.count() == done.digests.count() == 0
    reports = spark.createDataFrame([(3, 1, 1, 1, 0), (4, 1, 1, 1, 2), (5, 1, 1, 1, None), (None, 1, 1, 1, 2)], SCHEMAS["day_reports"])
    assert [r.day for r in wrong_reports(segments, reports).collect()] == [4]


def test_days_of_many_files(spark):
    """Some thirty files a day: even sizes, and receive times that overlap little, though some events are late and one is hours off."""
    late = lambda i: 40_000 if i % 50 == 0 else 7_200_000 if i == 999 else 300
    rows = [("p", i, i * 20_000, 1, '{"channel":"book","data":{"time":%d,"x":"%s"}}' % (i * 20_000 - late(i), "y" * (i % 37))) for i in range(4000)]
    rows += [("p", 4000 + i, 30_000_000, 1, '{"channel":"book","data":{"time":30000000,"x":%d}}' % i) for i in range(600)]  # one instant that fills several files
    segments, records = frames(spark, [("a", "book", 5, "p")], rows)
    target = sum(len(r[4]) + 32 for r in rows) // 30
    done = SegmentCompactor(segments, records, target_bytes=target).run()
    d = done.digests.first()
    assert d.ok and d.n_written == 4600 and 30 <= d.n_files <= 32
    assert d.most_bytes < 1.1 * target and d.least_bytes > 0.5 * target
    whole = 4000 * 20_000
    assert d.overlap_ms < whole  # a file spans less than twice its share of the day; files of random rows would each span all of it
    near = done.files.where("recv_ms < 20000000").groupBy("file_no").agg((F.max("recv_ms") - F.min("recv_ms")).alias("x")).agg(F.max("x")).first()[0]
    assert near < whole / 8


def test_hilbert_visits_neighbours(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    order = cells.select("x", "y", hilbert2(F.col("x"), F.col("y"), 4).alias("d")).orderBy("d").collect()
    assert [r.d for r in order] == list(range(n * n))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(order, order[1:]))


def test_grid(spark):
    df = spark.createDataFrame([(-5,), (0,), (99,), (100,), (None,)], "x long").select(grid(F.col("x"), F.lit(0), F.lit(100), 2).alias("g"))
    assert [r.g for r in df.collect()] == [0, 0, 3, 3, 0]
