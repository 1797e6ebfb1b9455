from tideline.operators import feeds as batch
from tideline.operators.lateness import LatePeriods
from tideline.session import shared_path
from tideline.sources import segments
from tideline.sources.store import Store
from tideline.sources.tables import SCHEMAS, read
from tideline.streaming import feeds


def folder(spark, df, order, parts):
    """The rows in arrival order, as several files."""
    path = shared_path(spark, "arrivals")
    rows = [tuple(r) for r in df.orderBy(*order).collect()]
    n = -(-len(rows) // parts)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_bars_come_out_as_in_batch(spark, small):
    """All bars but that of a last trade, whose only use is to move the watermark past all others."""
    trades = read(spark, small, "trades").where("time_ms is not null and coin is not null").select("coin", "time_ms", "tid", "px", "recv_ms")
    last = spark.createDataFrame([("end", 15_800 * 86_400_000, 0, 1.0, 0)], trades.schema)
    path = folder(spark, trades, ["time_ms"], 3)
    flow = feeds.bars(feeds.stream(spark, path, trades.schema), "2 hours")
    out, at = shared_path(spark, "bars"), shared_path(spark, "bars-checkpoint")
    run = lambda: flow.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    assert 0 < spark.read.parquet(out).count()  # what the watermark has passed so far
    last.write.mode("append").parquet(path)
    run()
    got = {(r.coin, r.slot): tuple(r)[2:] for r in spark.read.parquet(out).collect()}
    want = {(r.coin, r.slot): tuple(r)[2:] for r in batch.bars(trades, ["coin"], "time_ms", "px", ["tid", "px"]).collect()}
    assert len(want) > 500 and got == want


def test_late_trades_are_left_out_beyond_the_watermark(spark):
    kind = "coin string, time_ms long, tid long, px double"
    path = shared_path(spark, "late-trades")
    for rows in ([("a", 10_000_000, 1, 1.0)], [("a", 10_000_500, 2, 2.0)], [("a", 1_000, 3, 9.0)], [("z", 90_000_000, 4, 1.0)], [("z", 90_000_001, 5, 1.0)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    got = feeds.drained(feeds.bars(feeds.stream(spark, path, spark.createDataFrame([], kind).schema), "1 hour"), shared_path(spark, "late-bars")).collect()
    assert ("a", 10_000) in {(r.coin, r.slot) for r in got}


def test_first_messages_by_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.STATE_STORE)
    kind = "coin string, channel string, opened_ms long, path string, record_no long, recv_ms long, conn_ms long, raw string"
    rows = [("a", "bbo", 0, "p", i, i, i // 7, f"m{i}") for i in range(30)] + [("b", "bbo", 0, "q", i, i, 3, "x") for i in range(4)]
    df = spark.createDataFrame(rows, kind)
    flow = feeds.stream(spark, folder(spark, df, ["recv_ms", "coin"], 4), df.schema)
    got = feeds.drained(feeds.first_dropped(flow), shared_path(spark, "first"))
    want = batch.drop_first(df, ["coin", "channel"], ["recv_ms", "opened_ms", "path", "record_no"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and want.count() == 34 - 5 - 1


def test_recorded_and_closed_by_day(spark):
    """A stream into segments, its closed days into tables, and the next day carried on from there."""
    day = 86_400_000
    kind = "coin string, channel string, recv_ms long, conn_ms long, raw string"
    say = lambda t: '{"channel":"book","data":{"coin":"a","time":%d,"levels":[[{"px":"1","sz":"2"}],[{"px":"3","sz":"4"}]]}}' % t
    trade = lambda t: '{"channel":"trades","data":[{"coin":"a","side":"B","px":"1","sz":"1","time":%d,"tid":%d,"users":["x","y"]}]}' % (t, t)
    one = [("a", "book", t + 300, 7, say(t)) for t in (1_000, 11_000, 21_001, 30_000)] + [("a", "trades", t + 300, 7, trade(t)) for t in (500, 600, 700)]
    two = [("a", "book", day + t + 300, 7, say(day + t)) for t in (5, 9_000)] + [("a", "book", day + 50_000, 8, say(day + 49_000)), ("a", "book", day + 51_000, 8, say(day + 50_500))]
    source, root = shared_path(spark, "messages"), shared_path(spark, "segments")
    spark.createDataFrame(one + two, kind).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second time from a new checkpoint, as after a loss
        feeds.recorded(feeds.stream(spark, source, spark.createDataFrame([], kind).schema), root).awaitTermination()
    assert segments.read(spark, root).count() == len(one + two)
    store = Store(spark, shared_path(spark, "tables"))
    first = feeds.close_days(spark, root, store, 1)
    assert [tuple(r) for r in first.collect()] == [(0, 7, 2, 0, 5, 1, 2, True)]  # one gap of more than ten seconds, from 11 000 to 21 001
    assert segments.read(spark, root).count() == len(two) and store.partitions("book") == [("a", "0")]
    assert [tuple(r) for r in store.read("gaps", ("a",)).collect()] == [("a", 11_000, 21_001, "silence")]
    second = feeds.close_days(spark, root, store, 2)
    # connection 7 goes on: none of its messages is dropped; 8 begins
    assert [tuple(r) for r in second.collect()] == [(1, 4, 1, 0, 3, 2, 1, True)]
    gaps = sorted(tuple(r) for r in store.read("gaps", ("a",)).collect())
    assert gaps == [("a", 11_000, 21_001, "silence"), ("a", 30_000, day + 5, "silence"), ("a", day + 9_000, day + 50_500, "disconnect")]
    assert segments.read(spark, root).count() == 0 and feeds.close_days(spark, root, store, 9).count() == 0


def test_gaps_by_state(spark, small):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.STATE_STORE)
    points = read(spark, small, "book").where("time_ms is not null and coin is not null").select("coin", "time_ms", "recv_ms", "conn_ms").distinct()
    flow = feeds.stream(spark, folder(spark, points, ["recv_ms", "time_ms", "conn_ms"], 3), points.schema)
    got = feeds.drained(feeds.gaps(flow, 1_800_000), shared_path(spark, "gaps"))
    want = batch.message_gaps(points, "coin", ["time_ms", "conn_ms"], 1_800_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partials_per_micro_batch(spark):
    rows = [("a", i * 10 + (i % 4) * -90, i * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, e long, r long")
    op, store = LatePeriods(["k"], "e", "r", period_ms=100, cutoff_ms=100, batch_ms=100), shared_path(spark, "late")
    path = shared_path(spark, "in")
    for low in (0, 200, 400):
        df.where(f"r >= {low} and r < {low + 200}").coalesce(1).write.mode("append").parquet(path)
    feeds.hourly_partials(feeds.stream(spark, path, df.schema), op, store).awaitTermination()
    pick = lambda x: sorted(map(tuple, op.combine(x).collect()))
    whole = op.partials(op.judge_all(df))
    assert pick(spark.read.schema(whole.schema).parquet(f"{store}/partials")) == pick(whole)


def test_segments_schema_is_declared():
    assert {"book", "trades", "fills", "segments", "records"} <= set(SCHEMAS)
