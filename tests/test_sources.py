import gzip
import hashlib
import zipfile

import pytest

from pyspark.sql import functions as F

from tideline.functions.timeops import overlap_ms
from tideline.session import shared_path
from tideline.sources import ingest, segments
from tideline.sources.messages import canonical_json, channel_and_coin, event_time, times_in
from tideline.sources.store import Repository, Store

REC = [(10, 1, b'{"a":1}'), (11, 1, "é".encode()), (12, 2, b"")]


def test_members_round_trip():
    data = segments.encode(REC[:2]) + segments.encode(REC[2:])
    assert [r for m in segments.members(data, False) for r in segments.decode(m)] == REC
    cut = data[:-3]
    assert [r for m in segments.members(cut, True) for r in segments.decode(m)] == REC[:2]
    assert segments.whole_length(cut) == len(segments.encode(REC[:2])) and segments.whole_length(data) == len(data)
    with pytest.raises(ValueError):
        list(segments.members(cut, False))
    assert gzip.decompress(segments.encode([(1, 2, b"a\nb")])) == b"1\t2\t3\ta\nb\n"
    for bad in (gzip.decompress(segments.encode(REC))[:-1] + b"\x01" * 19, b"1\t2\t5\tab\n", b"1\t2", b"x\t2\t0\t\n"):
        with pytest.raises(ValueError):
            list(segments.decode(bad))


def test_segment_source(spark, tmp_path):
    folder = tmp_path / "lab%3AX" / "bbo"
    folder.mkdir(parents=True)
    (folder / "0.5.jsonl.gz").write_bytes(segments.encode(REC))
    (folder / "0.9.jsonl.gz.open").write_bytes(segments.encode(REC[:1]) + segments.encode(REC)[:-4])
    (folder / "0.11.jsonl.gz.open").write_bytes(segments.encode(REC)[:-4])
    load = lambda p: segments.read(spark, str(p))
    got = sorted((r.path, r.record_no, r.recv_ms, r.closed, r.coin, r.raw) for r in load(tmp_path).collect())
    assert [g[1:4] for g in got] == [(0, 10, True), (1, 11, True), (2, 12, True), (0, 10, False)]
    assert got[1][4:] == ("lab:X", "é")
    out = tmp_path / "out"
    more = spark.createDataFrame([("lab:X", "bbo", 3_600_001, None, "line\nfeed"), ("lab:X", "bbo", None, 1, "gone")], "coin string, channel string, recv_ms long, conn_ms long, raw string")
    rows = load(tmp_path).select(*more.columns).unionByName(more)
    paths = segments.write(rows, str(out))
    assert paths == ["lab%3AX/bbo/0.10.jsonl.gz", "lab%3AX/bbo/3600000.3600001.jsonl.gz"]
    assert segments.write(rows, str(out)) == []  # as after a failure
    again = load(out)
    assert sorted((r.recv_ms, r.raw) for r in again.collect()) == sorted([*((g[2], g[5]) for g in got), (3_600_001, "line\nfeed")])
    assert load(tmp_path / "none").count() == 0
    assert segments.recover(spark, str(tmp_path / "lab%3AX")) == ["lab%3AX/bbo/0.9.jsonl.gz"]
    assert sorted(p.name for p in folder.glob("[0-9]*")) == ["0.5.jsonl.gz", "0.9.jsonl.gz"] and load(tmp_path / "lab%3AX").where("closed").count() == 4
    assert segments.delete(spark, str(out), paths + ["none"]) == 2 and load(out).count() == 0


def test_many_small_files_share_a_task(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"c{i % 7}" / "bbo"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.{i}.jsonl.gz").write_bytes(segments.encode(REC))
    df = segments.read(spark, str(tmp_path))
    assert df.count() == 900 and df.rdd.getNumPartitions() < 20


def test_json_documents(spark):
    address = "0x" + "Ab" * 20
    body = '{"leaderboardRows":[{"ethAddress":"%s","accountValue":"5.5"},{"ethAddress":"%s","accountValue":"x"},{"ethAddress":"bad","accountValue":"1"}]}' % (address, address)
    raw = spark.createDataFrame([(body.encode(),)], "body binary")
    got = sorted((r.address, str(r.account_value), r.valid, r.repeated) for r in ingest.account_list(raw).collect())
    assert got == [(address.lower(), "5.5", True, True), (address.lower(), "None", False, True), ("bad", "1.0", False, False)]
    meta = spark.createDataFrame([('{"universe":[{"name":"BTC","szDecimals":5}]}',)], "body string")
    assert [tuple(r) for r in ingest.instruments(meta).collect()] == [("BTC", 5)]


def test_fill_rows(spark):
    good = '{"time":5,"coin":"BTC","px":"1.5","sz":"2","side":"B","startPosition":"-1","dir":"x","closedPnl":"0","fee":"0.1","crossed":true,"tid":7,"oid":8}'
    bad = '{"time":"z","coin":"a:b","px":"-1","sz":"NaN","side":"B","startPosition":"Infinity","crossed":"?","tid":0}'
    df = spark.createDataFrame([("w", good, 1), ("w", bad, 2), ("w", None, 3)], "address string, raw string, n int")
    rows = {r.seq: r for r in ingest.fill_rows(df, ["BTC"], ["n"]).collect()}
    assert (rows[0].time_ms, rows[0].px, rows[0].start_position, rows[0].kind, rows[0].crossed) == (5, 1.5, -1.0, "perp", True)
    assert (rows[1].time_ms, rows[1].px, rows[1].sz, rows[1].start_position, rows[1].kind, rows[1].crossed, rows[1].tid) == (None, None, None, None, "hip3", None, None)
    assert rows[2].coin is None


def pages(items, size):
    return lambda a, b: [x for x in items if a <= x["time"] < b][:size]


def test_pages():
    items = [{"time": t, "tid": i} for i, t in enumerate([1, 2, 2, 3, 4], 1)]
    assert ingest.collect_pages(pages(items, 3), 0, 9, 3, 99) == (items, 3, False)
    assert ingest.collect_pages(pages(items, 3), 0, 9, 3, 2) == (items[:3], 1, True)  # all that came, one more than the cap
    assert ingest.collect_pages(pages(items, 3), 0, 9, 3, 5) == (items, 3, False)  # exactly as many as the cap
    for bad in ([{"time": 3, "tid": 1}, {"time": 2, "tid": 2}], [{"time": 9, "tid": 1}], [{"time": None, "tid": 1}]):
        with pytest.raises(ValueError):
            ingest.collect_pages(lambda a, b, bad=bad: bad, 0, 9, 3, 99)
    burst = [{"time": i, "tid": i} for i in range(1849)] + [{"time": 5000, "tid": 9000 + i // 2} for i in range(300)] + [{"time": 6000 + i, "tid": i} for i in range(100)]
    assert ingest.collect_pages(pages(burst, 2000), 0, 9999, 2000, 20_000) == (burst, 2, False)
    twins = [{"time": 1, "tid": i // 2} for i in range(4)] + [{"time": 2, "tid": 9}]
    assert ingest.collect_pages(pages(twins, 5), 0, 9, 5, 99)[0] == twins
    with pytest.raises(ValueError):
        ingest.collect_pages(pages([{"time": 1, "tid": 1}] * 9, 3), 0, 9, 3, 99)


def test_resume_and_hours(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",)], "address string")
    c = spark.createDataFrame([("x", 0, 9, "ok"), ("y", 0, 9, "failed"), ("z", 0, 8, "ok")], "address string, start_ms long, end_ms long, status string")
    assert sorted(r.address for r in ingest.uncovered(a, c, 0, 9).collect()) == ["y", "z"]
    h = 3_600_000
    f = spark.createDataFrame([("c", 5, 0.1), ("c", h + 1, 0.1), ("c", h + 2, 0.1)], "coin string, time_ms long, rate double")
    assert sorted(tuple(r) for r in ingest.funding_hours(f, 0, 3 * h)[1].collect()) == [("c", h, 2), ("c", 2 * h, 0)]
    d = spark.createDataFrame([("c", 1, True), ("c", 2, False), ("c", 3, True), ("e", 1, True)], "coin string, day long, found boolean")
    assert sorted(map(tuple, ingest.until_first_missing(d).collect())) == [("c", 1), ("e", 1)]


def test_archives(spark, tmp_path):
    lines = ["1,10.0,1,1,1,1000,true", "2,11.0,1,1,1,1500,true", "3,9.0,1,1,1,1400,false"]
    (tmp_path / "plain.csv").write_text("\n".join(lines))
    (tmp_path / "headed.csv").write_text("agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n" + lines[0])
    assert ingest.trade_files(spark, str(tmp_path / "plain.csv")).count() == 3
    assert ingest.trade_files(spark, str(tmp_path / "headed.csv")).count() == 1
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.csv", "\n".join(lines))
    ok = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    sums = spark.createDataFrame([(f"file:{tmp_path}/a.zip", ok), (f"file:{tmp_path}/b.zip", "0" * 64)], "path string, sha256 string")
    got = ingest.archives(spark, str(tmp_path / "*.zip"), sums)
    assert sorted((r.ok, r["count"]) for r in got.groupBy("ok").count().collect()) == [(False, 1), (True, 3)]
    trades = got.where("ok")
    assert [tuple(r) for r in ingest.second_series(trades, 0).collect()] == [(1, 9.0, 11.0, 11.0, 3)]
    with pytest.raises(ValueError):
        ingest.second_series(trades, 1)


def test_names_and_messages(spark):
    df = spark.createDataFrame([("kPEPE",), ("k",), ("BTC",), ("XX",)], "c string")
    assert [r.s for r in df.select(ingest.archive_symbol(df.c, {"XX": "YYUSDT"}).alias("s")).collect()] == ["1000PEPEUSDT", "kUSDT", "BTCUSDT", "YYUSDT"]
    m = spark.createDataFrame([('{"b":1.0,"a":{"time":"x"}}', "bbo"), ('{"data":[{"time":5},{"time":6}]}', "trades"), ('{"data":{"time":7}', "bbo"), (None, None)], "raw string, ch string")
    got = m.select(canonical_json("raw").alias("c"), event_time("raw", "ch").alias("t")).collect()
    assert [tuple(r) for r in got] == [('{"a":{"time":"x"},"b":1}', None), ('{"data":[{"time":5},{"time":6}]}', 5), ('{"data":{"time":7}', None), (None, None)]
    assert ingest.params_hash({"b": 1, "a": [2]}) == ingest.params_hash({"a": [2], "b": 1})
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_archive_into_the_store(spark, tmp_path):
    day = 86_400_000
    lines = [f"{i},{10 + i % 3}.5,1,1,1,{5 * day + i * 400},true" for i in range(9)]
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("t.csv", "agg_trade_id,price\n" + "\n".join(lines))
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    store = Store(spark, shared_path(spark, "prices"))
    with pytest.raises(ValueError):
        ingest.store_archive(spark, str(path), "0" * 64, store, "x", 5)
    with pytest.raises(ValueError):
        ingest.store_archive(spark, str(path), digest, store, "x", 6)
    assert path.exists()
    assert ingest.store_archive(spark, str(path), digest, store, "x", 5) == 4 and not path.exists()
    assert [(r.second, r.n_trades) for r in Repository(store).proxy("x", 5 * day, 6 * day).collect()] == [(5 * 86_400 + i, n) for i, n in enumerate((3, 2, 3, 1))]


def test_recordings(spark, tmp_path):
    say = lambda *t: '{"data":[%s]}' % ",".join(f'{{"time": {x}}}' for x in t)
    (tmp_path / "a.trades.tsv").write_text("\n".join(f"{r}\t{m}" for r, m in [(10, say(1, 2)), (20, say(19)), (30, "cut\toff"), (40, say(5)), (50, say(49))]) + "\nno time\n")
    m = ingest.tsv_recording(spark, str(tmp_path))
    assert [(r.recv_ms, r.raw) for r in m.orderBy("recv_ms").collect()][2] == (30, "cut\toff") and m.count() == 5
    connects = spark.createDataFrame([("a.trades.tsv", 5), ("a.trades.tsv", 35), ("a.trades.tsv", 99)], "file string, at_ms long")
    live, first = ingest.without_snapshots(m, connects, ["file"], ["recv_ms"])
    assert sorted(r.recv_ms for r in live.collect()) == [20, 30, 50] and sorted(r.recv_ms for r in first.collect()) == [10, 40]
    assert [list(r.t) for r in m.orderBy("recv_ms").select(times_in("raw").alias("t")).collect()] == [[1, 2], [19], [], [5], [49]]


def test_small_rules(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert ingest.require(df, ["a", "b"]) is df
    with pytest.raises(ValueError):
        ingest.require(df, ["a", "c", "d"])
    raw = spark.createDataFrame([('{"channel":"bbo","data":{"coin":"X"}}',), ('{"channel":"trades","data":[{"coin":"Y"}]}',), ('{"channel":"pong"}',), ("no",)], "raw string")
    channel, coin = channel_and_coin("raw")
    assert [tuple(r) for r in raw.select(channel, coin).collect()] == [("bbo", "X"), ("trades", "Y"), ("pong", None), (None, None)]
    spans = spark.createDataFrame([(0, 10, 5, 20), (0, 3, 5, 20), (0, 99, 5, 20)], "a long, b long, c long, d long")
    assert [r.x for r in spans.select(overlap_ms(*(F.col(c) for c in "abcd")).alias("x")).collect()] == [5, 0, 15]
    days = ingest.latest_coverage(spark.createDataFrame([("w", 0, 9, 5, "ok"), ("w", 0, 9, 7, "failed"), ("w", 0, 8, 9, "ok")], "address string, start_ms long, end_ms long, ingested_at_ms long, status string"), ["address", "start_ms", "end_ms"])
    assert sorted((r.end_ms, r.status) for r in days.collect()) == [(8, "ok"), (9, "failed")]
