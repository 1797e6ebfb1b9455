import hashlib
import itertools
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators.choosing import first_meeting, funnel, hash_order, until_share
from tideline.operators.feeds import drop_first, half_spreads, message_gaps, message_rows, qualifying_days
from tideline.operators.storage import Bounded, LookaheadError, change_log, content_hashes, content_sha256, copies, intersect, multiset_difference, normalize, table_digest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_spans():
    assert normalize([(5, 7), (1, 3), (3, 4), (9, 9)]) == [(1, 4), (5, 7)]
    assert intersect([(0, 10), (20, 30)], [(5, 25)]) == [(5, 10), (20, 25)]


def test_bounded(spark):
    df = spark.createDataFrame([(1,), (5,)], "t long")
    assert Bounded(5).view(df, "t").count() == 1
    assert Bounded(5).window(df, "t", 0, 5).count() == 1
    with pytest.raises(LookaheadError):
        Bounded(5).window(df, "t", 0, 6)


def test_multiset_difference_and_log(spark):
    kind = "k long, n long, x double, s string"
    nan = float("nan")
    a = spark.createDataFrame([(1, 1, nan, "u"), (1, 1, nan, "u"), (2, 1, -0.0, None), (3, 1, 1.0, "w"), (4, 1, 1.0, "w")], kind)
    b = spark.createDataFrame([(1, 1, nan, "u"), (2, 1, 0.0, None), (3, 1, 2.0, "w"), (5, 1, 1.0, "w")], kind)
    diff = multiset_difference(a, b)
    assert rows(copies(diff, True).select("k")) == [(1,), (3,), (4,)]
    assert rows(copies(diff, False).select("k")) == [(3,), (5,)]
    log = change_log(a, b, ["k", "n"])
    assert rows(log.select("k", "field")) == [(1, "row_removed"), (3, "x"), (4, "row_removed"), (5, "row_added")]
    assert [(r.old, r.new) for r in log.where("field = 'x'").collect()] == [("1.0", "2.0")]
    assert change_log(a, a, ["k", "n"]).count() == 0


def test_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i long, s string")
    assert rows(table_digest(df)) == rows(table_digest(df.repartition(3).orderBy(F.desc("i"))))
    assert rows(table_digest(df)) != rows(table_digest(df.limit(2)))
    table = pa.table({"s": pa.array([None, "a"]), "i": pa.array([2, 1])})
    want = hashlib.sha256(b"m" + struct.pack("<QQ", 2, 2))
    want.update(struct.pack("<Q", 1) + b"ii" + b"\x01\x01" + struct.pack("<qq", 1, 2))
    want.update(struct.pack("<Q", 1) + b"ss" + b"\x01\x00" + struct.pack("<Q", 1) + b"a" + struct.pack("<Q", 0))
    assert content_sha256(table, {"i": "i", "s": "s"}, ["i"], b"m") == want.hexdigest()


def test_content_hash_of_odd_values():
    of = lambda *v: content_sha256(pa.table({"k": pa.array(range(len(v))), "x": pa.array(v, pa.float64(), from_pandas=False)}), {"k": "i", "x": "f"}, ["k"])
    nan, other = float("nan"), struct.unpack("<d", b"\1\0\0\0\0\0\xf8\x7f")[0]
    assert of(0.0, 1.0) == of(-0.0, 1.0) and of(nan) == of(other)
    assert len({of(None), of(nan), of(0.0)}) == 3
    kinds = {"k": "i", "s": "s", "b": "b", "y": "y"}
    rows_ = [{"k": 2, "s": None, "b": True, "y": b"x"}, {"k": None, "s": "é", "b": None, "y": None}, {"k": 1, "s": "", "b": False, "y": b""}, {"k": 1, "s": None, "b": False, "y": b""}]
    kind = pa.schema([("k", pa.int64()), ("s", pa.string()), ("b", pa.bool_()), ("y", pa.binary())])
    found = {content_sha256(pa.Table.from_pylist(list(p), kind), kinds, ["k"]) for p in itertools.permutations(rows_)}
    assert len(found) == 1
    assert content_sha256(pa.Table.from_pylist([], kind), kinds, ["k"]) not in found


def test_content_hash_per_partition(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, None), ("b", 1, float("nan"))], "p string, k long, x double")
    got = {r.p: (r.n, r.sha256) for r in content_hashes(df, ["p"], ["k"]).collect()}
    again = {r.p: (r.n, r.sha256) for r in content_hashes(df.orderBy(F.desc("k")).repartition(3), ["p"], ["k"]).collect()}
    assert got == again and got["a"][0] == 2 and got["a"][1] != got["b"][1]


def test_difference_keeps_what_is_stored(spark):
    kind = "k long, x double"
    left = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, float("nan")), (4, -0.0), (4, -0.0)], kind)
    right = spark.createDataFrame([(1, 0.0), (3, float("nan")), (4, 0.0), (5, -0.0)], kind)
    got = {r.k: (str(r.x), r.n_more) for r in multiset_difference(left, right).collect()}
    assert got == {2: ("0.0", 1), 4: ("-0.0", 1), 5: ("-0.0", -1)}


def test_hash_order_is_sha256(spark):
    names = [f"n{i}" for i in range(300)]
    got = {r.k: r["rank"] for r in hash_order(spark.createDataFrame([(n,) for n in names], "k string"), "k", "s:1").collect()}
    assert sorted(got, key=got.get) == sorted(names, key=lambda n: hashlib.sha256(f"s:1:{n}".encode()).hexdigest())


def test_choices(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", None)], "k string, v long")
    got = first_meeting(df, F.col("v") < 5, [F.desc("v"), F.asc("k")], 1)
    assert {r.k: (r.meets, r.place) for r in got.collect()} == {"a": (False, None), "b": (True, 1), "c": (True, None), "d": (False, None)}
    odd = spark.createDataFrame([("a", None), (None, 3), (None, 2)], "k string, v long")
    assert {(r.k, r.v): r.place for r in first_meeting(odd, F.lit(True), [F.desc_nulls_first("v")], 2).collect()} == {("a", None): 1, (None, 3): 2, (None, 2): None}
    assert rows(funnel(df, [("big", F.col("v") > 3), ("five", F.col("v") == 5)])) == [(0, "big", 4, 1), (1, "five", 3, 2)]
    assert rows(until_share(df.na.fill(0), "v", [F.desc("v"), F.asc("k")], 0.5).select("k")) == [("a",), ("b",)]


def quotes(spark, *r):
    return spark.createDataFrame([("c", t, i, 100 - w, 100 + w) for i, (t, w) in enumerate(r)], "coin string, time_ms long, ord long, bid_px double, ask_px double")


def gaps(spark, *r):
    return spark.createDataFrame([("c", a, b) for a, b in r], "coin string, start_ms long, end_ms long")


def test_time_weighted_half_spread(spark):
    m = 1_000_000
    value = lambda q, g: [r.half_spread_bps for r in half_spreads(q, g).collect()]
    assert value(quotes(spark, (0, 0.5), (80 * m, 0.125), (80 * m + 1000, 0.25)), gaps(spark)) == [50.0]
    assert value(quotes(spark, (0, 0.5), (40 * m, 0.125)), gaps(spark)) == [12.5]
    assert value(quotes(spark, (0, 0.5), (40 * m, 0.125)), gaps(spark, (35 * m, 45 * m), (40 * m, 52 * m))) == [50.0]


def test_gap_rule(spark):
    p = spark.createDataFrame([("c", t, t, 1) for t in (1000, 11_000, 21_001)] + [("c", 22_000, 22_000, 2)], "coin string, time_ms long, recv_ms long, conn_ms long")
    assert rows(message_gaps(p, "coin", ["time_ms"], 10_000)) == [("c", 11_000, 21_001, "silence"), ("c", 21_001, 22_000, "disconnect")]


def test_messages(spark):
    rec = spark.createDataFrame(
        [("E", 1, 1, '{"channel":"bbo","data":{"coin":"E","time":5,"bbo":[{"px":"1.5","sz":"2","n":1},null]}}'), ("E", 1, 1, '{"channel":"bbo","data":{"coin":"F","time":5,"bbo":[]}}'), ("E", 1, 1, '{"channel":"bbo","data":{"co'), ("E", 1, 1, None)],
        "coin string, recv_ms long, conn_ms long, raw string",
    )
    assert rows(message_rows(rec, "bbo")) == [("E", 5, 1, 1, 1.5, 2.0, None, None)]
    kept = drop_first(spark.createDataFrame([("E", 1, 1), ("E", 2, 1), ("E", 3, 2), (None, 1, None), (None, 2, None)], "coin string, r long, conn_ms long"), ["coin"], ["r"])
    assert rows(kept) == [("E", 2, 1), (None, 2, None)]


def test_qualifying_days(spark):
    c = spark.createDataFrame([("a", d, g, 0, 100, True) for d, g in ((1, 5), (2, 6), (3, 0), (4, 0))] + [("a", 0, 0, 0, 100, False)], "coin string, day long, gap_ms long, unrecorded_ms long, observed_ms long, complete boolean")
    assert rows(qualifying_days(c, 95, 2)) == [("a", 1), ("a", 3)]
