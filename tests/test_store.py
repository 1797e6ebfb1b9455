import pytest
from pyspark.sql import functions as F

from tideline.operators.storage import LookaheadError
from tideline.session import shared_path
from tideline.sources.store import Conflict, MissingPartition, Repository, Store
from tideline.sources.tables import schema

KINDS = {"log": schema("owner:s t:l v:s"), "days": schema("coin:s second:l last:d"), "shots": schema("snapshot_ms:l k:s")}
COLUMNS = {"log": ["owner"], "days": ["coin", "day"], "shots": ["snapshot_ms"]}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark):
    return Store(spark, shared_path(spark, "store"), frozen=[(15, 25)], partitions=COLUMNS, schemas=KINDS)


@pytest.fixture
def make(spark):
    return lambda *r: spark.createDataFrame([("a", *x) for x in r], KINDS["log"])


def test_interval_is_replaced_and_frozen_rows_stay(store, make):
    assert store.partitions("log") == [] and store.spans("log", ("a",)) == [] and store.disk_bytes("log") == 0
    with pytest.raises(MissingPartition):
        store.read("log", ("a",))
    assert not store.write("log", ("a",), make((1, "a"), (20, "b"), (20, "b")), (0, 30), "t").diverged()
    out = store.write("log", ("a",), make((12, "c"), (20, "x")), (10, 40), "t")  # 20 is frozen and was written
    assert rows(store.read("log", ("a",))) == [("a", 1, "a"), ("a", 12, "c"), ("a", 20, "b"), ("a", 20, "b")]
    assert rows(out.kept) == [(20, "b", 2)] and rows(out.refused) == [(20, "x", 1)] and out.diverged()
    assert store.spans("log", ("a",)) == [(0, 40)] and store.exists("log", ("a",))
    assert rows(store.read("log", ("a",), ["v"])) == [("a",), ("b",), ("b",), ("c",)]
    assert store.disk_bytes("log") > 0
    for bad in (make((50, "z")), make((None, "z"))):
        with pytest.raises(ValueError):
            store.write("log", ("a",), bad, (0, 30), "t")
    with pytest.raises(ValueError):
        store.write("log", ("a",), make((1, "a")).withColumn("v", F.lit(1)), (0, 30), "t")
    assert store.vacuum("log") == 1 and store.read("log", ("a",)).count() == 4


def test_logs_grow_and_snapshots_do_not_change(store, spark, make):
    store.append("log", ("a",), make((20, "x")))
    before = store.read("log", ("a",)).inputFiles()
    store.append("log", ("a",), make((20, "x"), (None, "y")))
    assert store.read("log", ("a",)).count() == 3 and set(before) < set(store.read("log", ("a",)).inputFiles())
    shot = spark.createDataFrame([(7, "k")], KINDS["shots"])
    store.create("shots", ("7",), shot)
    with pytest.raises(Conflict):
        store.create("shots", ("7",), shot)
    store.create("shots", ("30",), shot.limit(0))
    repo = Repository(store)
    assert repo.snapshots("shots") == [7, 30] and rows(repo.snapshot("shots", 7)) == [(7, "k")] and repo.snapshot("shots", 30).count() == 0
    with pytest.raises(MissingPartition):
        repo.snapshot("shots", 8)
    with pytest.raises(ValueError):
        repo.snapshots("log")


def test_all_partitions_of_a_table_at_once(store, spark):
    day = lambda *r: spark.createDataFrame(list(r), "coin string, day long, second long, last double")
    frozen = Store(spark, store.root, [(0, 90_000)], COLUMNS, KINDS)
    whole = (0, 10 * 86_400)
    assert store.write_all("days", day(("x:A", 0, 5, 1.0), ("x:A", 1, 86_401, 2.0), ("b c", 0, 7, 3.0)), whole, "second") == [("b c", "0"), ("x:A", "0"), ("x:A", "1")]
    assert store.partitions("days") == [("b c", "0"), ("x:A", "0"), ("x:A", "1")]
    frozen.write_all("days", day(("x:A", 0, 6, 9.0), ("b c", 1, 86_500, 4.0)), whole, "second")
    got = {(r.coin, r.day, r.second, r["last"]) for r in store.scan("days").collect()}
    assert got == {("x:A", 0, 5, 1.0), ("x:A", 1, 86_401, 2.0), ("b c", 0, 7, 3.0), ("b c", 1, 86_500, 4.0)}
    assert {r.second for r in store.scan("days", lambda p: p[1] == "0").collect()} == {5, 7}
    hashes = Repository(store).content_hashes("days", ["second"], "second", 0, 86_400)
    assert {(r.coin, r.day, r.n) for r in hashes.collect()} == {("x:A", 0, 1), ("b c", 0, 1)}


def test_second_writer_is_refused(store, spark, make):
    store.write("log", ("a",), make((1, "a")), (0, 30), "t")
    staged = store._stage("log", make((2, "b")).drop("owner"))
    store._publish("log", ("a",), 1, [(0, 30)], staged)
    with pytest.raises(Conflict):
        store._publish("log", ("a",), 1, [(0, 30)], store._stage("log", make((3, "c")).drop("owner")))
    assert rows(store.read("log", ("a",))) == [("a", 2, "b")]
    with store.exclusive():
        with pytest.raises(Conflict), Store(spark, store.root, (), COLUMNS, KINDS).exclusive():
            pass
        assert store.recover("log") == 1  # what the refused writer had staged
    # lost between claim and record: the version does not count, and recovering frees the way
    store._fs.createNewFile(store._Path(f"{store._dir('log', ('a',))}/.after-2"))
    with pytest.raises(Conflict):
        store.write("log", ("a",), make((4, "d")), (0, 30), "t")
    store.recover("log")
    store.write("log", ("a",), make((4, "d")), (0, 30), "t")
    assert rows(store.read("log", ("a",))) == [("a", 4, "d")]


def test_reads_touch_only_what_can_hold_the_answer(spark):
    store = Store(spark, shared_path(spark, "store"))
    day = 86_400_000
    trades = [("x:A", d, d * day + 5, d * day + 10, 0, 1.0, 1.0, "A", None, None, d) for d in range(1, 6)] + [("x:A", 3, 2 * day - 7, 3 * day + 1, 0, 1.0, 1.0, "A", None, None, 9)]
    kind = "coin string, day long, time_ms long, recv_ms long, conn_ms long, px double, sz double, side string, buyer string, seller string, tid long"
    store.write_all("trades", spark.createDataFrame(trades, kind), (0, 100 * day), "recv_ms")
    repo = Repository(store, cutoff_ms=5 * day)
    got = repo.by_event_time("trades", "x:A", 2 * day - 10, 3 * day)
    assert [r.tid for r in got.collect()] == [9, 2] and len({f.rpartition("/version_=")[0] for f in got.inputFiles()}) == 3
    with pytest.raises(LookaheadError):
        repo.by_event_time("trades", "x:A", 0, 5 * day + 1)
    assert repo.gaps("none", 0, 5).count() == repo.proxy("none", 0, 5).count() == repo.fills("none", 0, 5).count() == 0
