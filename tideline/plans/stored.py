"""Partitioned tables: listing, reads of few partitions, replaced intervals, logs, snapshots, and deliveries stored or left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div, utc_day
from tideline.operators.compaction import distinct_segments
from tideline.operators.daily import convert, due_days
from tideline.operators.ordered import join_same
from tideline.operators.storage import multiset_difference
from tideline.plans.registry import Registry
from tideline.session import shared_path
from tideline.sources.ingest import latest_coverage, uncovered
from tideline.sources.store import Repository, Store
from tideline.sources.tables import PARTITIONS, SCHEMAS, read, schema

query = Registry()
QUERIES, SQL = query.queries, query.sql

LOW, HIGH = 15702 * DAY_MS, 15704 * DAY_MS
ALL_TIME = (-(1 << 62), 1 << 62)
KINDS = SCHEMAS | {"deliveries": schema("snapshot_ms:l batch_id:l address:s seq:l px:d sz:d")}
COLUMNS = PARTITIONS | {"deliveries": ["snapshot_ms"]}


def _store(spark: SparkSession, frozen=()) -> Store:
    return Store(spark, shared_path(spark, "store"), frozen, COLUMNS, KINDS)


def _rows(spark: SparkSession, items: list, kind: str) -> DataFrame:
    return spark.createDataFrame(items, kind)


# -- listing and reads -----------------------------------------------------------------------------------------------------


@query(f"SELECT coin, count(*)::BIGINT n, true AS listed, {ALL_TIME[0]}::BIGINT span_start, {ALL_TIME[1]}::BIGINT span_end FROM gaps WHERE coin IS NOT NULL AND start_ms IS NOT NULL GROUP BY coin")
def store_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table of one partition per coin: its partitions as listed, their rows and the interval written."""
    store, gaps = _store(spark), read(spark, d, "gaps").where("coin is not null and start_ms is not null")
    store.write_all("gaps", gaps, ALL_TIME, "start_ms")
    listed = _rows(spark, [(*p, store.exists("gaps", p), *store.spans("gaps", p)[0]) for p in store.partitions("gaps")], "coin string, listed boolean, span_start long, span_end long")
    n = store.scan("gaps").groupBy("coin").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(n, "coin").select("coin", "n", "listed", "span_start", "span_end")


@query(f"""WITH p AS (SELECT *, second // 86400 AS day FROM proxy WHERE coin IS NOT NULL AND second IS NOT NULL), c AS (SELECT min(coin) coin FROM p)
SELECT p.coin, p.second, p.low, p.high, p.last, p.n_trades FROM p JOIN c USING (coin) WHERE p.second * 1000 >= {LOW + DAY_MS // 2} AND p.second * 1000 < {HIGH + DAY_MS // 2}""")
def store_days_read(spark: SparkSession, d: str) -> DataFrame:
    """Prices of one coin over part of three days, out of one partition per coin and day."""
    rows = read(spark, d, "proxy").where("coin is not null and second is not null").withColumn("day", floor_div("second", 86_400)).withColumn("at_ms", F.col("second") * 1000)
    store = _store(spark)
    store.write_all("proxy", rows.drop("at_ms"), ALL_TIME, "second")
    coins = [p[0] for p in store.partitions("proxy")]
    return Repository(store).proxy(min(coins, default=""), LOW + DAY_MS // 2, HIGH + DAY_MS // 2).select("coin", "second", "low", "high", "last", "n_trades")


@query(f"""SELECT coin, start_ms, end_ms, reason FROM gaps WHERE coin = (SELECT coin FROM gaps WHERE coin IS NOT NULL AND start_ms IS NOT NULL GROUP BY coin ORDER BY count(*) DESC, coin LIMIT 1) AND start_ms IS NOT NULL AND start_ms < {HIGH} AND end_ms > {LOW}""")
def store_gaps_read(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of the coin with most of them that overlap a window, out of one partition per coin."""
    store, gaps = _store(spark), read(spark, d, "gaps").where("coin is not null and start_ms is not null")
    store.write_all("gaps", gaps, ALL_TIME, "start_ms")
    most = gaps.groupBy("coin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "coin").first()
    return Repository(store, HIGH).gaps(most.coin if most else "", LOW, HIGH)


@query("SELECT snapshot_ms, count(*)::BIGINT n, count(DISTINCT batch_id)::BIGINT batches FROM fill_snapshots WHERE snapshot_ms IS NOT NULL GROUP BY snapshot_ms")
def store_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots as listed, and what each holds."""
    store = _store(spark)
    store.write_all("deliveries", read(spark, d, "fill_snapshots").where("snapshot_ms is not null").select(*(f.name for f in KINDS["deliveries"].fields)), ALL_TIME, "snapshot_ms")
    listed = _rows(spark, [(s,) for s in Repository(store).snapshots("deliveries")], "snapshot_ms long")
    held = store.scan("deliveries").groupBy("snapshot_ms").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("batch_id").alias("batches"))
    return listed.join(held, "snapshot_ms")


# -- days of segments into tables ----------------------------------------------------------------------------------------------

_SILENCE = 1_800_000


@query(f"""WITH g AS (SELECT path, min(coin) coin, min(channel) channel, min(hour_ms) hour_ms, min(opened_ms) opened_ms, bool_or(closed) closed FROM segments WHERE path IS NOT NULL GROUP BY path),
dd AS (SELECT hour_ms // {DAY_MS} AS day FROM g WHERE channel IN ('bbo', 'book', 'trades') GROUP BY 1 HAVING bool_and(closed) AND hour_ms // {DAY_MS} < (SELECT max(hour_ms // {DAY_MS}) FROM g)),
m AS (SELECT r.*, g.coin, g.channel, g.hour_ms, g.opened_ms, dd.day FROM records r JOIN g USING (path) JOIN dd ON g.hour_ms // {DAY_MS} = dd.day WHERE g.channel IN ('bbo', 'book', 'trades') AND g.coin IS NOT NULL),
k AS (SELECT * FROM (SELECT *, min(struct_pack(recv_ms, opened_ms, path, record_no)) OVER (PARTITION BY coin, channel, conn_ms) f FROM m) WHERE struct_pack(recv_ms, opened_ms, path, record_no) > f),
j AS (SELECT * FROM k WHERE json_valid(raw)),
w AS (SELECT day, recv_ms // {DAY_MS} rd, coin, channel, recv_ms, conn_ms, CASE WHEN channel <> 'trades' THEN json_extract_string(raw, '$.data.time')::BIGINT END t FROM j WHERE channel <> 'trades' AND json_extract_string(raw, '$.data.coin') = coin
 UNION ALL SELECT day, recv_ms // {DAY_MS}, coin, channel, recv_ms, conn_ms, NULL FROM (SELECT *, unnest(CAST(json_extract(raw, '$.data') AS JSON[])) x FROM j WHERE channel = 'trades') WHERE json_extract_string(x, '$.coin') = coin),
b AS (SELECT coin, t, recv_ms, conn_ms, lag(t) OVER v pt, lag(conn_ms) OVER v pc, row_number() OVER v rn FROM w WHERE channel = 'book' AND t IS NOT NULL WINDOW v AS (PARTITION BY coin ORDER BY recv_ms, t, conn_ms)),
p AS (SELECT DISTINCT coin, pt, t, CASE WHEN conn_ms <> pc THEN 'disconnect' ELSE 'silence' END reason FROM b WHERE rn > 1 AND (conn_ms <> pc OR t - pt > {_SILENCE})),
c AS (SELECT dd.day, (SELECT count(*) FROM m WHERE m.day = dd.day) messages, (SELECT count(*) FROM k WHERE k.day = dd.day) kept, (SELECT count(*) FROM j WHERE j.day = dd.day) readable, (SELECT count(*) FROM w WHERE w.rd = dd.day) n_rows, (SELECT count(*) FROM p WHERE p.t // {DAY_MS} = dd.day) n_gaps,
 (SELECT count(DISTINCT path) FROM m WHERE m.day = dd.day) segments, (SELECT count(*) FROM w WHERE w.rd = dd.day AND channel <> 'trades') single, (SELECT count(*) FROM k WHERE k.day = dd.day AND channel <> 'trades') want FROM dd)
SELECT day, messages::BIGINT messages, (messages - kept)::BIGINT dropped_first, (kept - readable)::BIGINT unreadable, n_rows::BIGINT n_rows, n_gaps::BIGINT n_gaps, segments::BIGINT segments, kept = readable AND single = want whole FROM c""")
def day_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Every UTC day whose segments are all closed, as it goes into tables: messages, first ones dropped, rows, gaps, segments."""
    segments = distinct_segments(read(spark, d, "segments"))
    last = segments.agg(F.max(utc_day("hour_ms"))).first()[0]
    records = read(spark, d, "records").join(segments.drop("closed"), "path")
    return convert(records, due_days(segments, last or 0), max_silence_ms=_SILENCE).report


# -- writes ----------------------------------------------------------------------------------------------------------------

_FROZEN = (LOW + DAY_MS // 2, LOW + DAY_MS)


@query(f"""WITH t AS (SELECT coin, start_ms, end_ms, reason FROM gaps WHERE coin IS NOT NULL AND start_ms IS NOT NULL)
SELECT * FROM t WHERE start_ms < {LOW} OR start_ms >= {HIGH} OR (start_ms >= {_FROZEN[0]} AND start_ms < {_FROZEN[1]})
UNION ALL SELECT t.coin, t.start_ms, t.end_ms, t.reason FROM t WHERE t.coin NOT IN (SELECT coin FROM t WHERE reason = 'silence' AND start_ms >= {LOW} AND start_ms < {HIGH}) AND start_ms >= {LOW} AND start_ms < {HIGH} AND NOT (start_ms >= {_FROZEN[0]} AND start_ms < {_FROZEN[1]})
UNION ALL SELECT coin, start_ms, end_ms, 'again' FROM t WHERE reason = 'silence' AND start_ms >= {LOW} AND start_ms < {HIGH} AND NOT (start_ms >= {_FROZEN[0]} AND start_ms < {_FROZEN[1]})""")
def store_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned table after two of its days were replaced in all partitions that have new rows; half a day is frozen."""
    store, gaps = _store(spark, [_FROZEN]), read(spark, d, "gaps").where("coin is not null and start_ms is not null")
    store.write_all("gaps", gaps, ALL_TIME, "start_ms")
    new = gaps.where((F.col("reason") == "silence") & (F.col("start_ms") >= LOW) & (F.col("start_ms") < HIGH)).withColumn("reason", F.lit("again"))
    store.write_all("gaps", new, (LOW, HIGH), "start_ms")
    return store.scan("gaps").select("coin", "start_ms", "end_ms", "reason")


@query("SELECT address, field, count(*)::BIGINT n FROM (SELECT address, unnest(['px', 'sz']) field FROM fill_snapshots WHERE address = (SELECT min(address) FROM fill_snapshots) UNION ALL SELECT min(address), 'fee' FROM fill_snapshots HAVING min(address) IS NOT NULL) GROUP BY ALL")
def store_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that was appended to twice, read back."""
    rows = read(spark, d, "fill_snapshots")
    first = rows.agg(F.min("address")).first()[0]
    none = F.lit(None).cast("string")
    line = lambda df, field: df.select("address", "time_ms", "tid", F.lit(field).alias("field"), none.alias("old"), none.alias("new"), F.lit(0).cast("long").alias("detected_at_ms"))
    store, mine = _store(spark), rows.where(F.col("address") == first)
    if first is not None:
        store.append("divergences", (first,), line(mine, "px").unionByName(line(mine, "sz")))
        store.append("divergences", (first,), line(mine.limit(1), "fee"))
    return store.scan("divergences").groupBy("address", "field").agg(F.count(F.lit(1)).alias("n"))


_BODY = ["address", "coin", "time_ms", "px", "sz", "side", "start_position", "closed_pnl", "fee", "tid"]


@query(f"""WITH r AS (SELECT batch_id, snapshot_ms, {', '.join(_BODY)}, count(*) c FROM (SELECT * REPLACE (px + 0.0 AS px, sz + 0.0 AS sz, start_position + 0.0 AS start_position, closed_pnl + 0.0 AS closed_pnl, fee + 0.0 AS fee) FROM fill_snapshots) GROUP BY ALL),
o AS (SELECT batch_id, snapshot_ms, lag(snapshot_ms) OVER (PARTITION BY batch_id ORDER BY snapshot_ms) prev, lead(snapshot_ms) OVER (PARTITION BY batch_id ORDER BY snapshot_ms) nxt FROM (SELECT DISTINCT batch_id, snapshot_ms FROM fill_snapshots)),
x AS (SELECT batch_id, pair, {', '.join(_BODY)}, sum(c) n FROM (SELECT r.* EXCLUDE (snapshot_ms), o.snapshot_ms pair FROM r JOIN o USING (batch_id, snapshot_ms) WHERE prev IS NOT NULL UNION ALL SELECT r.* EXCLUDE (snapshot_ms) REPLACE (-c AS c), o.nxt FROM r JOIN o USING (batch_id, snapshot_ms) WHERE nxt IS NOT NULL) GROUP BY ALL HAVING sum(c) <> 0),
k AS (SELECT batch_id, pair, sum(CASE WHEN n < 0 THEN -n ELSE 0 END)::BIGINT removed, sum(CASE WHEN n > 0 THEN n ELSE 0 END)::BIGINT added FROM x GROUP BY ALL)
SELECT o.batch_id, o.snapshot_ms, CASE WHEN prev IS NULL THEN 'stored' WHEN k.pair IS NULL THEN 'untouched' ELSE 'replaced' END decision, coalesce(removed, 0)::BIGINT removed, coalesce(added, 0)::BIGINT added FROM o LEFT JOIN k ON k.batch_id = o.batch_id AND k.pair = o.snapshot_ms""")
def reingest_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each delivery of a batch, whatever the numbers of its rows: store it, leave alone what is equal, or replace it."""
    s = read(spark, d, "fill_snapshots").where("batch_id is not null and snapshot_ms is not null")
    near = W.partitionBy("batch_id").orderBy("snapshot_ms")  # a row per delivery
    order = s.select("batch_id", "snapshot_ms").distinct().withColumn("prev_", F.lag("snapshot_ms").over(near)).withColumn("next_", F.lead("snapshot_ms").over(near))
    s = s.join(order, ["batch_id", "snapshot_ms"])
    old = s.where("next_ is not null").select("batch_id", F.col("next_").alias("snapshot_ms"), *_BODY)
    diff = multiset_difference(s.where("prev_ is not null").select("batch_id", "snapshot_ms", *_BODY), old)
    more = lambda sign, name: F.sum(F.when(F.col("n_more") * sign > 0, F.abs("n_more")).otherwise(0)).alias(name)
    per = diff.groupBy("batch_id", "snapshot_ms").agg(more(-1, "removed"), more(1, "added"), F.lit(True).alias("changed_"))
    decision = F.when(F.col("prev_").isNull(), "stored").when(F.col("changed_"), "replaced").otherwise("untouched")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return join_same(order, per, ["batch_id", "snapshot_ms"], "left").select("batch_id", "snapshot_ms", decision.alias("decision"), zero("removed"), zero("added"))


_COVER = """c AS (SELECT address, batch_id, min(snapshot_ms) OVER (PARTITION BY batch_id) start_ms, snapshot_ms ingested_at_ms, count(*) n FROM fill_snapshots WHERE address IS NOT NULL GROUP BY address, batch_id, snapshot_ms),
k AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'failed' ELSE 'ok' END status, row_number() OVER (PARTITION BY address, batch_id ORDER BY ingested_at_ms DESC) rn FROM c)"""


@query(f"WITH {_COVER} SELECT address, batch_id, ingested_at_ms, n::BIGINT n_fills, status FROM k WHERE rn = 1")
def coverage_rows(spark: SparkSession, d: str) -> DataFrame:
    """The coverage row that stands for each account and window, of all that were recorded."""
    return latest_coverage(_coverage(spark, d), ["address", "batch_id"]).select("address", "batch_id", "ingested_at_ms", "n_fills", "status")


@query(f"WITH {_COVER} SELECT a.address FROM (SELECT address FROM fills UNION SELECT address FROM fill_snapshots) a WHERE a.address IS NOT NULL AND a.address NOT IN (SELECT address FROM k WHERE rn = 1 AND status = 'ok' AND batch_id = 1)")
def coverage_resume(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that still need fetching for the window of batch 1: those without a finished row of it."""
    done = latest_coverage(_coverage(spark, d), ["address", "batch_id"]).where("batch_id = 1").withColumn("end_ms", F.col("start_ms"))
    wanted = read(spark, d, "fills").select("address").union(read(spark, d, "fill_snapshots").select("address")).where("address is not null").distinct()
    start = done.agg(F.min("start_ms")).first()[0]
    return uncovered(wanted, done, start or 0, start or 0)


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "fill_snapshots").where("address is not null").groupBy("address", "batch_id", F.col("snapshot_ms").alias("ingested_at_ms")).agg(F.count(F.lit(1)).alias("n_fills"))
    first = rows.groupBy("batch_id").agg(F.min("ingested_at_ms").alias("start_ms"))
    return rows.join(first, "batch_id").withColumn("status", F.when(F.col("n_fills") % 7 == 0, "failed").otherwise("ok"))


@query(f"SELECT address, time_ms // {DAY_MS} AS day, count(*)::BIGINT n, true AS same_in_any_order, true AS sees_a_change FROM fills WHERE address IS NOT NULL AND time_ms IS NOT NULL GROUP BY ALL")
def content_checks(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of each account and day, held against that of the same rows in another order, and with one price changed."""
    from tideline.operators.storage import content_hashes

    f = read(spark, d, "fills").where("address is not null and time_ms is not null").withColumn("day", utc_day("time_ms"))
    by, keys = ["address", "day"], ["time_ms", "seq"]
    first = F.row_number().over(W.partitionBy(*by).orderBy(*keys)) == 1
    of = lambda df, name: content_hashes(df, by, keys).withColumnRenamed("sha256", name)
    plain, turned = of(f, "a"), of(f.sort(F.desc("seq"), F.desc("time_ms")), "b").drop("n")
    changed = of(f.withColumn("f_", first).withColumn("px", F.when(F.col("f_"), F.coalesce("px", F.lit(0.0)) + 1).otherwise(F.col("px"))).drop("f_"), "c").drop("n")
    return plain.join(turned, by).join(changed, by).select(*by, "n", (F.col("a") == F.col("b")).alias("same_in_any_order"), (F.col("a") != F.col("c")).alias("sees_a_change"))
