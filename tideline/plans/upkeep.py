"""Queries p1, p3, p4 and p6: compaction, late rows, intervals, changes between deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, day_start, utc_day
from tideline.operators.compaction import SegmentCompactor, distinct_segments, wrong_reports
from tideline.operators.intervals import Intervals
from tideline.operators.lateness import ON_TIME, LatePeriods
from tideline.operators.snapshots import SnapshotDiff
from tideline.session import shared_path, written
from tideline.sources.messages import event_time
from tideline.sources.tables import read

# -- 1: small files --------------------------------------------------------------------------------------------------


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    segments = read(spark, d, "segments")
    done = SegmentCompactor(segments, read(spark, d, "records")).run()
    days = wrong_reports(segments, read(spark, d, "day_reports"))
    return done.dropped.select(F.lit("record").alias("kind"), "hour_ms", "path", "record_no").unionByName(
        days.select(F.lit("day").alias("kind"), day_start("day").alias("hour_ms"), F.lit("-").alias("path"), F.lit(-1).cast("long").alias("record_no"))
    )


def p1_compact(spark: SparkSession, d: str) -> DataFrame:
    """Per coin, channel and day: records read, written and dropped as repeats; files, their least and greatest bytes of
    messages, by how much their receive times overlap; and whether the digests agree."""
    done = SegmentCompactor(read(spark, d, "segments"), read(spark, d, "records")).run()
    return done.digests.select("coin", "channel", "day", "n_source", "n_written", "n_dropped", "n_files", "least_bytes", "most_bytes", "overlap_ms", "ok")


# -- 3: late events --------------------------------------------------------------------------------------------------

STREAM = ["tbl", "coin", "channel"]


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    book = read(spark, d, "book").select(F.lit("book").alias("tbl"), "coin", F.lit("book").alias("channel"), F.col("time_ms").alias("event"), "recv_ms")
    segments = distinct_segments(read(spark, d, "segments")).select("path", "coin", "channel")
    records = read(spark, d, "records").join(segments, "path")
    return book.unionByName(records.select(F.lit("records").alias("tbl"), "coin", "channel", event_time("raw", "channel").alias("event"), "recv_ms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    late = LatePeriods(STREAM, "event", "recv_ms")
    judged = late.judge_all(arrivals(spark, d)).where(F.col("outcome") != ON_TIME)
    return judged.select(*STREAM, F.col("period_ms").alias("hour_ms"), "outcome").distinct()


def p3_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Per stream and hour of event time, corrected: rows, delays, and what came late or too late."""
    late = LatePeriods(STREAM, "event", "recv_ms", ["delay_ms"])
    rows = arrivals(spark, d).withColumn("delay_ms", F.col("recv_ms") - F.col("event"))
    out = late.combine(late.partials(late.judge_all(rows)))
    return out.select(*STREAM, F.col("period_ms").alias("hour_ms"), "n", F.col("sum_delay_ms").cast("long").alias("sum_delay_ms"), "n_on_time", "n_corrected", "n_dropped")


DELIVERIES = 6


def p3_ingested(spark: SparkSession, d: str) -> DataFrame:
    """The same out of a store to which the rows were added in deliveries, one after the other in receive order."""
    late = LatePeriods(STREAM, "event", "recv_ms", ["delay_ms"])
    rows = written(arrivals(spark, d).withColumn("delay_ms", F.col("recv_ms") - F.col("event")).where("event is not null and recv_ms is not null"), "arrivals")
    first, last = rows.agg(F.min("recv_ms"), F.max("recv_ms")).first()
    store, hour = shared_path(spark, "late-periods"), late.batch_ms
    first, last = (0, 0) if first is None else (first // hour, last // hour + 1)
    edges = [(first + (last - first) * i // DELIVERIES) * hour for i in range(DELIVERIES + 1)]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        out = late.ingest(spark, store, rows.where((F.col("recv_ms") >= low) & (F.col("recv_ms") < high)), n)
    out = late.combine(out)
    return out.select(*STREAM, F.col("period_ms").alias("hour_ms"), "n", F.col("sum_delay_ms").cast("long").alias("sum_delay_ms"), "n_on_time", "n_corrected", "n_dropped")


_P3_JUDGED = """
WITH seg AS (SELECT path, min(coin) coin, min(channel) channel FROM segments GROUP BY path),
ev AS (
  SELECT 'book' tbl, coin, 'book' channel, time_ms event, recv_ms FROM book
  UNION ALL
  SELECT 'records', coin, channel,
         TRY_CAST(CASE WHEN NOT json_valid(raw) THEN NULL WHEN channel = 'trades' THEN json_extract_string(raw, '$.data[0].time')
                       ELSE json_extract_string(raw, '$.data.time') END AS BIGINT), recv_ms
  FROM records JOIN seg USING (path)),
m AS (
  SELECT tbl, coin, channel, event, recv_ms, event - event % 3600000 AS hour_ms,
         max(event) OVER (PARTITION BY tbl, coin, channel ORDER BY recv_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM ev WHERE event IS NOT NULL AND recv_ms IS NOT NULL),
judged AS (
  SELECT *, CASE WHEN m > hour_ms + 10800000 THEN 'dropped' WHEN m >= hour_ms + 3600000 THEN 'corrected' ELSE 'on_time' END AS outcome FROM m)
"""

P3_FOUND = _P3_JUDGED + "SELECT DISTINCT tbl, coin, channel, hour_ms, outcome FROM judged WHERE outcome <> 'on_time'"
P3_HOURLY = (
    _P3_JUDGED
    + """SELECT tbl, coin, channel, hour_ms, CAST(count(*) FILTER (WHERE outcome <> 'dropped') AS BIGINT) n,
  CAST(sum(recv_ms - event) FILTER (WHERE outcome <> 'dropped') AS BIGINT) sum_delay_ms,
  CAST(count(*) FILTER (WHERE outcome = 'on_time') AS BIGINT) n_on_time, CAST(count(*) FILTER (WHERE outcome = 'corrected') AS BIGINT) n_corrected,
  CAST(count(*) FILTER (WHERE outcome = 'dropped') AS BIGINT) n_dropped FROM judged GROUP BY ALL"""
)

# -- 4: intervals ----------------------------------------------------------------------------------------------------


def _outages(spark: SparkSession, d: str) -> Intervals:
    return Intervals(read(spark, d, "gaps"), "coin", "start_ms", "end_ms", DAY_MS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    outages = _outages(spark, d)
    case = lambda df, kind: df.select(F.col("key").alias("coin"), F.lit(kind).alias("kind"), "start_ms", "end_ms")
    covered = outages.gaps().where(utc_day("start_ms") == utc_day("end_ms"))
    stated = read(spark, d, "day_coverage").where("coin is not null and day is not null and gap_ms is not null").select("coin", "day", "gap_ms").distinct()
    total = outages.totals().select(F.col("key").alias("coin"), F.col("bucket").alias("day"), "total_ms")
    wrong = stated.join(total, ["coin", "day"], "left").where("gap_ms != coalesce(total_ms, 0)").select("coin", "day").distinct()
    wrong = wrong.select(F.col("coin").alias("key"), day_start("day").alias("start_ms"), (day_start("day") + DAY_MS).alias("end_ms"))
    return case(outages.periods().where("several"), "outage").unionByName(case(covered, "covered")).unionByName(case(wrong, "day"))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """Every continuous outage and every stretch between two outages of a coin."""
    outages = _outages(spark, d)
    pick = lambda df, kind: df.select(F.col("key").alias("coin"), F.lit(kind).alias("kind"), "start_ms", "end_ms")
    return pick(outages.periods(), "outage").unionByName(pick(outages.gaps(), "covered"))


def p4_days(spark: SparkSession, d: str) -> DataFrame:
    """The right gap_ms of every coin and UTC day with an outage."""
    return _outages(spark, d).totals().select(F.col("key").alias("coin"), F.col("bucket").alias("day"), F.col("total_ms").alias("gap_ms"))


_P4_OUTAGES = """
WITH g AS (SELECT DISTINCT coin, start_ms s, end_ms e FROM gaps WHERE coin IS NOT NULL AND end_ms > start_ms),
f AS (SELECT *, max(e) OVER (PARTITION BY coin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM g),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY s, e) island FROM f),
o AS (SELECT coin, min(s) s, max(e) e, count(*) n FROM i GROUP BY coin, island),
c AS (SELECT coin, e s, lead(s) OVER (PARTITION BY coin ORDER BY s) e FROM o),
t AS (SELECT coin, day, sum(least(e, (day + 1) * 86400000) - greatest(s, day * 86400000)) ms
      FROM (SELECT coin, s, e, unnest(range(s // 86400000, (e - 1) // 86400000 + 1)) AS day FROM o) GROUP BY coin, day)
"""
P4_FOUND = (
    _P4_OUTAGES
    + """SELECT coin, 'outage' kind, s start_ms, e end_ms FROM o WHERE n > 1
UNION ALL SELECT coin, 'covered', s, e FROM c WHERE e IS NOT NULL AND s // 86400000 = e // 86400000
UNION ALL SELECT DISTINCT d.coin, 'day', d.day * 86400000, (d.day + 1) * 86400000 FROM day_coverage d LEFT JOIN t USING (coin, day)
  WHERE d.gap_ms IS NOT NULL AND d.coin IS NOT NULL AND d.day IS NOT NULL AND d.gap_ms <> coalesce(t.ms, 0)"""
)
P4_PERIODS = _P4_OUTAGES + "SELECT coin, 'outage' kind, s start_ms, e end_ms FROM o UNION ALL SELECT coin, 'covered', s, e FROM c WHERE e IS NOT NULL"
P4_DAYS = _P4_OUTAGES + "SELECT coin, day, CAST(ms AS BIGINT) gap_ms FROM t"

# -- 6: changes between deliveries -----------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    diff = SnapshotDiff(read(spark, d, "fill_snapshots"), "batch_id", "snapshot_ms", ["address", "seq"], read(spark, d, "snapshot_results"), "sha256")
    return diff.changes().select(F.col("batch_id").cast("long").alias("batch_id"), "snapshot_ms", "address", "seq", "change")


_P6_FIELDS = ["coin", "time_ms", "px", "sz", "side", "start_position", "closed_pnl", "fee", "tid"]
_P6_SAME = " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" for c in _P6_FIELDS)
P6_FOUND = f"""
WITH r AS (SELECT DISTINCT batch_id, snapshot_ms, address, seq, coin, time_ms, px + 0.0 px, sz + 0.0 sz, side, start_position + 0.0 start_position, closed_pnl + 0.0 closed_pnl, fee + 0.0 fee, tid FROM fill_snapshots),
x AS (SELECT batch_id, snapshot_ms, lag(snapshot_ms) OVER (PARTITION BY batch_id ORDER BY snapshot_ms) prev
      FROM (SELECT batch_id, snapshot_ms FROM fill_snapshots UNION SELECT batch_id, snapshot_ms FROM snapshot_results)),
nw AS (SELECT r.*, x.snapshot_ms pair FROM r JOIN x ON r.batch_id = x.batch_id AND r.snapshot_ms = x.snapshot_ms WHERE x.prev IS NOT NULL),
od AS (SELECT r.*, x.snapshot_ms pair FROM r JOIN x ON r.batch_id = x.batch_id AND r.snapshot_ms = x.prev)
SELECT coalesce(n.batch_id, o.batch_id) batch_id, coalesce(n.pair, o.pair) snapshot_ms, coalesce(n.address, o.address) address, coalesce(n.seq, o.seq) seq,
       CASE WHEN o.pair IS NULL THEN 'added' WHEN n.pair IS NULL THEN 'removed' ELSE 'changed' END change
FROM nw n FULL OUTER JOIN od o ON n.batch_id = o.batch_id AND n.pair = o.pair AND n.address = o.address AND n.seq = o.seq
WHERE n.pair IS NULL OR o.pair IS NULL OR NOT ({_P6_SAME})
"""

# equal raw: the same leaves at the same places, numbers by value; raw that is no JSON by its text
_P1_REPEATS = """
WITH s AS (SELECT path, min(coin) coin, min(channel) channel, min(hour_ms) hour_ms, min(opened_ms) opened_ms, bool_or(closed) closed FROM segments GROUP BY path),
r AS (SELECT row_number() OVER () id, * FROM records JOIN s USING (path)),
j AS (SELECT r.id, string_agg(t.fullkey || '=' || CASE WHEN t.type IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN t.atom::DOUBLE::VARCHAR ELSE t.type || t.atom END, chr(1) ORDER BY t.fullkey) v
      FROM r, json_tree(r.raw::JSON) t WHERE json_valid(r.raw) AND t.atom IS NOT NULL GROUP BY r.id),
k AS (SELECT r.*, coalesce('j' || j.v, 't' || r.raw) v FROM r LEFT JOIN j USING (id)),
f AS (SELECT *, min((opened_ms, path)) OVER (PARTITION BY coin, channel, conn_ms, recv_ms, v) fst FROM k)
"""
P1_FOUND = (
    _P1_REPEATS
    + """, n AS (SELECT hour_ms // 86400000 AS day, count(*) n FROM s WHERE closed GROUP BY ALL)
SELECT 'record' kind, hour_ms, path, record_no FROM f WHERE (opened_ms, path) > fst
UNION ALL SELECT DISTINCT 'day', p.day * 86400000, '-', -1::BIGINT FROM day_reports p LEFT JOIN n ON n.day = p.day WHERE p.deleted_segments IS NOT NULL AND p.day IS NOT NULL AND p.deleted_segments <> coalesce(n.n, 0)"""
)
# a day of one file, as all are that hold less than a file's worth
P1_COMPACT = (
    _P1_REPEATS
    + """SELECT coin, channel, hour_ms // 86400000 AS day, count(*)::BIGINT n_source, count(CASE WHEN (opened_ms, path) = fst THEN 1 END)::BIGINT n_written, count(CASE WHEN (opened_ms, path) > fst THEN 1 END)::BIGINT n_dropped,
 1::BIGINT n_files, sum(CASE WHEN (opened_ms, path) = fst THEN octet_length(encode(raw)) ELSE 0 END)::BIGINT least_bytes, sum(CASE WHEN (opened_ms, path) = fst THEN octet_length(encode(raw)) ELSE 0 END)::BIGINT most_bytes,
 0::BIGINT overlap_ms, true AS ok FROM f GROUP BY ALL"""
)

QUERIES = {f.__name__: f for f in (p1_found, p1_compact, p3_found, p3_hourly, p3_ingested, p4_found, p4_periods, p4_days, p6_found)}
SQL = {"p1_found": P1_FOUND, "p1_compact": P1_COMPACT, "p3_found": P3_FOUND, "p3_hourly": P3_HOURLY, "p3_ingested": P3_HOURLY, "p4_found": P4_FOUND, "p4_periods": P4_PERIODS, "p4_days": P4_DAYS, "p6_found": P6_FOUND}
