"""Queries that look the data over: shares, profiles, regularity, bands, projections, and what delayed followers would pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, utc_day
from tideline.operators import account as acc
from tideline.operators.feeds import open_silence
from tideline.operators.panel import delayed, executions, quotes_around
from tideline.plans.account import _PARTS, _PNL, _steps
from tideline.plans.registry import Registry
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

DELAYS_MS = [1_000, 5_000, 30_000]


@query(f"""WITH ev AS (SELECT DISTINCT run_id, order_no, coin, side, event_t FROM copy_orders WHERE coin IS NOT NULL AND event_t IS NOT NULL),
x AS (SELECT ev.*, d delay_ms, event_t + d nominal_t, (event_t + d) // 1000 ns FROM ev, (SELECT unnest({DELAYS_MS})::BIGINT d)),
b AS (SELECT coin, second, low, high, last FROM (SELECT DISTINCT coin, second, low, high, last FROM proxy)),
f AS (SELECT coin, second, min(struct_pack(low, high)).low AS low, min(struct_pack(low, high)).high AS high FROM b GROUP BY ALL), g AS (SELECT coin, second, max(last) AS last FROM b GROUP BY ALL),
y AS (SELECT x.*, f.second xs, f.low, f.high FROM x ASOF LEFT JOIN f ON x.coin = f.coin AND x.ns <= f.second),
z AS (SELECT y.*, g.last mark FROM y ASOF LEFT JOIN g ON y.coin = g.coin AND y.xs > g.second)
SELECT run_id, order_no, delay_ms, CASE WHEN xs = ns THEN nominal_t ELSE xs * 1000 END exec_t, CASE WHEN side = 'buy' THEN high ELSE low END exec_px, CASE WHEN xs IS NOT NULL THEN mark END mark FROM z""")
def delayed_executions(spark: SparkSession, d: str) -> DataFrame:
    """When and at what price each order would have been executed at several delays, and the price known just before.

    Of a second listed twice, the bar with the least low and high counts for execution, the greatest last price as mark.
    """
    events = read(spark, d, "copy_orders").where("coin is not null and event_t is not null").select("run_id", "order_no", "coin", "side", "event_t").distinct()
    bars = read(spark, d, "proxy").select("coin", "second", "low", "high", "last").distinct()
    out = executions(delayed(events, "event_t", DELAYS_MS), bars)
    return out.select("run_id", "order_no", "delay_ms", "exec_t", "exec_px", "mark")


@query("""WITH c AS (SELECT coin, sum(CAST(floor(coalesce(abs(sz) * px, 0) * 100 + 0.5) AS BIGINT))::BIGINT cents FROM (SELECT DISTINCT * FROM fills) WHERE coin IS NOT NULL GROUP BY coin)
SELECT coin, cents, round(cents / sum(cents) OVER (), 9) AS share, round(sum(cents) OVER (ORDER BY cents DESC, coin) / sum(cents) OVER (), 9) AS cumulative FROM c""")
def notional_shares(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.coalesce(F.abs("sz") * F.col("px"), F.lit(0.0)) * 100 + 0.5).cast("long")
    c = read(spark, d, "fills").distinct().where("coin is not null").groupBy("coin").agg(F.sum(cents).alias("cents"))
    total, upto = F.sum("cents").over(W.partitionBy()), F.sum("cents").over(W.orderBy(F.desc("cents"), "coin"))  # one row per coin
    return c.select("coin", "cents", F.round(F.col("cents") / total, 9).alias("share"), F.round(upto / total, 9).alias("cumulative"))


@query("""SELECT coin, count(*)::BIGINT n, count(buyer)::BIGINT with_buyer, count(seller)::BIGINT with_seller, count(CASE WHEN buyer = seller THEN 1 END)::BIGINT self_trades,
count(CASE WHEN recv_ms < time_ms THEN 1 END)::BIGINT received_early FROM trades GROUP BY coin""")
def both_sides(spark: SparkSession, d: str) -> DataFrame:
    early, own = F.when(F.col("recv_ms") < F.col("time_ms"), 1), F.when(F.col("buyer") == F.col("seller"), 1)
    return read(spark, d, "trades").groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.count("buyer").alias("with_buyer"), F.count("seller").alias("with_seller"), F.count(own).alias("self_trades"), F.count(early).alias("received_early"))


@query("""SELECT channel, count(*)::BIGINT segments, sum(size_bytes)::BIGINT bytes, sum(coalesce(n_records, 0))::BIGINT records, count(CASE WHEN n_records IS NULL THEN 1 END)::BIGINT unknown, count(CASE WHEN n_records = 0 THEN 1 END)::BIGINT empty,
(sum(size_bytes) * 45 // count(DISTINCT hour_ms // 86400000))::BIGINT projected_bytes FROM (SELECT DISTINCT * FROM segments) GROUP BY channel""")
def recording_profile(spark: SparkSession, d: str) -> DataFrame:
    """Segments per channel, and their size carried on linearly to 45 days."""
    s = read(spark, d, "segments").distinct()
    projected = F.call_function("div", F.sum("size_bytes") * 45, F.countDistinct(utc_day("hour_ms")))
    return s.groupBy("channel").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("size_bytes").alias("bytes"), F.sum(F.coalesce("n_records", F.lit(0))).alias("records"), F.count(F.when(F.col("n_records").isNull(), 1)).alias("unknown"),
        F.count(F.when(F.col("n_records") == 0, 1)).alias("empty"), projected.alias("projected_bytes"),
    )


@query("""WITH r AS (SELECT path, count(*) n FROM records GROUP BY path), s AS (SELECT path, max(n_records) m FROM segments GROUP BY path)
SELECT CASE WHEN s.m IS NULL THEN 'unknown' WHEN coalesce(r.n, 0) = s.m THEN 'agrees' WHEN coalesce(r.n, 0) < s.m THEN 'fewer' ELSE 'more' END AS verdict, count(*)::BIGINT n FROM s LEFT JOIN r USING (path) GROUP BY ALL""")
def stated_records(spark: SparkSession, d: str) -> DataFrame:
    """Stated against counted records per segment."""
    r = read(spark, d, "records").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    s = read(spark, d, "segments").groupBy("path").agg(F.max("n_records").alias("m")).join(r, "path", "left")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(F.col("m").isNull(), "unknown").when(n == F.col("m"), "agrees").when(n < F.col("m"), "fewer").otherwise("more")
    return s.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT field, count(*)::BIGINT n FROM (SELECT unnest(json_keys(CASE WHEN json_type(raw, '$.data') = 'ARRAY' THEN json_extract(raw, '$.data[0]') ELSE json_extract(raw, '$.data') END)) field FROM records WHERE json_valid(raw)) GROUP BY field""")
def message_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which fields messages carry, expected or not."""
    r = read(spark, d, "records").where(F.try_parse_json("raw").isNotNull())
    item = F.coalesce(F.get_json_object("raw", "$.data[0]"), F.get_json_object("raw", "$.data"))
    return r.select(F.explode(F.json_object_keys(item)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT address, min(time_ms) // 86400000 a, max(time_ms) // 86400000 b, count(DISTINCT time_ms // 86400000)::BIGINT n FROM fills WHERE address IS NOT NULL AND time_ms IS NOT NULL GROUP BY address)
SELECT CASE WHEN b - a + 1 = n THEN 'every day' WHEN n = 1 THEN 'one day' WHEN n * 2 >= b - a + 1 THEN 'most days' ELSE 'few days' END AS kind, count(*)::BIGINT accounts, sum(n)::BIGINT AS days FROM f GROUP BY ALL""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """Accounts by how regularly they act between their first and last day."""
    days = read(spark, d, "fills").where("address is not null and time_ms is not null").select("address", utc_day("time_ms").alias("day")).distinct()
    f = days.groupBy("address").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count(F.lit(1)).alias("n"))
    span = F.col("b") - F.col("a") + 1
    kind = F.when(span == F.col("n"), "every day").when(F.col("n") == 1, "one day").when(F.col("n") * 2 >= span, "most days").otherwise("few days")
    return f.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("days"))


@query(f"""WITH {_PARTS} SELECT CASE WHEN n_fills <= 2 THEN '1-2' WHEN n_fills <= 10 THEN '3-10' WHEN n_fills <= 100 THEN '11-100' ELSE '101+' END band, opened_from_flat, closed IS NULL still_open, count(*)::BIGINT n, sum(n_fills)::BIGINT fills FROM ep GROUP BY ALL""")
def episode_bands(spark: SparkSession, d: str) -> DataFrame:
    """Episodes by number of fills."""
    n = F.col("n_fills")
    band = F.when(n <= 2, "1-2").when(n <= 10, "3-10").when(n <= 100, "11-100").otherwise("101+")
    e = acc.episodes(acc.parts(_steps(spark, d)))
    return e.groupBy(band.alias("band"), "opened_from_flat", F.col("closed").isNull().alias("still_open")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_fills").alias("fills"))


@query(f"WITH {_PNL}, t AS (SELECT unnest([0.001, 0.01, 0.1, 1, 10, 100])::DOUBLE tolerance_bps) SELECT tolerance_bps, count(*)::BIGINT n, count(CASE WHEN bps <= tolerance_bps THEN 1 END)::BIGINT n_within FROM checked, t GROUP BY tolerance_bps")
def concordance(spark: SparkSession, d: str) -> DataFrame:
    """How many whole episodes agree with their reported result, at rising tolerances."""
    off = acc.pnl_divergence(acc.episodes(acc.parts(_steps(spark, d))))
    steps = F.explode(F.array(*(F.lit(float(t)) for t in (0.001, 0.01, 0.1, 1, 10, 100))))
    rows = off.select("divergence_bps", steps.alias("tolerance_bps"))
    return rows.groupBy("tolerance_bps").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("divergence_bps") <= F.col("tolerance_bps"), 1)).alias("n_within"))


@query("""SELECT reason, count(CASE WHEN side = 'buy' THEN 1 END)::BIGINT buy, count(CASE WHEN side = 'sell' THEN 1 END)::BIGINT sell FROM (SELECT DISTINCT * FROM copy_orders) GROUP BY reason""")
def reason_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "copy_orders").distinct().groupBy("reason").pivot("side", ["buy", "sell"]).agg(F.count(F.lit(1)))
    return o.select("reason", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("buy", "sell")))


@query(f"""SELECT day, n_rows::BIGINT stated, (SELECT count(*) FROM book WHERE recv_ms // {DAY_MS} = r.day)::BIGINT counted FROM (SELECT DISTINCT day, n_rows FROM day_reports WHERE day IS NOT NULL AND n_rows IS NOT NULL) r""")
def stated_days(spark: SparkSession, d: str) -> DataFrame:
    """Stated rows per day beside the book rows received that day."""
    b = read(spark, d, "book").groupBy(utc_day("recv_ms").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    r = read(spark, d, "day_reports").where("day is not null and n_rows is not null").select("day", F.col("n_rows").alias("stated")).distinct()
    return r.join(b, "day", "left").select("day", "stated", F.coalesce("c", F.lit(0)).cast("long").alias("counted"))


@query("""WITH q AS (SELECT coin, time_ms, max(struct_pack(a := coalesce(bid_px_1, -1), b := coalesce(ask_px_1, -1))) x, min(struct_pack(a := coalesce(bid_px_1, -1), b := coalesce(ask_px_1, -1))) y FROM book WHERE coin IS NOT NULL AND time_ms IS NOT NULL GROUP BY ALL),
o AS (SELECT DISTINCT run_id, order_no, coin, side, exec_t FROM copy_orders WHERE coin IS NOT NULL AND exec_t IS NOT NULL),
l AS (SELECT o.*, q.time_ms before_ms, nullif(q.x.a, -1) bb, nullif(q.x.b, -1) ba FROM o ASOF LEFT JOIN q ON o.coin = q.coin AND o.exec_t >= q.time_ms),
r AS (SELECT l.*, q.time_ms after_ms, nullif(q.y.a, -1) ab, nullif(q.y.b, -1) aa FROM l ASOF LEFT JOIN q ON l.coin = q.coin AND l.exec_t <= q.time_ms)
SELECT run_id, order_no, before_ms, after_ms, CASE WHEN side = 'buy' THEN CASE WHEN ba IS NULL THEN aa WHEN aa IS NULL THEN ba ELSE greatest(ba, aa) END ELSE CASE WHEN bb IS NULL THEN ab WHEN ab IS NULL THEN bb ELSE least(bb, ab) END END px FROM r""")
def quotes_around_orders(spark: SparkSession, d: str) -> DataFrame:
    """The worse of the quotes around each order."""
    o = read(spark, d, "copy_orders").where("coin is not null and exec_t is not null").select("run_id", "order_no", "coin", "side", "exec_t").distinct()
    q = read(spark, d, "book").where("coin is not null").select("coin", "time_ms", F.col("bid_px_1").alias("bid"), F.col("ask_px_1").alias("ask"))
    return quotes_around(o, q, "exec_t").select("run_id", "order_no", "before_ms", "after_ms", "px")


@query("""WITH b AS (SELECT coin, max(struct_pack(recv_ms, time_ms)).time_ms start_ms FROM book WHERE time_ms IS NOT NULL GROUP BY coin), n AS (SELECT max(time_ms) // 86400000 * 86400000 now FROM book)
SELECT coin, start_ms, now end_ms, 'silence' reason FROM b, n WHERE now - start_ms > 600000""")
def open_silences(spark: SparkSession, d: str) -> DataFrame:
    """Coins that are silent at the start of the newest day."""
    points = read(spark, d, "book").select("coin", "time_ms", "recv_ms")
    now = points.agg(F.max("time_ms")).first()[0] or 0
    return open_silence(points, "coin", now // DAY_MS * DAY_MS, 600_000)
