"""Reads, joins, aggregates, windows, ordered choices and multiset operations over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS, floor_div, hour_floor, iso_text, naive_ms, parse_utc_date, second_of, utc_day
from tideline.operators.choosing import block, first_meeting, funnel, hash_order, until_share
from tideline.operators.feeds import bars, day_coverage, drop_first, edge_rows, half_spreads, invalid_quote, message_gaps, message_rows, qualifying_days
from tideline.operators.intervals import Intervals, common
from tideline.operators.ordered import Runs, as_of
from tideline.operators.stats import nearest_ranks, ratio_summary, weighted_percentile
from tideline.operators.storage import Bounded, change_log, event_window, multiset_difference, overlapping, replace_interval, table_digest, window
from tideline.plans.registry import Registry
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

LOW, HIGH = 15702 * DAY_MS, 15704 * DAY_MS
D = DAY_MS
FILLS = "(SELECT DISTINCT * FROM fills)"


def fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills without rows repeated as a whole."""
    return read(spark, d, "fills").distinct()


# -- reads and predicates ------------------------------------------------------------------------------------------------


@query(f"SELECT address, seq, time_ms, coin, px, sz FROM fills WHERE time_ms >= {LOW} AND time_ms < {HIGH}")
def window_read(spark: SparkSession, d: str) -> DataFrame:
    return window(read(spark, d, "fills"), "time_ms", LOW, HIGH).select("address", "seq", "time_ms", "coin", "px", "sz")


@query(f"SELECT coin, start_ms, end_ms, reason FROM gaps WHERE start_ms < {HIGH} AND end_ms > {LOW}")
def overlap_read(spark: SparkSession, d: str) -> DataFrame:
    return overlapping(read(spark, d, "gaps"), "start_ms", "end_ms", LOW, HIGH)


@query(f"""SELECT coin, count(*)::BIGINT n, min(time_ms) first_ms, max(time_ms) last_ms FROM book
WHERE time_ms >= {LOW} AND time_ms < {HIGH} AND recv_ms // {D} BETWEEN {LOW // D - 1} AND {(HIGH - 1) // D + 1} GROUP BY coin""")
def extra_day_read(spark: SparkSession, d: str) -> DataFrame:
    book = read(spark, d, "book").withColumn("day", utc_day("recv_ms"))
    rows = event_window(book, "day", "time_ms", LOW, HIGH)
    return rows.groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


@query(f"SELECT coin, count(*)::BIGINT n, max(time_ms) last_ms FROM trades WHERE time_ms < {HIGH} GROUP BY coin")
def bounded_view(spark: SparkSession, d: str) -> DataFrame:
    return Bounded(HIGH).view(read(spark, d, "trades"), "time_ms").groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.max("time_ms").alias("last_ms"))


@query("""SELECT coin, CASE WHEN coin IN ('NUBUME', 'QUAYTH') THEN 'perp' WHEN contains(coin, ':') THEN 'hip3' WHEN starts_with(coin, '@') THEN 'spot'
 WHEN starts_with(coin, '#') THEN 'outcome' ELSE 'other' END AS kind, count(*)::BIGINT n FROM fills WHERE coin IS NOT NULL GROUP BY ALL""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    """Kind of instrument by name, first rule first; the listed names stand for an instrument table."""
    c = F.col("coin")
    kind = F.when(c.isin("NUBUME", "QUAYTH"), "perp").when(c.contains(":"), "hip3").when(c.startswith("@"), "spot").when(c.startswith("#"), "outcome").otherwise("other")
    return read(spark, d, "fills").where(c.isNotNull()).groupBy("coin", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coin, count(*)::BIGINT n, sum(CASE WHEN coalesce(bid_px_1 <= 0 OR ask_px_1 <= 0 OR bid_px_1 > ask_px_1 OR NOT isfinite(bid_px_1) OR NOT isfinite(ask_px_1), true) THEN 1 ELSE 0 END)::BIGINT n_bad
FROM book GROUP BY coin""")
def invalid_quotes(spark: SparkSession, d: str) -> DataFrame:
    bad = invalid_quote("bid_px_1", "ask_px_1")
    return read(spark, d, "book").groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_bad"))


@query("""SELECT 'fills' AS tbl, count(*)::BIGINT n, count(time_ms)::BIGINT time_ms, count(coin)::BIGINT coin, count(px)::BIGINT px, count(dir)::BIGINT dir, count(crossed)::BIGINT crossed, count(twap_id)::BIGINT twap_id,
count(*) FILTER (WHERE px IS NOT NULL AND sz IS NOT NULL AND start_position IS NOT NULL AND side IN ('A', 'B'))::BIGINT usable FROM fills""")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    cols = ["time_ms", "coin", "px", "dir", "crossed", "twap_id"]
    usable = F.col("px").isNotNull() & F.col("sz").isNotNull() & F.col("start_position").isNotNull() & F.col("side").isin("A", "B")
    return read(spark, d, "fills").agg(F.lit("fills").alias("tbl"), F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in cols), F.count(F.when(usable, 1)).alias("usable"))


@query("""SELECT DISTINCT time_ms // 86400000 AS day, strftime(make_timestamp(time_ms // 86400000 * 86400000000), '%Y-%m-%d') AS date_text, time_ms // 3600000 * 3600000 AS hour_ms, time_ms // 86400000 * 86400000 AS parsed_ms
FROM trades WHERE time_ms IS NOT NULL""")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Days and hours of trades, to text and back."""
    rows = read(spark, d, "trades").where("time_ms is not null").select(utc_day("time_ms").alias("day"), hour_floor("time_ms").alias("hour_ms")).distinct()
    text = F.substring(iso_text(F.col("day") * D), 1, 10)
    return rows.withColumn("date_text", text).withColumn("parsed_ms", parse_utc_date("date_text"))


@query("SELECT user_id % 5 AS coin, epoch_us(ts) // 3600000000 * 3600000 AS hour_ms, count(*)::BIGINT n FROM events GROUP BY ALL")
def zone_less_hours(spark: SparkSession, d: str) -> DataFrame:
    """Zone-less timestamps as milliseconds."""
    rows = read(spark, d, "events").select((F.col("user_id") % 5).alias("coin"), hour_floor(naive_ms("ts")).alias("hour_ms"))
    return rows.groupBy("coin", "hour_ms").agg(F.count(F.lit(1)).alias("n"))


# -- messages ------------------------------------------------------------------------------------------------------------


def _streams(spark: SparkSession, d: str, channel: str) -> DataFrame:
    segments = read(spark, d, "segments").where(F.col("channel") == channel).groupBy("path").agg(F.min("coin").alias("coin"), F.min("opened_ms").alias("opened_ms"))
    return read(spark, d, "records").join(segments, "path")


_REC = "(SELECT r.*, s.coin, s.opened_ms FROM records r JOIN (SELECT path, min(coin) coin, min(opened_ms) opened_ms FROM segments WHERE channel = '{}' GROUP BY path) s USING (path) WHERE json_valid(raw))"
_J = "json_extract_string(raw, '$.data.{}')"


@query(f"""SELECT coin, {_J.format('time')}::BIGINT time_ms, recv_ms, conn_ms, {', '.join(f"{_J.format(f'bbo[{i}].{w}')}::DOUBLE {s}_{w}" for i, s in enumerate(('bid', 'ask')) for w in ('px', 'sz'))}
FROM {_REC.format('bbo')} WHERE {_J.format('coin')} = coin""")
def message_bbo(spark: SparkSession, d: str) -> DataFrame:
    return message_rows(_streams(spark, d, "bbo"), "bbo")


@query(f"""SELECT coin, {_J.format('time')}::BIGINT time_ms, recv_ms, conn_ms, {', '.join(f"{_J.format(f'levels[{i}][{k - 1}].{w}')}::DOUBLE {s}_{w}_{k}" for i, s in enumerate(('bid', 'ask')) for k in range(1, 6) for w in ('px', 'sz'))}
FROM {_REC.format('book')} WHERE {_J.format('coin')} = coin""")
def message_book(spark: SparkSession, d: str) -> DataFrame:
    return message_rows(_streams(spark, d, "book"), "book")


@query(f"""WITH t AS (SELECT coin, recv_ms, conn_ms, unnest(CAST(json_extract(raw, '$.data') AS JSON[])) x FROM {_REC.format('trades')})
SELECT coin, json_extract_string(x, '$.time')::BIGINT time_ms, recv_ms, conn_ms, json_extract_string(x, '$.px')::DOUBLE px, json_extract_string(x, '$.sz')::DOUBLE sz, json_extract_string(x, '$.side') side,
 json_extract_string(x, '$.users[0]') buyer, json_extract_string(x, '$.users[1]') seller, json_extract_string(x, '$.tid')::BIGINT tid FROM t WHERE json_extract_string(x, '$.coin') = coin""")
def message_trades(spark: SparkSession, d: str) -> DataFrame:
    return message_rows(_streams(spark, d, "trades"), "trades")


@query("""WITH r AS (SELECT r.*, s.coin, s.channel, s.opened_ms FROM records r JOIN (SELECT path, min(coin) coin, min(channel) channel, min(opened_ms) opened_ms FROM segments GROUP BY path) s USING (path)),
k AS (SELECT *, row_number() OVER (PARTITION BY coin, channel, conn_ms ORDER BY recv_ms, opened_ms, path, record_no) rn FROM r)
SELECT coin, channel, count(*)::BIGINT messages, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END)::BIGINT dropped FROM k GROUP BY ALL""")
def drop_first_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages per stream, and how many are the first of their connection."""
    segments = read(spark, d, "segments").groupBy("path").agg(*(F.min(c).alias(c) for c in ("coin", "channel", "opened_ms")))
    rows = read(spark, d, "records").select("path", "record_no", "recv_ms", "conn_ms").join(segments, "path")
    kept = drop_first(rows, ["coin", "channel"], ["recv_ms", "opened_ms", "path", "record_no"])
    count = lambda df, n: df.groupBy("coin", "channel").agg(F.count(F.lit(1)).alias(n))
    out = count(rows, "messages").join(count(kept, "kept"), ["coin", "channel"], "left")
    return out.select("coin", "channel", "messages", (F.col("messages") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query("""WITH b AS (SELECT coin, time_ms, recv_ms, conn_ms, lag(time_ms) OVER w pt, lag(conn_ms) OVER w pc, row_number() OVER w rn FROM (SELECT DISTINCT coin, time_ms, recv_ms, conn_ms FROM book WHERE time_ms IS NOT NULL)
 WINDOW w AS (PARTITION BY coin ORDER BY recv_ms, time_ms, conn_ms))
SELECT coin, pt start_ms, time_ms end_ms, CASE WHEN conn_ms <> pc THEN 'disconnect' ELSE 'silence' END reason FROM b WHERE rn > 1 AND (conn_ms <> pc OR time_ms - pt > 1800000)""")
def gap_detect(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between consecutive book messages in receive order: another connection, or half an hour of silence."""
    points = read(spark, d, "book").select("coin", "time_ms", "recv_ms", "conn_ms").distinct()
    return message_gaps(points, "coin", ["time_ms", "conn_ms"], 1_800_000)


@query("""SELECT coin, min(struct_pack(time_ms, recv_ms)).time_ms first_ms, max(struct_pack(time_ms, recv_ms)).time_ms last_ms FROM book WHERE time_ms IS NOT NULL GROUP BY coin""")
def edge_points(spark: SparkSession, d: str) -> DataFrame:
    rows = edge_rows(read(spark, d, "book").where("time_ms is not null").select("coin", "time_ms", "recv_ms"), "coin", ["time_ms", "recv_ms"])
    return rows.select("coin", F.col("first.time_ms").alias("first_ms"), F.col("last.time_ms").alias("last_ms"))


# -- joins ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT DISTINCT coin, second, last FROM proxy), f AS (SELECT coin, time_ms, px FROM {FILLS} WHERE time_ms IS NOT NULL)
SELECT f.coin, count(*)::BIGINT n, count(CASE WHEN p.last > 0 AND f.px IS NOT NULL THEN 1 END)::BIGINT compared FROM f LEFT JOIN p ON f.coin IS NOT DISTINCT FROM p.coin AND f.time_ms // 1000 = p.second GROUP BY f.coin""")
def proxy_left_join(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "proxy").select(F.col("coin").alias("pc"), "second", "last").distinct()
    f = fills(spark, d).where("time_ms is not null")
    joined = f.join(p, F.col("coin").eqNullSafe(F.col("pc")) & (second_of("time_ms") == F.col("second")), "left")
    ok = (F.col("last") > 0) & F.col("px").isNotNull()
    return joined.groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("compared"))


_QUOTES = "(SELECT coin, time_ms, max(bid_px_1) bid FROM book WHERE time_ms IS NOT NULL AND coin IS NOT NULL GROUP BY ALL)"
_AT = f"(SELECT address, seq, coin, time_ms FROM {FILLS} WHERE time_ms IS NOT NULL AND coin IS NOT NULL)"


def _as_of_fills(spark: SparkSession, d: str, **how: bool) -> DataFrame:
    f = fills(spark, d).where("coin is not null").select("address", "seq", "coin", "time_ms")
    book = read(spark, d, "book").select("coin", "time_ms", F.col("bid_px_1").alias("bid"))
    out = as_of(f, book, ["coin"], "time_ms", "time_ms", ["bid"], **how)
    return out.select("address", "seq", "coin", F.col("r_time_ms").alias("book_ms"), F.col("r_bid").alias("bid"))


@query(f"SELECT l.address, l.seq, l.coin, r.time_ms book_ms, r.bid FROM {_AT} l ASOF LEFT JOIN {_QUOTES} r ON l.coin = r.coin AND l.time_ms >= r.time_ms")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_fills(spark, d)


@query(f"SELECT l.address, l.seq, l.coin, r.time_ms book_ms, r.bid FROM {_AT} l ASOF LEFT JOIN {_QUOTES} r ON l.coin = r.coin AND l.time_ms > r.time_ms")
def asof_strict_mark(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_fills(spark, d, strict=True)


@query(f"""SELECT l.address, l.seq, l.coin, r.time_ms book_ms, r.bid FROM {_AT} l
ASOF LEFT JOIN (SELECT coin, time_ms, CASE WHEN count(*) = count(bid_px_1) THEN min(bid_px_1) END bid FROM book WHERE time_ms IS NOT NULL AND coin IS NOT NULL GROUP BY ALL) r ON l.coin = r.coin AND l.time_ms <= r.time_ms""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _as_of_fills(spark, d, forward=True)


@query("""SELECT DISTINCT o.run_id, o.order_no, CASE WHEN o.side = 'buy' THEN p.high ELSE p.low END worst FROM copy_orders o JOIN (SELECT DISTINCT coin, second, low, high FROM proxy) p ON o.coin = p.coin AND o.exec_t // 1000 = p.second""")
def exact_bar(spark: SparkSession, d: str) -> DataFrame:
    """The bar of an order's second, at the price that is worse for it."""
    p = read(spark, d, "proxy").select("coin", "second", "low", "high").distinct()
    o = read(spark, d, "copy_orders").withColumn("second", second_of("exec_t"))
    return o.join(p, ["coin", "second"]).select("run_id", "order_no", F.when(F.col("side") == "buy", F.col("high")).otherwise(F.col("low")).alias("worst")).distinct()


_MERGE = """{n} AS (SELECT coin, min(s) s, max(e) e FROM (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM (
 SELECT *, max(e) OVER (PARTITION BY coin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM (SELECT DISTINCT coin, start_ms s, end_ms e FROM gaps WHERE coin IS NOT NULL AND end_ms > start_ms AND {c}))) GROUP BY coin, i)"""


@query(f"""WITH {_MERGE.format(n='a', c="reason = 'disconnect'")}, {_MERGE.format(n='b', c="reason = 'silence'")}
SELECT a.coin, greatest(a.s, b.s) start_ms, least(a.e, b.e) end_ms FROM a JOIN b ON a.coin = b.coin AND a.s < b.e AND b.s < a.e""")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    """When a coin was both disconnected and silent."""
    gaps = read(spark, d, "gaps")
    of = lambda r: Intervals(gaps.where(F.col("reason") == r), "coin", "start_ms", "end_ms")
    return common(of("disconnect"), of("silence")).withColumnRenamed("key", "coin")


@query("SELECT DISTINCT coin FROM fills WHERE coin IN (SELECT coin FROM proxy)")
def semi_proxied(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fills").select("coin").distinct().join(read(spark, d, "proxy").select("coin"), "coin", "left_semi")


@query("SELECT DISTINCT address FROM fills WHERE address IS NOT NULL AND address NOT IN (SELECT wallet FROM copy_orders WHERE wallet IS NOT NULL)")
def anti_uncopied(spark: SparkSession, d: str) -> DataFrame:
    wallets = read(spark, d, "copy_orders").select(F.col("wallet").alias("address"))
    return read(spark, d, "fills").select("address").where("address is not null").distinct().join(wallets, "address", "left_anti")


# -- aggregates ----------------------------------------------------------------------------------------------------------


@query("""SELECT coin, time_ms // 1000 slot, min(px) low, max(px) high, max(struct_pack(time_ms, tid, px)).px AS last, count(*)::BIGINT n_trades
FROM (SELECT DISTINCT coin, time_ms, tid, px FROM trades WHERE time_ms IS NOT NULL AND px IS NOT NULL) GROUP BY ALL""")
def second_bars(spark: SparkSession, d: str) -> DataFrame:
    return bars(read(spark, d, "trades").select("coin", "time_ms", "tid", "px").distinct(), ["coin"], "time_ms", "px", ["tid", "px"])


_NOTIONAL = "CAST(floor(coalesce(abs(sz) * px, 0) * 100 + 0.5) AS BIGINT)"


def _cents() -> Column:
    return F.floor(F.coalesce(F.abs("sz") * F.col("px"), F.lit(0.0)) * 100 + 0.5).cast("long")


@query(f"SELECT coin, sum({_NOTIONAL})::BIGINT notional_cents, count(*)::BIGINT n FROM {FILLS} WHERE coin IS NOT NULL GROUP BY coin ORDER BY notional_cents DESC, coin")
def asset_order(spark: SparkSession, d: str) -> DataFrame:
    rows = fills(spark, d).where("coin is not null").groupBy("coin").agg(F.sum(_cents()).alias("notional_cents"), F.count(F.lit(1)).alias("n"))
    return rows.orderBy(F.desc("notional_cents"), "coin")


@query(f"""SELECT sum({_NOTIONAL})::BIGINT all_cents, sum(CASE WHEN kind = 'perp' THEN {_NOTIONAL} ELSE 0 END)::BIGINT perp_cents, count(CASE WHEN liquidated_user IS NOT NULL THEN 1 END)::BIGINT liquidated,
count(DISTINCT address)::BIGINT wallets FROM {FILLS}""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return fills(spark, d).agg(F.sum(_cents()).alias("all_cents"), F.sum(F.when(F.col("kind") == "perp", _cents()).otherwise(0)).alias("perp_cents"), F.count("liquidated_user").alias("liquidated"), F.countDistinct("address").alias("wallets"))


def _nearest(p: int) -> str:
    return f"list_sort(list(x))[greatest(1, (count(*) * {p} + 99) // 100)]"


@query(f"SELECT coin, count(*)::BIGINT n, {', '.join(f'{_nearest(p)} p{p}' for p in (50, 95, 99))} FROM (SELECT coin, recv_ms - time_ms x FROM trades WHERE time_ms IS NOT NULL AND recv_ms IS NOT NULL) GROUP BY coin")
def latency_hist(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of delays from their histogram."""
    return nearest_ranks(read(spark, d, "trades"), ["coin"], F.col("recv_ms") - F.col("time_ms"), [50, 95, 99])


@query("SELECT coin, day FROM (SELECT coin, time_ms // 86400000 AS day, count(DISTINCT time_ms // 3600000) h FROM trades WHERE time_ms IS NOT NULL GROUP BY ALL) WHERE h >= 6")
def busy_days(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "trades").where("time_ms is not null").select("coin", utc_day("time_ms").alias("day"), hour_floor("time_ms").alias("h")).distinct()
    return rows.groupBy("coin", "day").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("coin", "day")


@query("""WITH d AS (SELECT DISTINCT coin, second // 86400 AS day FROM proxy WHERE last > 0), a AS (SELECT count(DISTINCT day) n FROM d) SELECT coin FROM d GROUP BY coin HAVING count(DISTINCT day) = (SELECT n FROM a)""")
def division_all_days(spark: SparkSession, d: str) -> DataFrame:
    """Coins with a price on every day that any coin has one."""
    days = read(spark, d, "proxy").where("last > 0").select("coin", floor_div("second", 86400).alias("day")).distinct()
    n = days.select("day").distinct().agg(F.count(F.lit(1)).alias("all_"))
    return days.groupBy("coin").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") == F.col("all_")).select("coin")


@query("""WITH h AS (SELECT DISTINCT coin, time_ms // 3600000 h FROM trades WHERE time_ms IS NOT NULL), r AS (SELECT coin, min(h) a, max(h) b FROM h GROUP BY coin),
e AS (SELECT coin, unnest(range(a, b + 1)) h FROM r) SELECT e.coin, e.h * 3600000 hour_ms FROM e ANTI JOIN h USING (coin, h)""")
def missing_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours without trades between a coin's first and last one."""
    h = read(spark, d, "trades").where("time_ms is not null").select("coin", hour_floor("time_ms").alias("hour_ms")).distinct()
    span = h.groupBy("coin").agg(F.min("hour_ms").alias("a"), F.max("hour_ms").alias("b"))
    return span.select("coin", F.explode(F.sequence("a", "b", F.lit(HOUR_MS))).alias("hour_ms")).join(h, ["coin", "hour_ms"], "left_anti")


@query("SELECT coin, second, count(*)::BIGINT n FROM proxy GROUP BY ALL HAVING count(*) > 1")
def repeated_seconds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "proxy").groupBy("coin", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""WITH u AS (SELECT DISTINCT coin FROM proxy), f AS (SELECT coin, sum({_NOTIONAL}) c FROM {FILLS} WHERE kind = 'hip3' GROUP BY coin)
SELECT u.coin, coalesce(f.c, 0)::BIGINT cents, u.coin IN ('NUBUME', 'QUAYTH') major FROM u LEFT JOIN f USING (coin)""")
def universe_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every coin of a universe, without activity as zero."""
    u = read(spark, d, "proxy").select("coin").distinct()
    f = fills(spark, d).where("kind = 'hip3'").groupBy("coin").agg(F.sum(_cents()).alias("c"))
    return u.join(f, "coin", "left").select("coin", F.coalesce("c", F.lit(0)).cast("long").alias("cents"), F.col("coin").isin("NUBUME", "QUAYTH").alias("major"))


@query("SELECT reason, side, count(*)::BIGINT n, count(CASE WHEN executed < requested THEN 1 END)::BIGINT cut, count(CASE WHEN exec_t > nominal_t THEN 1 END)::BIGINT delayed FROM (SELECT DISTINCT * FROM copy_orders) GROUP BY ALL")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "copy_orders").distinct()
    return o.groupBy("reason", "side").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("executed") < F.col("requested"), 1)).alias("cut"), F.count(F.when(F.col("exec_t") > F.col("nominal_t"), 1)).alias("delayed"))


# -- order statistics ----------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT coin, px x, n_trades w FROM (SELECT DISTINCT coin, second, last px, n_trades FROM proxy WHERE last IS NOT NULL)), h AS (SELECT coin, x, sum(w) w FROM v WHERE w > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY coin ORDER BY x) cum, sum(w) OVER (PARTITION BY coin) tot FROM h) SELECT coin, min(x) price, max(tot)::BIGINT weight FROM c WHERE cum * 100 >= tot * 95 GROUP BY coin""")
def weighted_p95(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile of prices, weighted by trades."""
    rows = read(spark, d, "proxy").where("last is not null").select("coin", "second", "last", "n_trades").distinct()
    return weighted_percentile(rows, ["coin"], "last", "n_trades", 95, "price")


@query(f"""WITH {_MERGE.format(n='o', c='true')}, q AS (SELECT coin, time_ms, time_ms // 86400000 AS day, bid_px_1 b, ask_px_1 a, coalesce(lead(time_ms) OVER (PARTITION BY coin, time_ms // 86400000 ORDER BY time_ms, recv_ms, conn_ms, bid_px_1 NULLS FIRST, ask_px_1 NULLS FIRST),
  (time_ms // 86400000 + 1) * 86400000) until FROM (SELECT DISTINCT coin, time_ms, recv_ms, conn_ms, bid_px_1, ask_px_1 FROM book WHERE time_ms IS NOT NULL AND coin IS NOT NULL)),
x AS (SELECT q.*, coalesce(a <= 0 OR b <= 0 OR b > a OR NOT isfinite(a) OR NOT isfinite(b), true) bad, coalesce((SELECT sum(greatest(0, least(o.e, q.until) - greatest(o.s, q.time_ms))) FROM o WHERE o.coin = q.coin AND o.s < q.until AND o.e > q.time_ms), 0) g FROM q),
h AS (SELECT coin, (a - b) / (a + b) * 1e4 v, sum(until - time_ms - g) w FROM x WHERE NOT bad AND until - time_ms - g > 0 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY coin ORDER BY v) cum, sum(w) OVER (PARTITION BY coin) tot FROM h), m AS (SELECT coin, min(v) v FROM c WHERE cum * 100 >= tot * 50 GROUP BY coin)
SELECT x.coin, max(m.v) half_spread_bps, count(CASE WHEN bad THEN 1 END)::BIGINT skipped FROM x JOIN m ON x.coin = m.coin GROUP BY x.coin""")
def half_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median half spread of each coin weighted by time, outside outages."""
    quotes = read(spark, d, "book").where("coin is not null").select("coin", "time_ms", "recv_ms", "conn_ms", F.col("bid_px_1").alias("bid_px"), F.col("ask_px_1").alias("ask_px")).distinct()
    quotes = quotes.withColumn("ord", F.struct("recv_ms", "conn_ms", "bid_px", "ask_px"))
    return half_spreads(quotes, read(spark, d, "gaps")).select("coin", "half_spread_bps", "skipped")


@query("""SELECT count(x)::BIGINT n, quantile_cont(x, 0.5) median, quantile_cont(x, 0.95) p95, quantile_cont(x, 0.99) p99, max(x) AS max, avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0.0 END) share_above
FROM (SELECT executed / requested x FROM copy_orders WHERE requested > 0 AND executed IS NOT NULL)""")
def executed_ratio(spark: SparkSession, d: str) -> DataFrame:
    return ratio_summary(read(spark, d, "copy_orders").where("requested > 0"), F.col("executed") / F.col("requested"), 0.5)


# -- ordered choices -----------------------------------------------------------------------------------------------------


@query("""SELECT address, rank, rank // 10 AS block FROM (SELECT address, row_number() OVER (ORDER BY sha256('7:pool:' || address), address) - 1 AS rank FROM (SELECT DISTINCT address FROM fills WHERE address IS NOT NULL))""")
def pool_sample(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in seeded hash order, in blocks of ten."""
    addresses = read(spark, d, "fills").select("address").where("address is not null").distinct()
    return block(hash_order(addresses, "address", "7:pool"), 10).select("address", "rank", "block")


@query(f"""WITH c AS (SELECT coin, sum({_NOTIONAL})::BIGINT cents, count(*)::BIGINT n FROM {FILLS} WHERE coin IS NOT NULL GROUP BY coin),
r AS (SELECT coin, row_number() OVER (ORDER BY cents DESC, coin) place FROM c WHERE n >= 50) SELECT c.coin, c.cents, c.n, c.n >= 50 meets, CAST(CASE WHEN r.place <= 8 THEN r.place END AS INTEGER) place FROM c LEFT JOIN r USING (coin)""")
def topk_condition(spark: SparkSession, d: str) -> DataFrame:
    """The eight coins of most notional among those with enough fills."""
    c = fills(spark, d).where("coin is not null").groupBy("coin").agg(F.sum(_cents()).alias("cents"), F.count(F.lit(1)).alias("n"))
    return first_meeting(c, F.col("n") >= 50, [F.desc("cents"), F.asc("coin")], 8)


_FACTS = f"""SELECT address, count(*)::BIGINT n, count(DISTINCT coin)::BIGINT coins, count(DISTINCT time_ms // 604800000)::BIGINT AS weeks, sum({_NOTIONAL})::BIGINT cents, count(liquidated_user)::BIGINT liquidated,
 sum(CASE WHEN crossed THEN {_NOTIONAL} ELSE 0 END)::BIGINT taker_cents FROM {FILLS} WHERE address IS NOT NULL GROUP BY address"""


def account_facts(spark: SparkSession, d: str) -> DataFrame:
    """Measures of all accounts in one pass."""
    return fills(spark, d).where("address is not null").groupBy("address").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("coin").alias("coins"), F.countDistinct(floor_div("time_ms", 7 * D)).alias("weeks"), F.sum(_cents()).alias("cents"), F.count("liquidated_user").alias("liquidated"),
        F.sum(F.when(F.col("crossed"), _cents()).otherwise(0)).alias("taker_cents"),
    )


@query(_FACTS)
def wallet_facts(spark: SparkSession, d: str) -> DataFrame:
    return account_facts(spark, d)


STAGES = [("fills", "n >= 20"), ("weeks", "weeks >= 2"), ("coins", "coins between 2 and 40"), ("taker", "taker_cents * 2 >= cents"), ("liquidated", "liquidated = 0")]


@query(
    f"WITH f AS ({_FACTS}), s AS (SELECT CASE "
    + " ".join(f"WHEN NOT coalesce({c}, false) THEN {i}" for i, (_, c) in enumerate(STAGES))
    + f" ELSE {len(STAGES)} END k FROM f), g AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, (n, _) in enumerate(STAGES))}) v(stage_no, stage))"
    + " SELECT g.stage_no::INTEGER stage_no, g.stage, (SELECT count(*) FROM s WHERE k >= g.stage_no)::BIGINT entered, (SELECT count(*) FROM s WHERE k = g.stage_no)::BIGINT removed FROM g"
)
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many accounts each of a list of conditions removes, in order. The conditions are an example."""
    return funnel(account_facts(spark, d), [(n, F.expr(c)) for n, c in STAGES])


@query(f"""WITH c AS (SELECT coin, sum({_NOTIONAL})::BIGINT cents FROM {FILLS} WHERE coin IS NOT NULL GROUP BY coin),
r AS (SELECT *, sum(cents) OVER (ORDER BY cents DESC, coin)::BIGINT cumulative, sum(cents) OVER ()::BIGINT total FROM c) SELECT coin, cents, cumulative, total FROM r WHERE cumulative - cents < total * 0.5""")
def greedy_additions(spark: SparkSession, d: str) -> DataFrame:
    """Coins by notional until they hold half of it."""
    c = fills(spark, d).where("coin is not null").groupBy("coin").agg(F.sum(_cents()).alias("cents"))
    return until_share(c, "cents", [F.desc("cents"), F.asc("coin")], 0.5)


@query("""SELECT k, i, address, place FROM (SELECT k, i, address, row_number() OVER (PARTITION BY k, i ORDER BY sha256('7:controle:' || k || ':' || i || ':' || address), address)::INTEGER place
FROM (SELECT DISTINCT wallet address FROM copy_orders WHERE wallet IS NOT NULL), (SELECT unnest([3, 5]) k), (SELECT unnest(range(20)) i)) WHERE place <= k""")
def control_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Twenty seeded control groups of 3 and of 5 accounts each: a stated number of draws from all candidates."""
    wallets = read(spark, d, "copy_orders").select(F.col("wallet").alias("address")).where("address is not null").distinct()
    draws = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).cast("long").alias("i")) for k in (3, 5) for i in range(20))))
    rows = wallets.select("address", draws.alias("x")).select("address", "x.k", "x.i")
    h = F.sha2(F.concat_ws(":", F.lit("7:controle"), "k", "i", "address"), 256)
    place = F.row_number().over(W.partitionBy("k", "i").orderBy("h", "address"))  # a top-k: partial ranks cut each draw before it moves
    return rows.withColumn("h", h).withColumn("place", place).where("place <= k").select("k", "i", "address", "place")


@query("""WITH r AS (SELECT DISTINCT run_id, order_no, exec_t FROM copy_orders WHERE exec_t IS NOT NULL AND run_id IS NOT NULL)
SELECT run_id, max(n)::BIGINT busiest FROM (SELECT run_id, count(*) OVER (PARTITION BY run_id ORDER BY exec_t RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) n FROM r) GROUP BY run_id""")
def sliding_budget(spark: SparkSession, d: str) -> DataFrame:
    """The most orders of a run within any minute."""
    rows = read(spark, d, "copy_orders").where("exec_t is not null and run_id is not null").select("run_id", "order_no", "exec_t").distinct()
    # a minute reaches back into the bucket before: each row also stands in the next bucket, where it is only counted
    both = F.explode(F.array(F.struct(F.lit(0).alias("late"), floor_div("exec_t", 60_000).alias("b")), F.struct(F.lit(1).alias("late"), (floor_div("exec_t", 60_000) + 1).alias("b"))))
    near = W.partitionBy("run_id", "b").orderBy("exec_t").rangeBetween(-59_999, 0)
    return rows.select("run_id", "exec_t", both.alias("x")).select("run_id", "exec_t", "x.*").withColumn("n", F.count(F.lit(1)).over(near)).where("late = 0").groupBy("run_id").agg(F.max("n").alias("busiest"))


# -- multisets and writes ------------------------------------------------------------------------------------------------

_SNAP = ["coin", "time_ms", "px", "sz", "side", "start_position", "closed_pnl", "fee", "tid"]


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last delivery of every batch."""
    s = read(spark, d, "fill_snapshots")
    edge = s.groupBy("batch_id").agg(F.min("snapshot_ms").alias("a"), F.max("snapshot_ms").alias("b"))
    s = s.join(edge, "batch_id")
    cols = ["batch_id", "address", *_SNAP]
    return s.where("snapshot_ms = a").select(*cols), s.where("snapshot_ms = b").select(*cols)


_EDGE = "(SELECT s.* EXCLUDE (snapshot_ms, seq) FROM fill_snapshots s JOIN (SELECT batch_id, {f}(snapshot_ms) m FROM fill_snapshots GROUP BY batch_id) USING (batch_id) WHERE snapshot_ms = m)"


@query(f"""WITH x AS (SELECT *, 1 n FROM {_EDGE.format(f='min')} UNION ALL SELECT *, -1 FROM {_EDGE.format(f='max')})
SELECT batch_id, address, coin, time_ms, px, sz, side, start_position, closed_pnl, fee, tid, sum(n)::BIGINT n FROM x GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the first delivery of a batch has more or less often than its last."""
    return multiset_difference(*_deliveries(spark, d)).withColumnRenamed("n_more", "n")


_REST = ", ".join(f"{c} NULLS LAST" for c in _SNAP if c not in ("time_ms", "tid"))


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY batch_id, address, time_ms, tid ORDER BY {_REST}) k FROM (FROM {_EDGE.format(f='min')} EXCEPT ALL FROM {_EDGE.format(f='max')})),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, address, time_ms, tid ORDER BY {_REST}) k FROM (FROM {_EDGE.format(f='max')} EXCEPT ALL FROM {_EDGE.format(f='min')}))
SELECT coalesce(o.batch_id, n.batch_id) batch_id, unnest(CASE WHEN n.k IS NULL THEN ['row_removed'] WHEN o.k IS NULL THEN ['row_added'] ELSE [{', '.join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in _SNAP if c not in ('time_ms', 'tid'))}] END) field
FROM o FULL OUTER JOIN n ON o.batch_id = n.batch_id AND o.address = n.address AND o.time_ms IS NOT DISTINCT FROM n.time_ms AND o.tid IS NOT DISTINCT FROM n.tid AND o.k = n.k""".join(["SELECT batch_id, field, count(*)::BIGINT n FROM (", ") WHERE field IS NOT NULL GROUP BY ALL"]))
def divergence_log(spark: SparkSession, d: str) -> DataFrame:
    """Which fields changed how often between the first and the last delivery."""
    log = change_log(*_deliveries(spark, d), ["batch_id", "address", "time_ms", "tid"])
    return log.groupBy("batch_id", "field").agg(F.count(F.lit(1)).alias("n"))


def _successive(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """For every delivery of a batch but the first, the rows of the one before it and its own, under its snapshot_ms."""
    s = read(spark, d, "fill_snapshots").where("batch_id is not null and snapshot_ms is not null")
    # a row per delivery, not per fill
    near = W.partitionBy("batch_id").orderBy("snapshot_ms")
    order = s.select("batch_id", "snapshot_ms").distinct().withColumn("prev_", F.lag("snapshot_ms").over(near)).withColumn("next_", F.lead("snapshot_ms").over(near))
    s = s.join(order, ["batch_id", "snapshot_ms"])
    cols = ["address", *_SNAP]
    old = s.where("next_ is not null").select("batch_id", F.col("next_").alias("snapshot_ms"), *cols)
    return old, s.where("prev_ is not null").select("batch_id", "snapshot_ms", *cols)


_EACH = "(SELECT s.* EXCLUDE (snapshot_ms, seq), o.{at} snapshot_ms FROM fill_snapshots s JOIN (SELECT batch_id, snapshot_ms m, snapshot_ms own, lag(snapshot_ms) OVER w p, lead(snapshot_ms) OVER w n FROM (SELECT DISTINCT batch_id, snapshot_ms FROM fill_snapshots WHERE snapshot_ms IS NOT NULL) WINDOW w AS (PARTITION BY batch_id ORDER BY snapshot_ms)) o ON s.batch_id = o.batch_id AND s.snapshot_ms = o.m WHERE o.{has} IS NOT NULL)"
_OLD, _NEW = _EACH.format(at="n", has="n"), _EACH.format(at="own", has="p")


@query(f"""WITH x AS (SELECT *, 1 n FROM {_OLD} UNION ALL BY NAME SELECT *, -1 n FROM {_NEW})
SELECT batch_id, snapshot_ms, address, coin, time_ms, px, sz, side, start_position, closed_pnl, fee, tid, sum(n)::BIGINT n FROM x GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_diff_each(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the delivery before has more or less often than the delivery at snapshot_ms, for every delivery of a batch."""
    return multiset_difference(*_successive(spark, d)).withColumnRenamed("n_more", "n")


@query(SQL["divergence_log"].replace(_EDGE.format(f="min"), _OLD).replace(_EDGE.format(f="max"), _NEW).replace("batch_id, address, time_ms", "batch_id, snapshot_ms, address, time_ms")
.replace("coalesce(o.batch_id, n.batch_id) batch_id,", "coalesce(o.batch_id, n.batch_id) batch_id, coalesce(o.snapshot_ms, n.snapshot_ms) snapshot_ms,").replace("o.batch_id = n.batch_id AND", "o.batch_id = n.batch_id AND o.snapshot_ms = n.snapshot_ms AND").replace("SELECT batch_id, field,", "SELECT batch_id, snapshot_ms, field,"))
def divergence_log_each(spark: SparkSession, d: str) -> DataFrame:
    """Which fields changed how often from one delivery to the next, for every delivery."""
    log = change_log(*_successive(spark, d), ["batch_id", "snapshot_ms", "address", "time_ms", "tid"])
    return log.groupBy("batch_id", "snapshot_ms", "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT coin, time_ms, tid, px, 'old' AS version FROM trades WHERE time_ms < {LOW} OR time_ms >= {HIGH} OR (time_ms >= {LOW + D // 2} AND time_ms < {LOW + D})
UNION ALL SELECT coin, time_ms, tid, px, 'new' FROM trades WHERE side = 'A' AND time_ms >= {LOW} AND time_ms < {HIGH} AND NOT (time_ms >= {LOW + D // 2} AND time_ms < {LOW + D})""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    """A table after two of its days are replaced, half a day of which is frozen."""
    t = read(spark, d, "trades").select("coin", "time_ms", "tid", "px", "side")
    new = t.where("side = 'A'").withColumn("version", F.lit("new"))
    return replace_interval(t.withColumn("version", F.lit("old")), new, "time_ms", (LOW, HIGH), [(LOW + D // 2, LOW + D)]).drop("side")


@query("SELECT count(*)::BIGINT n, count(DISTINCT (coin, time_ms, recv_ms, tid))::BIGINT distinct_rows FROM trades")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "trades").select("coin", "time_ms", "recv_ms", "tid")
    return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct_rows"))


@query()
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    """Order-free digest of a table."""
    return table_digest(read(spark, d, "fills"))


# -- windows -------------------------------------------------------------------------------------------------------------


@query("""SELECT coin, time_ms // 86400000 AS day, sum(coalesce(nt, (time_ms // 86400000 + 1) * 86400000) - time_ms)::BIGINT held_ms, count(*)::BIGINT n
FROM (SELECT coin, time_ms, lead(time_ms) OVER (PARTITION BY coin, time_ms // 86400000 ORDER BY time_ms) nt FROM (SELECT DISTINCT coin, time_ms FROM book WHERE time_ms IS NOT NULL)) GROUP BY ALL""")
def hold_weights(spark: SparkSession, d: str) -> DataFrame:
    """How long the quotes of a day stood in all."""
    rows = read(spark, d, "book").where("time_ms is not null").select("coin", "time_ms").distinct().withColumn("day", utc_day("time_ms"))
    until = F.coalesce(F.lead("time_ms").over(W.partitionBy("coin", "day").orderBy("time_ms")), (F.col("day") + 1) * D)
    return rows.withColumn("held", until - F.col("time_ms")).groupBy("coin", "day").agg(F.sum("held").alias("held_ms"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT DISTINCT coin, time_ms, tid, sz FROM trades WHERE time_ms IS NOT NULL AND tid IS NOT NULL), r AS (SELECT *, CAST(floor(sz * 100 + 0.5) AS BIGINT) u FROM t)
SELECT coin, time_ms, tid, sum(u) OVER w::BIGINT AS volume, lag(time_ms) OVER w prev_time_ms FROM r WINDOW w AS (PARTITION BY coin ORDER BY time_ms, tid, sz ROWS UNBOUNDED PRECEDING)""")
def running_volume(spark: SparkSession, d: str) -> DataFrame:
    """Running volume and previous trade of every coin, without ordering a coin as a whole."""
    t = read(spark, d, "trades").where("tid is not null").select("coin", "time_ms", "tid", "sz").distinct()
    units = F.coalesce(F.floor(F.col("sz") * 100 + 0.5).cast("long"), F.lit(0))
    rows = Runs(t, ["coin"], "time_ms", ["tid", "sz"]).running(volume=units)
    return Runs(rows, ["coin"], "time_ms", ["tid", "sz"]).previous(["time_ms"]).select("coin", "time_ms", "tid", "volume", "prev_time_ms")


_LATEST = "(SELECT max(t) FROM (SELECT time_ms t FROM trades UNION ALL SELECT end_ms FROM gaps WHERE coin IS NOT NULL AND end_ms > start_ms))"


@query(f"""WITH {_MERGE.format(n='o', c='true')}, w AS (SELECT coin, min(time_ms) since FROM trades WHERE time_ms IS NOT NULL GROUP BY coin HAVING min(time_ms) <= {_LATEST}),
d AS (SELECT coin, since, unnest(range(since // {D}, {_LATEST} // {D} + 1)) AS day FROM w),
x AS (SELECT *, day * {D} a, least((day + 1) * {D}, {_LATEST}) b FROM d WHERE least((day + 1) * {D}, {_LATEST}) > day * {D})
SELECT x.coin, x.day, coalesce((SELECT sum(greatest(0, least(o.e, x.b) - greatest(o.s, x.a))) FROM o WHERE o.coin = x.coin AND o.s < x.b AND o.e > x.a), 0)::BIGINT gap_ms, greatest(0, since - a)::BIGINT unrecorded_ms, (b - a)::BIGINT observed_ms, (day + 1) * {D} <= {_LATEST} AS complete FROM x""")
def coverage_to_date(spark: SparkSession, d: str) -> DataFrame:
    """Each coin's days since its first trade: outage, unrecorded and observed time, as of the latest instant of trades and gaps."""
    trades, gaps = read(spark, d, "trades").where("time_ms is not null"), read(spark, d, "gaps")
    latest = trades.select("time_ms").unionByName(gaps.where("coin is not null and end_ms > start_ms").select(F.col("end_ms").alias("time_ms"))).agg(F.max("time_ms")).first()[0]
    since = trades.groupBy("coin").agg(F.min("time_ms").alias("since_ms"))
    return day_coverage(Intervals(gaps, "coin", "start_ms", "end_ms"), since, latest or 0)


@query("SELECT coin, day FROM (SELECT coin, day, row_number() OVER (PARTITION BY coin ORDER BY day) k FROM (SELECT DISTINCT coin, day FROM day_coverage WHERE complete AND (observed_ms - gap_ms - unrecorded_ms) * 100 >= observed_ms * 80)) WHERE k <= 3")
def qualifying(spark: SparkSession, d: str) -> DataFrame:
    """The first three complete days of each coin covered by at least 80 percent, as stated."""
    return qualifying_days(read(spark, d, "day_coverage"), 80, 3)
