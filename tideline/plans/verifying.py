"""Queries that check what was collected: fields, breaks and their circumstances, hypotheses on results, recordings, names, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div, second_of, utc_day
from tideline.operators import account as acc
from tideline.operators.feeds import gap_measure, invalid_quote
from tideline.operators.intervals import Intervals
from tideline.operators.ordered import Runs
from tideline.operators.selection import compared, notional
from tideline.operators.stats import interpolated, nearest_ranks
from tideline.plans.account import _PARTS, _STEPS, _steps
from tideline.plans.registry import Registry
from tideline.plans.simulating import _MARKED, _copies
from tideline.session import written
from tideline.sources.messages import channel_and_coin, event_time, times_in
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

PAGE = 200  # fills a page, for what lies across the edge of one
_CENTS = "CAST(floor(coalesce(abs(sz) * px, 0) * 100 + 0.5) AS BIGINT)"


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


# -- fields ------------------------------------------------------------------------------------------------------------------

#: What a usable value is, per field.
_VALID = {
    "time_ms": "time_ms > 0", "px": "px > 0 AND NOT isnan(px)", "sz": "sz > 0 AND NOT isnan(sz)", "side": "side IN ('A', 'B')", "start_position": "NOT isnan(start_position)", "closed_pnl": "NOT isnan(closed_pnl)",
    "tid": "tid > 0", "oid": "oid > 0", "coin": "length(coin) > 0", "dir": "length(dir) > 0",
}


@query(" UNION ALL ".join(f"SELECT '{f}' field, count({f})::BIGINT present, count(CASE WHEN {c} THEN 1 END)::BIGINT usable, count(*)::BIGINT n FROM fills" for f, c in _VALID.items()))
def field_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field of fills: how many rows have it, and how many have a value that can be used."""
    each = [F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").alias("present"), F.col(f"u_{f}").alias("usable")) for f in _VALID]
    counts = read(spark, d, "fills").agg(F.count(F.lit(1)).alias("n"), *(x for f, c in _VALID.items() for x in (F.count(f).alias(f"p_{f}"), _count(F.expr(c)).alias(f"u_{f}"))))
    return counts.select("n", F.explode(F.array(*each)).alias("x")).select("x.*", "n")


@query(r"""SELECT path, len(t)::BIGINT n_times, list_min(t) first_ms, list_max(t) last_ms, count(*)::BIGINT n FROM (SELECT path, list_transform(regexp_extract_all(raw, '"time"\s*:\s*(\d+)', 1), lambda x: x::BIGINT) t FROM records WHERE raw IS NOT NULL) GROUP BY ALL""")
def raw_times(spark: SparkSession, d: str) -> DataFrame:
    """All instants in raw messages, whether they can be read as a whole or not, and what spans they make."""
    t = read(spark, d, "records").where("raw is not null").select("path", times_in("raw").alias("t"))
    return t.groupBy("path", F.size("t").cast("long").alias("n_times"), F.array_min("t").alias("first_ms"), F.array_max("t").alias("last_ms")).agg(F.count(F.lit(1)).alias("n"))


# -- breaks ------------------------------------------------------------------------------------------------------------------

_POS = f"""{_STEPS}, ps AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY time_ms, seq, coin) pos FROM s),
pp AS (SELECT *, lag(pos) OVER w pos_a, lag(sz) OVER w psz, lag(seq) OVER w pseq FROM ps WINDOW w AS (PARTITION BY address, coin ORDER BY time_ms, seq))"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Steps with their place among all of an account's fills, and the place, size and number of the coin's fill before."""
    s = _steps(spark, d).select("address", "coin", "kind", "seq", "time_ms", "sz", "start_position", "expected", "prev_t", "broke")
    s = Runs(s, ["address"], "time_ms", ["seq", "coin"]).running(pos=F.lit(1).cast("long"))
    return Runs(s, acc.KEYS, "time_ms", ["seq"]).previous(["pos", "sz", "seq"])


@query(f"""WITH {_POS}, bd AS (SELECT pp.*, d.dir, e.l OR d.l liquidated FROM pp LEFT JOIN (SELECT address, seq, min(dir) dir, bool_or(liquidated_user IS NOT NULL) l FROM fills GROUP BY ALL) d ON pp.address = d.address AND pp.pseq = d.seq
 LEFT JOIN (SELECT address, seq, bool_or(liquidated_user IS NOT NULL) l FROM fills GROUP BY ALL) e ON pp.address = e.address AND pp.seq = e.seq WHERE broke)
SELECT dir prev_dir, abs(start_position - expected) >= psz jump, liquidated, count(*)::BIGINT n, max(time_ms - prev_t)::BIGINT longest_ms FROM bd GROUP BY ALL""")
def break_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Breaks by the direction before, whether a whole fill may be missing, and whether a liquidation is near."""
    broken = _placed(spark, d).where("broke")
    of = read(spark, d, "fills").groupBy("address", "seq").agg(F.min("dir").alias("dir_"), F.bool_or(F.col("liquidated_user").isNotNull()).alias("l_"))
    before = of.withColumnsRenamed({"seq": "prev_seq", "dir_": "prev_dir", "l_": "a_"})
    rows = broken.join(before, ["address", "prev_seq"], "left").join(of.select("address", "seq", F.col("l_").alias("b_")), ["address", "seq"], "left")
    jump = F.abs(F.col("start_position") - F.col("expected")) >= F.col("prev_sz")
    return rows.groupBy("prev_dir", jump.alias("jump"), (F.col("a_") | F.col("b_")).alias("liquidated")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("time_ms") - F.col("prev_t")).alias("longest_ms"))


@query(f"WITH {_POS} SELECT address, coin, pos_a, pos pos_b, prev_t t_a, time_ms t_b FROM pp WHERE broke")
def break_list(spark: SparkSession, d: str) -> DataFrame:
    """Every break with the places of its two fills among all of the account's."""
    return _placed(spark, d).where("broke").select("address", "coin", F.col("prev_pos").alias("pos_a"), F.col("pos").alias("pos_b"), F.col("prev_t").alias("t_a"), F.col("time_ms").alias("t_b"))


@query(f"""WITH {_POS} SELECT CASE WHEN pos - pos_a = 1 THEN '1' WHEN pos - pos_a <= 10 THEN '2-10' WHEN pos - pos_a <= 100 THEN '11-100' WHEN pos - pos_a <= 1000 THEN '101-1000' ELSE '1001+' END band, broke, count(*)::BIGINT pairs,
count(CASE WHEN (pos_a - 1) // {PAGE} <> (pos - 1) // {PAGE} THEN 1 END)::BIGINT crossing FROM pp WHERE pos_a IS NOT NULL GROUP BY ALL""")
def page_straddle(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fills of a coin by how far apart they lie, broken or not, and how many lie across the edge of a page."""
    rows = _placed(spark, d).where("has_prev").withColumn("far", F.col("pos") - F.col("prev_pos"))
    far, page = F.col("far"), lambda c: floor_div(F.col(c) - 1, PAGE)
    band = F.when(far == 1, "1").when(far <= 10, "2-10").when(far <= 100, "11-100").when(far <= 1000, "101-1000").otherwise("1001+")
    return rows.groupBy(band.alias("band"), "broke").agg(F.count(F.lit(1)).alias("pairs"), _count(page("prev_pos") != page("pos")).alias("crossing"))


# -- simple episodes and what their results may mean -----------------------------------------------------------------------------

_SIMPLE = f"""{_STEPS}, g0 AS (SELECT s.*, f.fee, af = 0 OR bf * af < 0 AS ends, bf * af < 0 inverts FROM s LEFT JOIN (SELECT address, seq, min(fee) fee FROM fills GROUP BY ALL) f USING (address, seq)),
g1 AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY address, coin ORDER BY time_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) seg FROM g0),
g2 AS (SELECT *, max(CASE WHEN bf = 0 THEN 1 ELSE 0 END) OVER v started, max(CASE WHEN bf = 0 THEN 1 ELSE 0 END) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before_ FROM g1 WINDOW v AS (PARTITION BY address, coin, seg ORDER BY time_ms, seq)),
se AS (SELECT address, coin, seg, count(*)::BIGINT n, CASE WHEN bool_or(inverts) THEN 'inversion' WHEN bool_or(ends) THEN 'flat' ELSE 'open' END ended, NOT bool_or(broke AND coalesce(before_, 0) = 1) clean, sum(-signed * px) gross, sum(closed_pnl) reported, sum(fee) fees,
 sum(CASE WHEN bf * signed < 0 THEN fee ELSE 0 END) closing_fees, bool_or(closed_pnl IS NULL OR fee IS NULL) unknown FROM g2 WHERE started = 1 GROUP BY ALL)"""


def _simple(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that begin at zero and end at zero or by turning; what turns is not followed until it is at zero again."""
    fees = read(spark, d, "fills").groupBy("address", "seq").agg(F.min("fee").alias("fee"))
    s = _steps(spark, d).join(fees, ["address", "seq"], "left")
    inverts = F.col("before") * F.col("after") < 0
    s = s.withColumn("inverts", inverts).withColumn("ends", inverts | (F.col("after") == 0)).select(*acc.KEYS, "seq", "time_ms", "before", "signed", "px", "closed_pnl", "fee", "broke", "inverts", "ends")
    rows = Runs(s, acc.KEYS, "time_ms", ["seq"]).running(upto_=F.col("ends").cast("long")).withColumn("seg", F.col("upto_") - F.col("ends").cast("long"))
    zero = (F.col("before") == 0).cast("int")
    rows = Runs(rows.drop("upto_"), [*acc.KEYS, "seg"], "time_ms", ["seq"]).running_max(started=zero)
    rows = Runs(rows, [*acc.KEYS, "seg"], "time_ms", ["seq"]).previous(["started"]).where("started = 1")
    ended = F.when(F.bool_or("inverts"), "inversion").when(F.bool_or("ends"), "flat").otherwise("open")
    return rows.groupBy(*acc.KEYS, "seg").agg(
        F.count(F.lit(1)).alias("n"), ended.alias("ended"), (~F.bool_or(F.col("broke") & (F.coalesce("prev_started", F.lit(0)) == 1))).alias("clean"), F.sum(-F.col("signed") * F.col("px")).alias("gross"), F.sum("closed_pnl").alias("reported"), F.sum("fee").alias("fees"),
        F.sum(F.when(F.col("before") * F.col("signed") < 0, F.col("fee")).otherwise(0.0)).alias("closing_fees"), F.bool_or(F.col("closed_pnl").isNull() | F.col("fee").isNull()).alias("unknown"),
    )


@query(f"WITH {_SIMPLE} SELECT ended, clean, count(*)::BIGINT episodes, sum(n)::BIGINT fills FROM se GROUP BY ALL")
def simple_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes from zero by how they end, and whether every fill began where the one before ended."""
    return _simple(spark, d).groupBy("ended", "clean").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("fills"))


_BAND = "CASE WHEN n <= 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END"
_NEAR = lambda x: f"abs(reported - ({x})) <= greatest(tol * greatest(abs(reported), abs({x})), tol)"


@query(f"""WITH {_SIMPLE} SELECT {_BAND} band, tol, count(*)::BIGINT tested, count(CASE WHEN fees > tol THEN 1 END)::BIGINT fee_matters, count(CASE WHEN {_NEAR('gross')} THEN 1 END)::BIGINT gross, count(CASE WHEN {_NEAR('gross - fees')} THEN 1 END)::BIGINT net_all,
count(CASE WHEN {_NEAR('gross - closing_fees')} THEN 1 END)::BIGINT net_close FROM se, (SELECT unnest([0.001, 0.05, 1.0])::DOUBLE tol) WHERE ended = 'flat' AND clean AND NOT unknown GROUP BY ALL""")
def result_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """What a reported result may be: before fees, after all of them, or after those of closing; by size and tolerance."""
    rows = _simple(spark, d).where("ended = 'flat' and clean and not unknown").withColumn("tol", F.explode(F.array(*(F.lit(t) for t in (0.001, 0.05, 1.0)))))
    near = lambda x: F.expr(_NEAR(x))
    return rows.groupBy(F.expr(_BAND).alias("band"), "tol").agg(
        F.count(F.lit(1)).alias("tested"), _count(F.col("fees") > F.col("tol")).alias("fee_matters"), _count(near("gross")).alias("gross_"), _count(near("gross - fees")).alias("net_all"), _count(near("gross - closing_fees")).alias("net_close")
    ).withColumnRenamed("gross_", "gross")


@query(f"""WITH {_STEPS}, xo AS (SELECT s.*, f.fee FROM s LEFT JOIN (SELECT address, seq, min(fee) fee FROM fills GROUP BY ALL) f USING (address, seq) WHERE (bf = 0 OR sign(bf) = sign(signed)) AND NOT broke)
SELECT kind, count(*)::BIGINT open_fills, count(CASE WHEN abs(closed_pnl) <= 0.001 THEN 1 END)::BIGINT zero, count(CASE WHEN abs(closed_pnl + fee) <= 0.001 THEN 1 END)::BIGINT minus_fee FROM xo GROUP BY kind""")
def opening_results(spark: SparkSession, d: str) -> DataFrame:
    """Fills that only open: whether their reported result is nothing, or less their fee."""
    fees = read(spark, d, "fills").groupBy("address", "seq").agg(F.min("fee").alias("fee"))
    x = _steps(spark, d).where("opens and not broke").join(fees, ["address", "seq"], "left")
    return x.groupBy("kind").agg(F.count(F.lit(1)).alias("open_fills"), _count(F.abs("closed_pnl") <= 0.001).alias("zero"), _count(F.abs(F.col("closed_pnl") + F.col("fee")) <= 0.001).alias("minus_fee"))


# -- prices against the book -----------------------------------------------------------------------------------------------------


@query(f"""WITH q AS (SELECT coin, time_ms // 1000 AS second, max(struct_pack(time_ms, m := (bid_px_1 + ask_px_1) / 2)).m m FROM book WHERE coin IS NOT NULL AND time_ms IS NOT NULL AND bid_px_1 > 0 AND ask_px_1 > 0 AND bid_px_1 <= ask_px_1 AND isfinite(bid_px_1) AND isfinite(ask_px_1) GROUP BY ALL),
f AS (SELECT fl.coin, fl.time_ms // {DAY_MS} AS day, (fl.px / q.m - 1) * 1e4 bps FROM (SELECT DISTINCT address, seq, coin, time_ms, px FROM fills) fl JOIN q ON fl.coin = q.coin AND fl.time_ms // 1000 = q.second WHERE px IS NOT NULL),
m AS (SELECT coin, day, median(bps) v FROM f GROUP BY ALL) SELECT f.coin, count(*)::BIGINT n, round(quantile_cont(abs(bps - v), 0.5), 6) median_off, round(quantile_cont(abs(bps - v), 0.95), 6) p95_off FROM f JOIN m USING (coin, day) GROUP BY f.coin""")
def mid_deviation(spark: SparkSession, d: str) -> DataFrame:
    """How far fills lie from the mid price of their second, less the day's median, pooled over days."""
    mid = F.max(F.struct("time_ms", ((F.col("bid_px_1") + F.col("ask_px_1")) / 2).alias("m")))["m"]
    book = read(spark, d, "book").where(~invalid_quote("bid_px_1", "ask_px_1")).where("coin is not null and time_ms is not null")
    q = book.groupBy("coin", second_of("time_ms").alias("second")).agg(mid.alias("last"))
    f = read(spark, d, "fills").select("address", "seq", "coin", "time_ms", "px").distinct()
    rows = written(compared(f, q).where("bps is not null"), "mid-differences")
    levels = interpolated(rows, ["coin", "day"], F.col("bps"), {"v": 0.5}).drop("n")
    off = rows.join(levels, ["coin", "day"]).withColumn("off", F.abs(F.col("bps") - F.col("v")))
    out = interpolated(off, ["coin"], F.col("off"), {"median_off": 0.5, "p95_off": 0.95})
    return out.select("coin", "n", F.round("median_off", 6).alias("median_off"), F.round("p95_off", 6).alias("p95_off"))


# -- recordings --------------------------------------------------------------------------------------------------------------------

_REC = "(SELECT r.*, g.coin, g.channel FROM records r JOIN (SELECT path, min(coin) coin, min(channel) channel FROM segments GROUP BY path) g USING (path))"


@query(f"""WITH r AS (SELECT *, TRY_CAST(CASE WHEN NOT json_valid(raw) THEN NULL WHEN channel = 'trades' THEN json_extract_string(raw, '$.data[0].time') ELSE json_extract_string(raw, '$.data.time') END AS BIGINT) ev FROM {_REC}),
l AS (SELECT channel, list_sort(list(recv_ms - ev)) v, count(*) c FROM r WHERE ev IS NOT NULL AND recv_ms IS NOT NULL GROUP BY channel),
g AS (SELECT channel, count(CASE WHEN recv_ms - p > 600000 THEN 1 END)::BIGINT long_gaps FROM (SELECT channel, recv_ms, lag(recv_ms) OVER (PARTITION BY coin, channel ORDER BY recv_ms) p FROM r WHERE recv_ms IS NOT NULL) GROUP BY channel)
SELECT r.channel, count(*)::BIGINT messages, sum(strlen(raw))::BIGINT bytes, count(CASE WHEN recv_ms < ev THEN 1 END)::BIGINT early, any_value({'v[greatest(1, (l.c * 50 + 99) // 100)]'}) p50, any_value(v[greatest(1, (l.c * 95 + 99) // 100)]) p95, any_value(v[greatest(1, (l.c * 99 + 99) // 100)]) p99, any_value(long_gaps) long_gaps
FROM r LEFT JOIN l ON l.channel = r.channel LEFT JOIN g ON g.channel = r.channel GROUP BY r.channel""")
def recording_delays(spark: SparkSession, d: str) -> DataFrame:
    """Messages, bytes, delays and long silences of every channel."""
    seg = read(spark, d, "segments").groupBy("path").agg(F.min("coin").alias("coin"), F.min("channel").alias("channel"))
    r = read(spark, d, "records").join(seg, "path").select("coin", "channel", "recv_ms", F.octet_length("raw").alias("size"), event_time("raw", "channel").alias("ev"))
    r = written(r, "message-times")
    per = r.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.sum("size").cast("long").alias("bytes"), _count(F.col("recv_ms") < F.col("ev")).alias("early"))
    delay = nearest_ranks(r, ["channel"], F.col("recv_ms") - F.col("ev"), [50, 95, 99]).drop("n")
    gaps = Runs(r.select("coin", "channel", "recv_ms"), ["coin", "channel"], "recv_ms", []).previous(["recv_ms"]).groupBy("channel").agg(_count(F.col("recv_ms") - F.col("prev_recv_ms") > 600_000).alias("long_gaps"))
    return per.join(delay, "channel", "left").join(gaps, "channel", "left")


@query("SELECT coin, count(*)::BIGINT n, count(CASE WHEN buyer IS NOT NULL AND seller IS NOT NULL THEN 1 END)::BIGINT AS both_sides, count(DISTINCT side)::BIGINT sides FROM trades JOIN (SELECT coin, min(time_ms) a FROM trades GROUP BY coin) USING (coin) WHERE time_ms < a + 600000 GROUP BY coin")
def first_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Whether both sides are named, in the first ten minutes of each coin's trades."""
    t = read(spark, d, "trades").where("coin is not null")
    a = t.groupBy("coin").agg(F.min("time_ms").alias("a"))
    rows = t.join(a, "coin").where("time_ms < a + 600000")
    return rows.groupBy("coin").agg(F.count(F.lit(1)).alias("n"), _count(F.col("buyer").isNotNull() & F.col("seller").isNotNull()).alias("both_sides"), F.countDistinct("side").alias("sides"))


@query(f"""WITH n AS (SELECT greatest((SELECT max(time_ms) FROM book), (SELECT max(end_ms) FROM gaps WHERE end_ms > start_ms)) now), b AS (SELECT coin, min(time_ms) since, max(struct_pack(recv_ms, time_ms)).time_ms newest FROM book WHERE coin IS NOT NULL AND time_ms IS NOT NULL AND recv_ms IS NOT NULL GROUP BY coin),
g AS (SELECT DISTINCT coin, start_ms s, end_ms e FROM gaps WHERE coin IS NOT NULL AND end_ms > start_ms), f AS (SELECT *, max(e) OVER (PARTITION BY coin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM g),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY s, e) k FROM f), o AS (SELECT coin, min(s) s, max(e) e FROM i GROUP BY coin, k),
x AS (SELECT b.coin, count(o.s)::BIGINT outages, coalesce(sum(greatest(0, o.e - greatest(o.s, b.since))), 0)::BIGINT gap_ms FROM b LEFT JOIN o ON b.coin = o.coin GROUP BY b.coin),
l AS (SELECT coin, list_sort(list(recv_ms - time_ms)) v, count(*) c FROM trades WHERE recv_ms IS NOT NULL AND time_ms IS NOT NULL GROUP BY coin), z AS (SELECT coin, sum(size_bytes)::BIGINT bytes, min(opened_ms) a FROM (SELECT DISTINCT * FROM segments) GROUP BY coin)
SELECT b.coin, since since_ms, newest last_book_ms, outages, gap_ms, round(1 - gap_ms / (now - since), 9) covered, v[greatest(1, (c * 50 + 99) // 100)] p50_ms, v[greatest(1, (c * 99 + 99) // 100)] p99_ms, bytes, round(bytes * {45 * DAY_MS}::DOUBLE / (now - a), 0)::BIGINT projected_bytes
FROM n, b JOIN x USING (coin) LEFT JOIN l USING (coin) LEFT JOIN z USING (coin)""")
def collector_status(spark: SparkSession, d: str) -> DataFrame:
    """State of the recording of each coin as of the newest instant: since when, outages, share covered, delays, bytes and where they lead to."""
    book = read(spark, d, "book").where("coin is not null and time_ms is not null and recv_ms is not null").select("coin", "time_ms", "recv_ms")
    gaps = read(spark, d, "gaps")
    now = max(x or 0 for x in (read(spark, d, "book").agg(F.max("time_ms")).first()[0], gaps.where("end_ms > start_ms").agg(F.max("end_ms")).first()[0]))
    b = book.groupBy("coin").agg(F.min("time_ms").alias("since_ms"), F.max(F.struct("recv_ms", "time_ms"))["time_ms"].alias("last_book_ms"))
    o = Intervals(gaps, "coin", "start_ms", "end_ms").periods().select(F.col("key").alias("coin"), "start_ms", "end_ms")
    inside = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.greatest("start_ms", "since_ms"))
    x = b.join(o, "coin", "left").groupBy("coin", "since_ms", "last_book_ms").agg(F.count("start_ms").alias("outages"), F.coalesce(F.sum(inside), F.lit(0)).alias("gap_ms"))
    delay = nearest_ranks(read(spark, d, "trades"), ["coin"], F.col("recv_ms") - F.col("time_ms"), [50, 99]).select("coin", F.col("p50").alias("p50_ms"), F.col("p99").alias("p99_ms"))
    size = read(spark, d, "segments").distinct().groupBy("coin").agg(F.sum("size_bytes").alias("bytes"), F.min("opened_ms").alias("a_"))
    out = x.join(delay, "coin", "left").join(size, "coin", "left")
    covered = F.round(1 - F.col("gap_ms") / (F.lit(now) - F.col("since_ms")), 9)
    return out.select("coin", "since_ms", "last_book_ms", "outages", "gap_ms", covered.alias("covered"), "p50_ms", "p99_ms", "bytes", F.round(F.col("bytes") * F.lit(float(45 * DAY_MS)) / (F.lit(now) - F.col("a_")), 0).cast("long").alias("projected_bytes"))


# -- regularity, names, shares -----------------------------------------------------------------------------------------------------


@query(f"""WITH h AS (SELECT coin, second // 3600 h, count(*) c, min(second % 3600) lo, max(second % 3600) hi FROM (SELECT DISTINCT coin, second FROM proxy WHERE coin IS NOT NULL) GROUP BY ALL)
SELECT coin, count(*)::BIGINT AS n_hours, count(CASE WHEN c > 1 THEN 1 END)::BIGINT several, (max(h) - min(h) + 1 - count(*))::BIGINT missing, min(lo)::BIGINT least_offset, max(hi)::BIGINT most_offset FROM h GROUP BY coin""")
def hour_regularity(spark: SparkSession, d: str) -> DataFrame:
    """Hours with a record, with several, without any between the first and last, and where in the hour records lie."""
    s = read(spark, d, "proxy").where("coin is not null").select("coin", "second").distinct()
    inside = F.pmod("second", F.lit(3600))
    h = s.groupBy("coin", floor_div("second", 3600).alias("h")).agg(F.count(F.lit(1)).alias("c"), F.min(inside).alias("lo"), F.max(inside).alias("hi"))
    return h.groupBy("coin").agg(F.count(F.lit(1)).alias("n_hours"), _count(F.col("c") > 1).alias("several"), (F.max("h") - F.min("h") + 1 - F.count(F.lit(1))).alias("missing"), F.min("lo").alias("least_offset"), F.max("hi").alias("most_offset"))


_LISTED = "(SELECT DISTINCT CASE WHEN length(coin) % 2 = 0 THEN coin ELSE '1000' || coin END || 'USDT' symbol, second // 86400 AS day FROM proxy WHERE coin IS NOT NULL AND last > 0)"


@query(f"""WITH c AS (SELECT coin, unnest([coin || 'USDT', '1000' || coin || 'USDT']) symbol, unnest([0, 1]) k FROM (SELECT DISTINCT coin FROM fills WHERE coin IS NOT NULL)), p AS (SELECT c.*, (SELECT count(*) FROM {_LISTED} x WHERE x.symbol = c.symbol) n FROM c),
b AS (SELECT coin, max(struct_pack(n, k := -k, symbol)) x FROM p GROUP BY coin) SELECT coin, CASE WHEN x.n > 0 THEN x.symbol END symbol, x.n::BIGINT days_present, x.n = (SELECT count(DISTINCT day) FROM {_LISTED}) all_days FROM b""")
def symbol_matches(spark: SparkSession, d: str) -> DataFrame:
    """The archive's name of each coin: of its candidates, the one whose files are there on most days."""
    listed = read(spark, d, "proxy").where("coin is not null and last > 0").select(F.concat(F.when(F.length("coin") % 2 == 0, F.col("coin")).otherwise(F.concat(F.lit("1000"), "coin")), F.lit("USDT")).alias("symbol"), floor_div("second", 86_400).alias("day")).distinct()
    days = listed.select("day").distinct().count()
    coins = read(spark, d, "fills").select("coin").where("coin is not null").distinct()
    names = coins.select("coin", F.posexplode(F.array(F.concat("coin", F.lit("USDT")), F.concat(F.lit("1000"), "coin", F.lit("USDT")))).alias("k", "symbol"))
    n = names.join(listed.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = n.groupBy("coin").agg(F.max(F.struct("n", (-F.col("k")).alias("k"), "symbol")).alias("x"))
    return best.select("coin", F.when(F.col("x.n") > 0, F.col("x.symbol")).alias("symbol"), F.col("x.n").alias("days_present"), (F.col("x.n") == days).alias("all_days"))


@query(f"""WITH f AS (SELECT address, coin, sum({_CENTS}) c FROM (SELECT DISTINCT * FROM fills) WHERE address IS NOT NULL AND coin IS NOT NULL GROUP BY ALL), t AS (SELECT coin, row_number() OVER (ORDER BY sum(c) DESC, coin) r FROM f GROUP BY coin),
w AS (SELECT f.address, u.name, sum(CASE WHEN t.r <= u.k THEN c ELSE 0 END)::DOUBLE / sum(c) x FROM f JOIN t USING (coin), (VALUES ('top 3', 3), ('top 30', 30)) u(name, k) GROUP BY ALL HAVING sum(c) > 0)
SELECT name, count(*)::BIGINT wallets, count(CASE WHEN x >= 0.5 THEN 1 END)::BIGINT at_least_half, round(quantile_cont(x, 0.25), 9) p25, round(quantile_cont(x, 0.5), 9) p50, round(quantile_cont(x, 0.75), 9) p75 FROM w GROUP BY name""")
def share_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """How much of their notional accounts have in the coins of most notional, for two sizes of universe."""
    f = read(spark, d, "fills").distinct().where("address is not null and coin is not null").groupBy("address", "coin").agg(F.sum(notional()).alias("c"))
    f = written(f, "notionals")
    rank = F.row_number().over(W.orderBy(F.desc("all_"), "coin"))  # a row per coin
    t = f.groupBy("coin").agg(F.sum("c").alias("all_")).withColumn("r", rank).drop("all_")
    part = lambda k: F.sum(F.when(F.col("r") <= k, F.col("c")).otherwise(0)) / F.sum("c")
    w = f.join(t, "coin").groupBy("address").agg(F.sum("c").alias("c"), part(3).alias("a"), part(30).alias("b")).where("c > 0")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("x")) for n, c in (("top 3", "a"), ("top 30", "b")))))
    rows = w.select(each.alias("e")).select("e.*")
    q = interpolated(rows, ["name"], F.col("x"), {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    half = rows.groupBy("name").agg(_count(F.col("x") >= 0.5).alias("at_least_half"))
    return q.join(half, "name").select("name", F.col("n").alias("wallets"), "at_least_half", *(F.round(c, 9).alias(c) for c in ("p25", "p50", "p75")))


@query(f"""SELECT address, count(CASE WHEN time_ms // {DAY_MS} % 2 = 0 THEN 1 END)::BIGINT inside, count(CASE WHEN time_ms // {DAY_MS} % 2 <> 0 THEN 1 END)::BIGINT outside, count(DISTINCT (coin, time_ms, side, px))::BIGINT aggregated FROM (SELECT DISTINCT * FROM fills) WHERE address IS NOT NULL AND time_ms IS NOT NULL GROUP BY address""")
def fetch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Fills of each account inside and outside of the wanted days, and how many there are when those of one order and price are put together."""
    f = read(spark, d, "fills").distinct().where("address is not null and time_ms is not null")
    even = F.pmod(utc_day("time_ms"), F.lit(2)) == 0
    merged = f.select("address", "coin", "time_ms", "side", "px").distinct().groupBy("address").agg(F.count(F.lit(1)).alias("aggregated"))
    return f.groupBy("address").agg(_count(even).alias("inside"), _count(~even).alias("outside")).join(merged, "address")


@query("""WITH a AS (SELECT address FROM fills UNION ALL SELECT upper(address) FROM fill_snapshots) SELECT count(*)::BIGINT n, count(CASE WHEN NOT coalesce(regexp_full_match(lower(address), '0x[0-9a-f]{40}'), false) THEN 1 END)::BIGINT invalid, count(DISTINCT lower(address))::BIGINT different, (count(address) - count(DISTINCT lower(address)))::BIGINT repeated FROM a""")
def address_profile(spark: SparkSession, d: str) -> DataFrame:
    """Invalid and repeated addresses of a listing in any case."""
    a = read(spark, d, "fills").select(F.lower("address").alias("a")).unionByName(read(spark, d, "fill_snapshots").select(F.lower("address").alias("a")))
    per = a.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    bad = ~F.coalesce(F.col("a").rlike("^0x[0-9a-f]{40}$"), F.lit(False))
    known = F.when(F.col("a").isNotNull(), F.col("c")).otherwise(0)
    return per.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(bad, F.col("c"))), F.lit(0)).alias("invalid"), F.count("a").alias("different"), (F.sum(known) - F.count("a")).alias("repeated"))


# -- ranks and windows -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_MARKED}, b AS (SELECT run_id, wallet, arg_min(equity, t) f, arg_max(equity, t) l FROM cv GROUP BY ALL), rr AS (SELECT run_id, wallet, equity / pe - 1 r FROM (SELECT run_id, wallet, equity::DOUBLE equity, lag(equity::DOUBLE) OVER (PARTITION BY run_id, wallet ORDER BY t) pe FROM cv) WHERE pe > 0),
h AS (SELECT run_id, wallet, round(CASE WHEN count(*) >= 2 AND stddev_samp(r) > 1e-12 * max(abs(r)) THEN avg(r) / stddev_samp(r) END, 6) sharpe FROM rr GROUP BY ALL)
SELECT run_id, wallet, sharpe, row_number() OVER (PARTITION BY run_id ORDER BY sharpe DESC NULLS LAST, wallet)::INTEGER place FROM b LEFT JOIN h USING (run_id, wallet) WHERE l > f""")
def ranking(spark: SparkSession, d: str) -> DataFrame:
    """Wallets of each run that gained, by Sharpe ratio; without one last; ties by name."""
    from tideline.operators.curves import returns, sharpe

    c = written(_copies(spark, d).curve(), "curves")
    b = c.groupBy("run_id", "wallet").agg(F.min_by("equity", "t").alias("f"), F.max_by("equity", "t").alias("l"))
    h = sharpe(returns(c.select("run_id", "wallet", "t", F.col("equity").cast("double").alias("equity")), ["run_id", "wallet"]), ["run_id", "wallet"], 1)
    rows = b.where("l > f").join(h.select("run_id", "wallet", F.round("sharpe", 6).alias("sharpe")), ["run_id", "wallet"], "left")
    return rows.select("run_id", "wallet", "sharpe", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc_nulls_last("sharpe"), "wallet")).alias("place"))  # a row per wallet


@query(f"""WITH c AS (SELECT coin, day, greatest(0, observed_ms - gap_ms - unrecorded_ms) ms FROM (SELECT coin, day, max(observed_ms) observed_ms, max(gap_ms) gap_ms, max(unrecorded_ms) unrecorded_ms FROM day_coverage WHERE coin IS NOT NULL AND day IS NOT NULL AND complete GROUP BY ALL)),
s AS (SELECT *, sum(ms) OVER (PARTITION BY coin ORDER BY day) upto FROM c) SELECT coin, min(day) first_day, min(CASE WHEN upto >= {3 * DAY_MS} THEN day END) + 1 end_day FROM s GROUP BY coin""")
def effective_windows(spark: SparkSession, d: str) -> DataFrame:
    """Until which midnight each coin's window must be extended to hold three days of covered time; null if it never does."""
    c = read(spark, d, "day_coverage").where("coin is not null and day is not null and complete").groupBy("coin", "day").agg(*(F.max(x).alias(x) for x in ("observed_ms", "gap_ms", "unrecorded_ms")))
    ms = F.greatest(F.lit(0).cast("long"), F.col("observed_ms") - F.col("gap_ms") - F.col("unrecorded_ms"))
    s = Runs(c.withColumn("ms", ms), ["coin"], "day", [], 64).running(upto=F.col("ms"))
    return s.groupBy("coin").agg(F.min("day").alias("first_day"), (F.min(F.when(F.col("upto") >= 3 * DAY_MS, F.col("day"))) + 1).alias("end_day"))


@query(f"""WITH c AS (SELECT coin, sum({_CENTS})::BIGINT cents FROM (SELECT DISTINCT * FROM fills) WHERE coin IS NOT NULL GROUP BY coin),
r AS (SELECT *, sum(cents) OVER (ORDER BY cents DESC, coin)::BIGINT cumulative, sum(cents) OVER ()::BIGINT total FROM c) SELECT coin, cents, cumulative, total FROM r WHERE cumulative - cents < total * 0.9 ORDER BY cents DESC, coin LIMIT 8""")
def greedy_capped(spark: SparkSession, d: str) -> DataFrame:
    """Coins by notional until they hold nine tenths of it, eight at most: a list of stated length."""
    from tideline.operators.choosing import until_share

    c = read(spark, d, "fills").distinct().where("coin is not null").groupBy("coin").agg(F.sum(notional()).alias("cents"))
    return until_share(c, "cents", [F.desc("cents"), F.asc("coin")], 0.9, 8)


@query("""SELECT json_extract_string(raw, '$.channel') channel, coalesce(json_extract_string(raw, '$.data.coin'), json_extract_string(raw, '$.data[0].coin')) coin, count(*)::BIGINT n FROM records WHERE json_valid(raw) GROUP BY ALL""")
def routing(spark: SparkSession, d: str) -> DataFrame:
    """Where messages go by what they say: their channel, and the coin of their data or of its first item."""
    channel, coin = channel_and_coin("raw")
    return read(spark, d, "records").where(F.try_parse_json("raw").isNotNull()).groupBy(channel.alias("channel"), coin.alias("coin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT address FROM fill_snapshots WHERE address IS NOT NULL AND address NOT IN (SELECT address FROM fills WHERE address IS NOT NULL AND time_ms IS NOT NULL)")
def anti_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that were delivered but have no fill of their own."""
    seen = read(spark, d, "fills").where("time_ms is not null").select("address")
    return read(spark, d, "fill_snapshots").select("address").where("address is not null").distinct().join(seen, "address", "left_anti")


@query(f"""WITH {_PARTS}, c AS (SELECT *, row_number() OVER (PARTITION BY address, coin ORDER BY seq, part) rk FROM r)
SELECT address, coin, episode, min(seq) first_seq, max(seq) last_seq, count(*)::BIGINT n_fills, max(rk) - min(rk) + 1 = count(*) contiguous FROM c GROUP BY ALL""")
def episode_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The range of fill numbers of every episode, and whether its fills are all that lie in it."""
    p = acc.parts(_steps(spark, d)).select(*acc.KEYS, "episode", "seq", "part")
    rows = Runs(p, acc.KEYS, "seq", ["part"], 1 << 16).running(rk=F.lit(1).cast("long"))
    n = F.count(F.lit(1))
    return rows.groupBy(*acc.KEYS, "episode").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), n.alias("n_fills"), (F.max("rk") - F.min("rk") + 1 == n).alias("contiguous"))


@query(f"""WITH k AS (SELECT address, batch_id, snapshot_ms, count(*) n FROM fill_snapshots WHERE address IS NOT NULL GROUP BY ALL), c AS (SELECT *, CASE WHEN n % 7 = 0 THEN 'failed' ELSE 'ok' END status FROM k)
SELECT batch_id, count(CASE WHEN status = 'ok' THEN 1 END)::BIGINT ok, count(CASE WHEN status = 'failed' THEN 1 END)::BIGINT failed, sum(n)::BIGINT n_fills FROM c GROUP BY batch_id""")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """What an ingestion of every batch came to: accounts by status, and fills in all."""
    rows = read(spark, d, "fill_snapshots").where("address is not null").groupBy("address", "batch_id", "snapshot_ms").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("n") % 7 == 0
    return rows.groupBy("batch_id").agg(_count(~failed).alias("ok"), _count(failed).alias("failed"), F.sum("n").alias("n_fills"))


@query("""WITH g AS (SELECT DISTINCT coin, start_ms s, end_ms e FROM gaps WHERE coin IS NOT NULL AND end_ms > start_ms), f AS (SELECT *, max(e) OVER (PARTITION BY coin ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM g),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY coin ORDER BY s, e) k FROM f), o AS (SELECT coin, min(s) s, max(e) e FROM i GROUP BY coin, k),
x AS (SELECT DISTINCT address, seq, coin, time_ms FROM fills WHERE coin IS NOT NULL AND time_ms IS NOT NULL) SELECT x.*, coalesce((SELECT sum(least(o.e, x.time_ms) - o.s) FROM o WHERE o.coin = x.coin AND o.s < x.time_ms), 0)::BIGINT out_ms FROM x""")
def outage_before(spark: SparkSession, d: str) -> DataFrame:
    """How long each fill's coin had been out before it, in all: whole outages, and the part so far of the one that lasts."""
    outages = Intervals(read(spark, d, "gaps"), "coin", "start_ms", "end_ms").periods().select("key", "start_ms", "end_ms")
    f = read(spark, d, "fills").where("coin is not null").select("address", "seq", "coin", "time_ms").distinct()
    return gap_measure(f, "coin", "time_ms", outages, "out_ms")
