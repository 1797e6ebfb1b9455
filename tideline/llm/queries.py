"""Queries p2, p5, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import floor_div, utc_day
from tideline.llm.contamination import Contamination
from tideline.llm.mixing import Mixture
from tideline.llm.nearest import nearest
from tideline.llm.quantiles import Quantiles, median, percentile
from tideline.llm.truncation import Truncation
from tideline.session import written
from tideline.sources.tables import read

# -- 2: percentiles ----------------------------------------------------------------------------------------------------


def _delays(spark: SparkSession, d: str) -> tuple[Quantiles, DataFrame]:
    q = Quantiles(["coin", "day"])
    trades = read(spark, d, "trades").select("coin", utc_day("time_ms").alias("day"), (F.col("recv_ms") - F.col("time_ms")).alias("delay"))
    return q, q.combined(q.summaries(trades, F.col("delay")))


def _latency(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", F.col("err").alias("rank_err"), *(percentile(p).cast("long").alias(f"p{p}_ms") for p in (50, 95, 99)))


def p2_latency(spark: SparkSession, d: str) -> DataFrame:
    """Per coin and day: p50, p95 and p99 of the delay of trades, with the greatest possible error in ranks."""
    return _latency(_delays(spark, d)[1], "coin", "day")


def p2_latency_all(spark: SparkSession, d: str) -> DataFrame:
    """The same per coin over all days, from the days' summaries alone."""
    q, days = _delays(spark, d)
    return _latency(q.combined(days, ["coin"]), "coin")


def _differences(spark: SparkSession, d: str) -> DataFrame:
    proxy = read(spark, d, "proxy").where("last > 0").groupBy("coin", "second").agg(F.min("last").alias("last"))
    fills = read(spark, d, "fills").select("coin", utc_day("time_ms").alias("day"), floor_div("time_ms", 1000).alias("second"), "px").where("px is not null")
    return fills.join(proxy, ["coin", "second"]).select("coin", "day", ((F.col("px") / F.col("last") - 1) * 1e4).alias("bps"))


def _levels(rows: DataFrame) -> DataFrame:
    q = Quantiles(["coin", "day"])
    return q.combined(q.summaries(rows, F.col("bps"))).select("coin", "day", "n", F.col("err").alias("rank_err"), median().alias("median_bps"))


def p2_day_level(spark: SparkSession, d: str) -> DataFrame:
    """Per coin and day: the median distance of fills from the proxy's price of their second."""
    return _levels(_differences(spark, d))


def p2_proxy_check(spark: SparkSession, d: str) -> DataFrame:
    """Per coin: p95 of the distance from the day's median, and how the medians lie.

    Every day is worked on by itself: its median from its summary, then a summary of its distances from it. The days of
    a coin are put together from these summaries alone.
    """
    rows = written(_differences(spark, d), "proxy-differences")
    levels = written(_levels(rows), "day-levels")
    off = rows.join(levels, ["coin", "day"]).select("coin", "day", F.abs(F.col("bps") - F.col("median_bps")).alias("off"))
    q = Quantiles(["coin", "day"])
    days = q.combined(q.summaries(off, F.col("off")))
    spread = q.combined(days, ["coin"]).select("coin", "n", F.col("err").alias("rank_err"), percentile(95).alias("deviation_p95_bps"))
    m = F.col("median_bps")
    by_coin = levels.groupBy("coin").agg(F.max(F.abs(m)).alias("level_bps"), (F.max(m) - F.min(m)).alias("shift_bps"))
    return spread.join(by_coin, "coin")


COARSE = 0.01  # a permitted error at which small tables are thinned out too


def p2_error_bound(spark: SparkSession, d: str) -> DataFrame:
    """The delays of all trades of all coins as one group, summarised per day at a coarse error and put together from the
    days: for several percentiles, whether the answer is approximate, and whether its true ranks are as near as stated."""
    trades = read(spark, d, "trades").select(utc_day("time_ms").alias("day"), F.lit(0).alias("all_"), (F.col("recv_ms") - F.col("time_ms")).cast("double").alias("x")).where("x is not null")
    q = Quantiles(["all_", "day"], eps=COARSE, exact=0)
    whole = q.combined(q.combined(q.summaries(trades, F.col("x"))), ["all_"])
    pcts = (1, 10, 50, 90, 95, 99)
    made = whole.select("n", "err", F.array(*(percentile(p) for p in pcts)).alias("x")).first()  # one row
    n, err, answers = (made.n, made.err, made.x) if made else (0, 0, [None] * len(pcts))
    x = F.col("x")
    counts = trades.agg(*(c for i, v in enumerate(answers) for c in (F.count(F.when(x < F.lit(v), 1)).alias(f"below{i}"), F.count(F.when(x == F.lit(v), 1)).alias(f"ties{i}"))))
    off = lambda i, p: F.greatest(F.col(f"below{i}") + 1 - max(1, (n * p + 99) // 100), max(1, (n * p + 99) // 100) - F.col(f"below{i}") - F.col(f"ties{i}"), F.lit(0))
    row = lambda i, p: F.struct(F.lit(p).cast("long").alias("pct"), F.lit(n).cast("long").alias("n"), F.lit(err > 0).alias("approximate"), (off(i, p) <= err).alias("within_bound"), F.lit(err <= COARSE * n).alias("as_permitted"))
    return counts.select(F.explode(F.array(*(row(i, p) for i, p in enumerate(pcts)))).alias("r")).select("r.*")


def _rank(p: int, x: str) -> str:
    return f"list_sort(list({x}))[greatest(1, (count(*) * {p} + 99) // 100)]"


_P2_T = "WITH t AS (SELECT coin, time_ms // 86400000 AS day, recv_ms - time_ms AS x FROM trades WHERE time_ms IS NOT NULL AND recv_ms IS NOT NULL)"
_P2_COLS = "CAST(count(*) AS BIGINT) n, CAST(0 AS BIGINT) rank_err, " + ", ".join(f"{_rank(p, 'x')} p{p}_ms" for p in (50, 95, 99))
_P2_D = """WITH p AS (SELECT coin, second, min(last) AS last FROM proxy WHERE last > 0 GROUP BY ALL),
f AS (SELECT fills.coin, time_ms // 86400000 AS day, (px / p.last - 1) * 1e4 AS bps FROM fills JOIN p ON fills.coin = p.coin AND time_ms // 1000 = p.second WHERE px IS NOT NULL),
m AS (SELECT coin, day, count(*) n, median(bps) median_bps FROM f GROUP BY ALL)
"""
P2_SQL = {
    "p2_error_bound": f"{_P2_T} SELECT pct, count(x)::BIGINT n, true AS approximate, true AS within_bound, true AS as_permitted FROM t, (SELECT unnest([1, 10, 50, 90, 95, 99])::BIGINT pct) GROUP BY pct",
    "p2_latency": f"{_P2_T} SELECT coin, day, {_P2_COLS} FROM t GROUP BY coin, day",
    "p2_latency_all": f"{_P2_T} SELECT coin, {_P2_COLS} FROM t GROUP BY coin",
    "p2_day_level": _P2_D + "SELECT coin, day, CAST(n AS BIGINT) n, CAST(0 AS BIGINT) rank_err, median_bps FROM m",
    "p2_proxy_check": _P2_D
    + f""", o AS (SELECT f.coin, abs(bps - median_bps) x FROM f JOIN m USING (coin, day))
SELECT coin, n, rank_err, deviation_p95_bps, level_bps, shift_bps
FROM (SELECT coin, CAST(count(*) AS BIGINT) n, CAST(0 AS BIGINT) rank_err, {_rank(95, 'x')} deviation_p95_bps FROM o GROUP BY coin)
JOIN (SELECT coin, max(abs(median_bps)) level_bps, max(median_bps) - min(median_bps) shift_bps FROM m GROUP BY coin) USING (coin)""",
}

# -- 5: nearest in time ------------------------------------------------------------------------------------------------

TOLERANCE_MS = 5_000


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    book = read(spark, d, "book").select("coin", "time_ms")
    fills = read(spark, d, "fills").select(F.lit("fill").alias("kind"), F.col("address").alias("owner"), F.col("seq").alias("no"), "coin", F.col("time_ms").alias("t"))
    orders = read(spark, d, "copy_orders").select(F.lit("order").alias("kind"), F.col("run_id").cast("string").alias("owner"), F.col("order_no").alias("no"), "coin", F.col("exec_t").alias("t"))
    paired = nearest(fills.unionByName(orders), book, "coin", "t", "coin", "time_ms", TOLERANCE_MS, "book_time_ms")
    return paired.select("kind", "owner", "no", "book_time_ms").distinct()


P5_FOUND = f"""
WITH l AS (
  SELECT DISTINCT * FROM (
    SELECT 'fill' kind, address AS owner, seq AS no, coin, time_ms t FROM fills
    UNION ALL SELECT 'order', CAST(run_id AS VARCHAR), order_no, coin, exec_t FROM copy_orders)
  WHERE coin IS NOT NULL AND t IS NOT NULL),
b AS (SELECT DISTINCT coin, time_ms FROM book WHERE coin IS NOT NULL AND time_ms IS NOT NULL),
x AS (SELECT l.*, b.time_ms back FROM l ASOF LEFT JOIN b ON l.coin = b.coin AND l.t >= b.time_ms),
y AS (SELECT x.*, b.time_ms ahead FROM x ASOF LEFT JOIN b ON x.coin = b.coin AND x.t <= b.time_ms),
z AS (SELECT *, CASE WHEN ahead IS NULL OR t - back <= ahead - t THEN back ELSE ahead END book_time_ms FROM y)
SELECT DISTINCT kind, owner, no, book_time_ms FROM z WHERE abs(book_time_ms - t) <= {TOLERANCE_MS}
"""

# -- 7: leaked items ---------------------------------------------------------------------------------------------------


def _contamination(spark: SparkSession, d: str) -> Contamination:
    return Contamination(read(spark, d, "eval_items"), n=13)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _contamination(spark, d).matches(read(spark, d, "documents"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Leaked stretches of each document, in characters and words."""
    return _contamination(spark, d).spans(read(spark, d, "documents"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its leaked stretches removed: digest and length of what stays."""
    out = _contamination(spark, d).cleaned(read(spark, d, "documents"))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.xxhash64("text").alias("text_hash"), "n_removed")


# -- 8: mixture --------------------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(read(spark, d, "documents").select("doc_id", "text", "source"), read(spark, d, "source_targets"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, d).selected()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source: target and reached share of the mixture's tokens."""
    return _mixture(spark, d).shares_reached()


# -- 9: truncated texts ------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return Truncation(read(spark, d, "documents")).flags("doc_id").where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: how many texts it cuts."""
    return Truncation(read(spark, d, "documents")).rates()


QUERIES = {f.__name__: f for f in (p2_latency, p2_latency_all, p2_day_level, p2_proxy_check, p2_error_bound, p5_found, p7_found, p7_spans, p7_cleaned, p8_documents, p8_shares, p9_found, p9_rates)}
SQL = {**P2_SQL, "p5_found": P5_FOUND}
