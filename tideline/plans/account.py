"""Positions of accounts: steps, breaks, events, episodes, results, and what was open for how long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, floor_div, utc_day
from tideline.operators import account as acc
from tideline.operators.ordered import exists_between, split_ms
from tideline.operators.stats import interpolated
from tideline.plans.registry import Registry
from tideline.session import written
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Start of the first and end of the last UTC day that has a fill.
START, END = f"(SELECT min(time_ms // {DAY_MS}) * {DAY_MS} FROM fills)", f"(SELECT (max(time_ms // {DAY_MS}) + 1) * {DAY_MS} FROM fills)"
NEIGHBOURHOOD_MS = 3_600_000
AGE_EDGES_MS = [2 * DAY_MS, 5 * DAY_MS]


def window(spark: SparkSession, d: str) -> tuple[int, int]:
    """The same as numbers; an empty window if no fill has a time."""
    day = utc_day("time_ms")
    first, last = read(spark, d, "fills").agg(F.min(day), F.max(day)).first()
    return (0, 0) if first is None else (first * DAY_MS, (last + 1) * DAY_MS)


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return acc.steps(read(spark, d, "fills").where("address is not null"))


def _level_ms(spark: SparkSession, d: str) -> int:
    """The width at which an account's changes are cut, from its fills."""
    return split_ms(read(spark, d, "fills"), ["address"], "time_ms")


_STEPS = """
u AS (SELECT DISTINCT address, seq, time_ms, coin, kind, px, sz, side, start_position, crossed, closed_pnl, twap_id FROM fills
 WHERE kind IN ('perp', 'hip3') AND side IN ('A', 'B') AND address IS NOT NULL AND time_ms IS NOT NULL AND coin IS NOT NULL AND px IS NOT NULL AND sz IS NOT NULL AND start_position IS NOT NULL),
z AS (SELECT *, CASE WHEN side = 'B' THEN sz ELSE -sz END signed, CASE WHEN kind = 'perp' THEN 0.01::DOUBLE END lot FROM u),
b AS (SELECT *, CASE WHEN abs(start_position) < coalesce(lot / 2, 1e-9::DOUBLE * sz) THEN 0.0::DOUBLE ELSE start_position END bf,
 CASE WHEN abs(start_position + signed) < coalesce(lot / 2, 1e-9::DOUBLE * sz) THEN 0.0::DOUBLE ELSE start_position + signed END af FROM z),
x AS (SELECT *, lag(af) OVER w expected, lag(time_ms) OVER w prev_t FROM b WINDOW w AS (PARTITION BY address, coin ORDER BY time_ms, seq)),
s AS (SELECT *, coalesce(abs(start_position - expected) > CASE WHEN lot IS NOT NULL THEN lot * (1 + 1e-9::DOUBLE) ELSE 1e-9::DOUBLE * greatest(abs(expected), sz) END, false) broke FROM x)
"""


@query("SELECT address, sum(CASE WHEN px IS NULL OR sz IS NULL OR side IS NULL OR start_position IS NULL OR side NOT IN ('A', 'B') THEN 1 ELSE 0 END)::BIGINT n_ignored FROM (SELECT DISTINCT * FROM fills WHERE kind IN ('perp', 'hip3')) GROUP BY address")
def ignored_fills(spark: SparkSession, d: str) -> DataFrame:
    return acc.ignored(read(spark, d, "fills"))


@query(f"WITH {_STEPS} SELECT address, coin, seq, time_ms, bf AS before, af AS after, expected, broke, bf = 0 OR af = 0 OR bf * af < 0 AS touched_zero FROM s")
def ledger_walk(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("address", "coin", "seq", "time_ms", "before", "after", "expected", "broke", "touched_zero")


@query(f"WITH {_STEPS} SELECT address, coin, kind, time_ms AS t, prev_t, expected, start_position declared FROM s WHERE broke")
def continuity_breaks(spark: SparkSession, d: str) -> DataFrame:
    return acc.breaks(_steps(spark, d))


@query(f"""WITH {_STEPS} SELECT address, coin, kind, time_ms AS t, arg_min(bf, seq) prev_position, arg_max(af, seq) AS position, bool_or(bf = 0 OR af = 0 OR bf * af < 0) touched_zero, arg_max(px, seq) px,
 round(sum(sz * px), 8) notional, bool_or(broke) unobserved, count(*)::BIGINT n_fills FROM s GROUP BY ALL""")
def leader_events(spark: SparkSession, d: str) -> DataFrame:
    return acc.events(_steps(spark, d)).withColumn("notional", F.round("notional", 8))


_TWAP = f"""SELECT k.*, EXISTS (SELECT 1 FROM u WHERE u.address = k.address AND u.coin = k.coin AND u.twap_id IS NOT NULL AND u.time_ms BETWEEN k.prev_t - {NEIGHBOURHOOD_MS} AND k.t + {NEIGHBOURHOOD_MS}) has_twap
 FROM (SELECT address, coin, time_ms AS t, prev_t FROM s WHERE broke) k"""


@query(f"""WITH {_STEPS}, k AS ({_TWAP}) SELECT v.bucket, count(k.t)::BIGINT breaks, count(CASE WHEN k.has_twap THEN 1 END)::BIGINT with_twap
FROM (SELECT unnest(range(3)) bucket) v LEFT JOIN k ON v.bucket = CASE WHEN {END} - k.t < {AGE_EDGES_MS[0]} THEN 0 WHEN {END} - k.t < {AGE_EDGES_MS[1]} THEN 1 ELSE 2 END GROUP BY v.bucket""")
def break_ages(spark: SparkSession, d: str) -> DataFrame:
    """Breaks by age at the end of the last day that has fills, and how many have a fill of a split order nearby."""
    steps = _steps(spark, d)
    found = acc.breaks(steps).withColumn("low", F.col("prev_t") - NEIGHBOURHOOD_MS).withColumn("high", F.col("t") + NEIGHBOURHOOD_MS)
    near = exists_between(found, steps.where("twap_id is not null").select("address", "coin", "time_ms"), ["address", "coin"], "low", "high", "time_ms", "has_twap")
    age = window(spark, d)[1] - F.col("t")
    bucket = F.when(age < AGE_EDGES_MS[0], 0).when(age < AGE_EDGES_MS[1], 1).otherwise(2)
    counts = near.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("b"), F.count(F.when(F.col("has_twap"), 1)).alias("w"))
    return spark.range(len(AGE_EDGES_MS) + 1).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("b", F.lit(0)).cast("long").alias("breaks"), F.coalesce("w", F.lit(0)).cast("long").alias("with_twap"))


@query(f"WITH {_STEPS} SELECT address, coin, t, prev_t, has_twap FROM ({_TWAP})")
def break_neighbours(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    found = acc.breaks(steps).withColumn("low", F.col("prev_t") - NEIGHBOURHOOD_MS).withColumn("high", F.col("t") + NEIGHBOURHOOD_MS)
    near = exists_between(found, steps.where("twap_id is not null").select("address", "coin", "time_ms"), ["address", "coin"], "low", "high", "time_ms", "has_twap")
    return near.select("address", "coin", "t", "prev_t", "has_twap")


_PARTS = f"""{_STEPS},
p0 AS (SELECT *, sign(signed)::INT dd, bf = 0 OR sign(bf) = sign(signed) opens FROM s),
p1 AS (SELECT *, NOT opens AND af <> 0 AND sign(af) <> sign(bf) crosses FROM p0),
p2 AS (SELECT *, opens OR af <> 0 open_after, CASE WHEN opens THEN dd WHEN crosses THEN sign(af)::INT ELSE sign(bf)::INT END side_after FROM p1),
p3 AS (SELECT *, coalesce(lag(open_after) OVER w, false) has, lag(side_after) OVER w cs FROM p2 WINDOW w AS (PARTITION BY address, coin ORDER BY time_ms, seq)),
p4 AS (SELECT *, has AND (bf = 0 OR sign(bf)::INT <> cs) forced FROM p3),
p5 AS (SELECT *, has AND NOT forced live FROM p4),
q AS (
 SELECT address, coin, kind, time_ms, seq, px, crossed, forced, start_position, signed, sz, closed_pnl, 0 part, NOT live starts, opens opening, CASE WHEN opens THEN sz WHEN af = 0 OR crosses THEN abs(bf) ELSE sz END size, NOT live AND bf = 0 from_flat,
  CASE WHEN opens AND bf = 0 THEN dd ELSE sign(bf)::INT END side, broke AND (live OR bf <> 0) broken_part, NOT opens AND (af = 0 OR crosses) ends FROM p5
 UNION ALL SELECT address, coin, kind, time_ms, seq, px, crossed, forced, start_position, signed, sz, closed_pnl, 1, true, true, abs(af), true, sign(af)::INT, false, false FROM p5 WHERE crosses),
r AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY address, coin ORDER BY time_ms, seq, part ROWS UNBOUNDED PRECEDING)::BIGINT episode FROM q),
e AS (SELECT address, coin, kind, episode, min(time_ms) opened, max(CASE WHEN ends THEN time_ms END) ended, arg_min(side, (time_ms, seq, part)) side, arg_min(from_flat, (time_ms, seq, part)) opened_from_flat, bool_or(broken_part) bp,
 sum(size * px) traded, sum(CASE WHEN opening THEN size * px ELSE 0 END) op, sum(CASE WHEN opening AND crossed THEN size * px ELSE 0 END) tk, count(*)::BIGINT n_fills, arg_min(forced, (time_ms, seq, part)) fs FROM r GROUP BY ALL),
f AS (SELECT *, lead(opened) OVER w nopen, coalesce(lead(fs) OVER w, false) nforced FROM e WINDOW w AS (PARTITION BY address, coin ORDER BY opened, episode)),
ep AS (SELECT address, coin, kind, episode, opened, coalesce(ended, CASE WHEN nforced THEN nopen END) closed, side, opened_from_flat, bp OR (ended IS NULL AND nforced) broken, traded, op, tk, n_fills FROM f)
"""


@query(f"""WITH {_PARTS} SELECT address, coin, episode, opened, closed, side, opened_from_flat, broken, round(traded, 8) traded_notional, round(op, 8) opening_notional, round(tk, 8) opening_taker_notional, n_fills FROM ep""")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    e = acc.episodes(acc.parts(_steps(spark, d)))
    rounded = [F.round(c, 8).alias(c) for c in ("traded_notional", "opening_notional", "opening_taker_notional")]
    return e.select("address", "coin", "episode", "opened", "closed", "side", "opened_from_flat", "broken", *rounded, "n_fills")


@query(f"""WITH {_PARTS} SELECT address, count(*)::BIGINT n, count(CASE WHEN closed IS NOT NULL AND opened_from_flat THEN 1 END)::BIGINT closed, median(CASE WHEN closed IS NOT NULL AND opened_from_flat THEN closed - opened END) median_ms,
 count(DISTINCT CASE WHEN opened_from_flat THEN opened // {7 * DAY_MS} END)::BIGINT AS weeks, count(CASE WHEN broken THEN 1 END)::BIGINT broken FROM ep GROUP BY address""")
def episode_facts(spark: SparkSession, d: str) -> DataFrame:
    """Durations and weeks of activity of each account's episodes."""
    e = acc.episodes(acc.parts(_steps(spark, d)))
    whole = F.col("closed").isNotNull() & F.col("opened_from_flat")
    e = written(e, "episodes-of-accounts")
    counts = e.groupBy("address").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("closed"),
        F.countDistinct(F.when(F.col("opened_from_flat"), floor_div("opened", 7 * DAY_MS))).alias("weeks"), F.count(F.when(F.col("broken"), 1)).alias("broken"),
    )
    medians = interpolated(e.where(whole), ["address"], F.col("closed") - F.col("opened"), {"median_ms": 0.5}).drop("n")
    return counts.join(medians, "address", "left").select("address", "n", "closed", "median_ms", "weeks", "broken")


# average cost, fill by fill: size, cost and realized result so far
_PNL = f"""{_PARTS},
sided AS (SELECT *, side * start_position b0, side * (start_position + signed) a0 FROM r),
moved AS (SELECT *, greatest(a0, 0) - greatest(b0, 0) ch, starts AND b0 < 0 AND -b0 > 1e-9::DOUBLE * sz inherited FROM sided),
folded AS (SELECT address, coin, episode, sum(CASE WHEN inherited THEN 0 ELSE closed_pnl END) reported, bool_or(closed_pnl IS NULL) unknown,
 list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE], list([ch, px, side::DOUBLE] ORDER BY time_ms, seq, part)),
  lambda s, f: CASE WHEN f[1] > 0 THEN [s[1] + f[1], (s[1] * s[2] + f[1] * f[2]) / (s[1] + f[1]), s[3]] ELSE [s[1] + f[1], s[2], s[3] - f[1] * (f[2] - s[2]) * f[3]] END)[3] realized FROM moved GROUP BY ALL),
checked AS (SELECT address, coin, episode, abs(realized - reported) / traded * 1e4 bps FROM folded JOIN ep USING (address, coin, episode) WHERE opened_from_flat AND closed IS NOT NULL AND NOT broken AND NOT unknown AND traded > 0)
"""


@query(f"WITH {_PNL} SELECT address, coin, episode, round(bps, 6) divergence_bps FROM checked")
def pnl_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Rebuilt against reported result of every whole episode, in basis points of its notional."""
    return acc.pnl_divergence(acc.episodes(acc.parts(_steps(spark, d)))).withColumn("divergence_bps", F.round("divergence_bps", 6))


@query(f"WITH {_PNL} SELECT address, count(*)::BIGINT n, count(CASE WHEN bps > 10 THEN 1 END)::BIGINT n_over, round(max(bps), 6) max_bps FROM checked GROUP BY address")
def pnl_violations(spark: SparkSession, d: str) -> DataFrame:
    """Accounts by how many of their whole episodes differ by more than ten basis points."""
    found = acc.pnl_divergence(acc.episodes(acc.parts(_steps(spark, d))))
    return found.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("divergence_bps") > 10, 1)).alias("n_over"), F.round(F.max("divergence_bps"), 6).alias("max_bps"))


_LEVELS = f"""c AS (SELECT address, greatest(t, {START}) t, sum(delta) delta FROM ch WHERE t < {END} GROUP BY ALL),
l AS (SELECT address, sum(delta) OVER (PARTITION BY address ORDER BY t) AS lv, coalesce(lead(t) OVER (PARTITION BY address ORDER BY t), {END}) - t w FROM c),
h AS (SELECT address, lv, sum(w) w FROM l WHERE lv > 0 AND w > 0 GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY address ORDER BY lv) cum, sum(w) OVER (PARTITION BY address) tot FROM h)"""


@query(f"""WITH {_STEPS}, ev AS (SELECT address, coin, time_ms AS t, arg_min(bf, seq) pp, arg_max(af, seq) po FROM s GROUP BY ALL),
d AS (SELECT *, lag(po) OVER w pr, row_number() OVER w rn FROM ev WINDOW w AS (PARTITION BY address, coin ORDER BY t)),
ch AS (SELECT address, {START} t, CASE WHEN pp <> 0 THEN 1 ELSE 0 END delta FROM d WHERE rn = 1 UNION ALL SELECT address, t, CASE WHEN po <> 0 THEN 1 ELSE 0 END - CASE WHEN CASE WHEN rn = 1 THEN pp ELSE pr END <> 0 THEN 1 ELSE 0 END FROM d),
{_LEVELS} SELECT address, min(lv)::BIGINT median_open, max(tot)::BIGINT weight FROM k WHERE cum * 100 >= tot * 50 GROUP BY address""")
def open_count_steps(spark: SparkSession, d: str) -> DataFrame:
    """Median number of open coins of each account over the time with at least one."""
    return acc.open_coins(_steps(spark, d), *window(spark, d), bucket_ms=_level_ms(spark, d))


@query(f"""WITH {_STEPS}, v AS (SELECT address, coin, time_ms AS t, seq, floor(abs(bf) * px * 100 + 0.5)::BIGINT fr, floor(abs(af) * px * 100 + 0.5)::BIGINT too FROM s),
d AS (SELECT *, lag(too) OVER w pr, row_number() OVER w rn FROM v WINDOW w AS (PARTITION BY address, coin ORDER BY t, seq)),
ch AS (SELECT address, {START} t, fr delta FROM d WHERE rn = 1 UNION ALL SELECT address, t, too - CASE WHEN rn = 1 THEN fr ELSE pr END FROM d),
{_LEVELS} SELECT address, min(lv)::BIGINT p95_cents, max(tot)::BIGINT weight FROM k WHERE cum * 100 >= tot * 95 GROUP BY address""")
def exposure_steps(spark: SparkSession, d: str) -> DataFrame:
    """95th percentile over time in position of each account's exposure, in whole cents so that sums are exact."""
    e = acc.exposure(_steps(spark, d), *window(spark, d), bucket_ms=_level_ms(spark, d))
    return e.select("address", F.round(F.col("exposure") * 100).cast("long").alias("p95_cents"), F.round(F.col("hours") * 3_600_000).cast("long").alias("weight"))


@query(f"""WITH {_STEPS} SELECT kind, count(expected)::BIGINT pairs, count(CASE WHEN broke THEN 1 END)::BIGINT breaks, count(CASE WHEN broke AND time_ms = prev_t THEN 1 END)::BIGINT same_ms FROM s GROUP BY kind""")
def continuity_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    return s.groupBy("kind").agg(F.count("expected").alias("pairs"), F.count(F.when(F.col("broke"), 1)).alias("breaks"), F.count(F.when(F.col("broke") & (F.col("time_ms") == F.col("prev_t")), 1)).alias("same_ms"))


@query(f"""WITH {_STEPS} SELECT max(n)::BIGINT most_fills, max(m)::BIGINT most_in_ms FROM (SELECT address, sum(c) n, max(c) m FROM (SELECT address, time_ms, count(*) c FROM s GROUP BY ALL) GROUP BY address)""")
def busiest(spark: SparkSession, d: str) -> DataFrame:
    """The most fills of an account, and within one millisecond of one account."""
    per_ms = acc.usable(read(spark, d, "fills").where("address is not null")).groupBy("address", "time_ms").agg(F.count(F.lit(1)).alias("c"))
    return per_ms.groupBy("address").agg(F.sum("c").alias("n"), F.max("c").alias("m")).agg(F.max("n").alias("most_fills"), F.max("m").alias("most_in_ms"))
