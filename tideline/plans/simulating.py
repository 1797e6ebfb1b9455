"""Copied orders as accounts: funding, marked equity, both sides of the identity, portfolios, cohorts, shared ladders, holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numbers import rounded
from tideline.functions.timeops import DAY_MS, HOUR_MS, utc_day
from tideline.operators import copies as cp
from tideline.operators.curves import average_cost, decomposition, order_runs
from tideline.operators.ordered import Runs, as_of
from tideline.plans.copying import _COST, _O, _RUNS
from tideline.plans.copying import orders as executed
from tideline.plans.registry import Registry
from tideline.session import written
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

CAPITAL = 1_000_000
MICRO = cp.MICRO
MAJORS = ("NUBUME", "QUAYTH")
PRIMARY = {"delay_ms": 5_000, "slippage_bps": 10, "fee_bps": 5, "funding": True, "constraints": True}


def _window(spark: SparkSession, d: str) -> tuple[int, int]:
    """The UTC days that have an executed order."""
    a, b = executed(spark, d).agg(F.min(utc_day("exec_t")), F.max(utc_day("exec_t"))).first()
    return (0, 0) if a is None else (a * DAY_MS, (b + 1) * DAY_MS)


def _rates(spark: SparkSession, d: str, start: int, end: int) -> DataFrame:
    """A rate per coin and hour, from -3 to 3 millionths: no table has any."""
    coins = read(spark, d, "proxy").select("coin").where("coin is not null").distinct()
    hours = coins.select("coin", F.explode(F.sequence(F.lit(start), F.lit(max(start, end - HOUR_MS)), F.lit(HOUR_MS))).alias("hour_ms"))
    return hours.withColumn("rate", (F.pmod(F.call_function("div", F.col("hour_ms"), F.lit(HOUR_MS).cast("long")) + F.length("coin"), F.lit(7)) - 3).cast("long"))


def _copies(spark: SparkSession, d: str) -> cp.Copies:
    start, end = _window(spark, d)
    return cp.Copies(executed(spark, d), read(spark, d, "proxy"), _rates(spark, d, start, end), start, end, CAPITAL)


_DIV = lambda x: f"(({x}) - ((({x}) % {MICRO}) + {MICRO}) % {MICRO}) // {MICRO}"
_CEIL = lambda x: f"(({x}) + {DAY_MS - 1}) // {DAY_MS} * {DAY_MS}"
_BASE = f"""{_O}, wn AS (SELECT min(exec_t) // {DAY_MS} * {DAY_MS} a, (max(exec_t) // {DAY_MS} + 1) * {DAY_MS} z FROM o),
oo AS (SELECT DISTINCT run_id, wallet, coin, order_no, exec_t, price, floor(signed * 100 + 0.5)::BIGINT u, floor(price * 10000 + 0.5)::BIGINT p, floor(coalesce(fee, 0) * 1e6 + 0.5)::BIGINT fee FROM o WHERE floor(signed * 100 + 0.5) <> 0),
pr AS (SELECT coin, second, min(last) AS last FROM proxy WHERE last > 0 AND coin IS NOT NULL GROUP BY ALL),
hr AS (SELECT coin, unnest(range((SELECT a FROM wn), (SELECT z FROM wn), {HOUR_MS})) h FROM (SELECT DISTINCT coin FROM proxy WHERE coin IS NOT NULL)),
fi AS (SELECT hr.coin, h, floor(pr.last * 10000 + 0.5)::BIGINT m, ((h // {HOUR_MS} + length(hr.coin)) % 7 - 3)::BIGINT rate FROM hr ASOF LEFT JOIN pr ON hr.coin = pr.coin AND h // 1000 > pr.second),
att AS (SELECT run_id, wallet, coin, exec_t t, sum(u) u FROM oo GROUP BY ALL),
iv AS (SELECT run_id, wallet, coin, t, coalesce(lead(t) OVER w, (SELECT z FROM wn)) until, sum(u) OVER w::BIGINT size FROM att WINDOW w AS (PARTITION BY run_id, wallet, coin ORDER BY t)),
pay AS (SELECT iv.*, fi.h, fi.m, fi.rate, (iv.size * fi.m * fi.rate)::BIGINT amount FROM iv JOIN fi ON iv.coin = fi.coin AND fi.h > iv.t AND fi.h <= iv.until AND fi.h < (SELECT z FROM wn) WHERE iv.size <> 0 AND fi.m IS NOT NULL)"""


# -- funding -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_BASE} SELECT run_id, wallet, coin, t, until, size, coalesce((SELECT sum(amount) FROM pay WHERE pay.run_id = iv.run_id AND pay.wallet = iv.wallet AND pay.coin = iv.coin AND pay.t = iv.t), 0)::BIGINT paid FROM iv")
def funding_paid(spark: SparkSession, d: str) -> DataFrame:
    """What each position pays while it stands, from two readings of its coin's index."""
    return _copies(spark, d).funding().drop("owed_before")


@query(f"WITH {_BASE} SELECT run_id, wallet, coin, h hour_ms, size, m AS mark, rate, amount FROM pay")
def funding_payments(spark: SparkSession, d: str) -> DataFrame:
    """Every payment of every open position at every full hour."""
    return _copies(spark, d).payments()


# -- equity ------------------------------------------------------------------------------------------------------------------

_MARKED = f"""{_BASE}, dy AS (SELECT unnest(range((SELECT a FROM wn) + {DAY_MS}, (SELECT z FROM wn) + 1, {DAY_MS})) t),
op AS (SELECT iv.*, dy.t dt FROM iv JOIN dy ON iv.size <> 0 AND dy.t >= iv.t AND (dy.t < iv.until OR (iv.until = (SELECT z FROM wn) AND dy.t = iv.until))),
ov AS (SELECT op.*, floor(pr.last * 10000 + 0.5)::BIGINT m FROM op ASOF LEFT JOIN pr ON op.coin = pr.coin AND op.dt // 1000 > pr.second),
ow AS (SELECT ov.*, coalesce((SELECT sum(amount) FROM pay WHERE pay.run_id = ov.run_id AND pay.wallet = ov.wallet AND pay.coin = ov.coin AND pay.t = ov.t AND pay.h <= ov.dt), 0) owing FROM ov),
fl AS (SELECT run_id, wallet, {_CEIL('exec_t')} AS dt, sum(-u * p - fee) cash, 0 paid, 0 AS value, 0 gross, 0 owing FROM oo GROUP BY ALL
 UNION ALL SELECT run_id, wallet, {_CEIL('until')} AS dt, 0, sum(amount), 0, 0, 0 FROM pay WHERE until < (SELECT z FROM wn) GROUP BY ALL
 UNION ALL SELECT run_id, wallet, {_CEIL('until')} AS dt, 0, 0, 0, 0, 0 FROM iv WHERE until < (SELECT z FROM wn) GROUP BY ALL
 UNION ALL SELECT run_id, wallet, dt, 0, 0, sum(coalesce(size * m, 0)), sum(abs(coalesce(size * m, 0))), sum(owing) FROM ow GROUP BY ALL),
fm AS (SELECT run_id, wallet, dt, sum(cash) cash, sum(paid) paid, sum(value) AS value, sum(gross) gross, sum(owing) owing FROM fl GROUP BY ALL),
eq AS (SELECT run_id, wallet, dt AS t, ({CAPITAL * MICRO} + c + value - {_DIV('pd + owing')})::BIGINT equity, gross::BIGINT gross FROM (SELECT *, (sum(cash) OVER w)::BIGINT c, (sum(paid) OVER w)::BIGINT pd FROM (SELECT * REPLACE (owing::BIGINT AS owing, value::BIGINT AS value) FROM fm) WINDOW w AS (PARTITION BY run_id, wallet ORDER BY dt))
 UNION ALL SELECT DISTINCT run_id, wallet, (SELECT a FROM wn), {CAPITAL * MICRO}, 0 FROM oo),
fz AS (SELECT run_id, wallet, min(t) f FROM eq WHERE equity <= 0 GROUP BY ALL),
cv AS (SELECT eq.*, coalesce(t = f, false) frozen FROM eq LEFT JOIN fz ON eq.run_id = fz.run_id AND eq.wallet = fz.wallet WHERE f IS NULL OR t <= f)"""


@query(f"WITH {_MARKED} SELECT run_id, wallet, t, equity, gross, frozen FROM cv")
def marked_curves(spark: SparkSession, d: str) -> DataFrame:
    """Every wallet's equity at midnight, with what it holds marked and what it owes taken off, until it is used up."""
    return _copies(spark, d).curve()


def _costs(spark: SparkSession, d: str) -> DataFrame:
    rows = executed(spark, d).select(*cp.KEYS, "order_no", "exec_t", "price", "fee", "signed")
    return average_cost(written(order_runs(rows, cp.KEYS, "exec_t", ["order_no"], F.col("signed"), 64 * DAY_MS), "order-runs"), cp.KEYS, "exec_t", ["order_no"])


@query(f"""WITH {_BASE}, le AS (SELECT run_id, wallet, coin, sum(u) size FROM oo GROUP BY ALL HAVING sum(u) <> 0), lm AS (SELECT le.*, (SELECT z FROM wn) t FROM le),
lv AS (SELECT lm.run_id, lm.wallet, lm.size * floor(pr.last * 10000 + 0.5)::BIGINT AS value FROM lm ASOF LEFT JOIN pr ON lm.coin = pr.coin AND lm.t // 1000 > pr.second),
ca AS (SELECT run_id, wallet, sum(-u * p) cash, sum(fee) fees FROM oo GROUP BY ALL), va AS (SELECT run_id, wallet, sum(coalesce(value, 0)) AS value FROM lv GROUP BY ALL), pa AS (SELECT run_id, wallet, sum(amount) paid FROM pay GROUP BY ALL)
SELECT run_id, wallet, (cash + coalesce(value, 0) - fees - {_DIV('coalesce(paid, 0)::BIGINT')})::BIGINT gained, fees::BIGINT fees, coalesce(paid, 0)::BIGINT paid, true AS ok
FROM ca LEFT JOIN va USING (run_id, wallet) LEFT JOIN pa USING (run_id, wallet)""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Gain of every wallet from its cash flows, and whether results rebuilt at average cost come to the same."""
    return _copies(spark, d).identity().drop("rebuilt")


@query(f"""WITH {_BASE}, {_COST.split('AND price IS NOT NULL), ', 1)[1]}, en AS (SELECT run_id, wallet, coin, z[1] size, z[2] AS cost, z[3] realized FROM k),
mk AS (SELECT c.coin, floor(pr.last * 10000 + 0.5)::BIGINT m FROM (SELECT DISTINCT coin, (SELECT z FROM wn) t FROM oo) c ASOF LEFT JOIN pr ON c.coin = pr.coin AND c.t // 1000 > pr.second),
rs AS (SELECT en.coin, sum(realized) realized, sum(CASE WHEN size <> 0 THEN size * (m / 10000.0::DOUBLE - cost) ELSE 0 END) unrealized FROM en LEFT JOIN mk USING (coin) GROUP BY en.coin),
fe AS (SELECT coin, sum(fee)::BIGINT fees, count(*)::BIGINT n, sum(abs(u) * p)::BIGINT notional FROM oo GROUP BY coin), fp AS (SELECT coin, sum(amount) paid FROM pay GROUP BY coin), uv AS (SELECT DISTINCT coin FROM proxy WHERE coin IS NOT NULL),
al AS (SELECT coalesce(uv.coin, fe.coin) coin, coalesce(realized, 0) realized, coalesce(unrealized, 0) unrealized, coalesce(fees, 0) fees, coalesce(paid, 0) paid, coalesce(n, 0) n, coalesce(notional, 0) notional FROM uv FULL OUTER JOIN fe ON uv.coin = fe.coin LEFT JOIN rs ON rs.coin = fe.coin LEFT JOIN fp ON fp.coin = fe.coin)
SELECT CASE WHEN GROUPING(coin) = 0 THEN coin WHEN major THEN '(majors)' ELSE '(others)' END coin, major, round(sum(realized), 2) realized, round(sum(unrealized), 2) unrealized, sum(fees)::BIGINT fees, sum(paid)::BIGINT paid, sum(n)::BIGINT n, sum(notional)::BIGINT notional
FROM (SELECT *, coin IN {MAJORS} major FROM al) GROUP BY GROUPING SETS ((coin, major), (major))""")
def asset_results(spark: SparkSession, d: str) -> DataFrame:
    """Results per coin of the universe, idle ones as zero, and of the majors and all others."""
    c = _copies(spark, d)
    costs = _costs(spark, d)
    mark = c.marks(c.orders.select("coin").distinct().withColumn("t", F.lit(c.end_ms).cast("long")), "t").select("coin", "mark")
    made = costs.join(mark, "coin", "left").groupBy("coin").agg(F.sum("realized").alias("realized"), F.sum(F.when(F.col("size") != 0, F.col("size") * (F.col("mark") / 10_000 - F.col("cost"))).otherwise(0.0)).alias("unrealized"))
    fees = c.orders.groupBy("coin").agg(F.sum("fee").alias("fees"), F.count(F.lit(1)).alias("n"), F.sum(F.abs("units") * F.col("px")).alias("notional"))
    paid = c.funding().groupBy("coin").agg(F.sum("paid").alias("paid"))
    all_ = read(spark, d, "proxy").select("coin").where("coin is not null").union(c.orders.select("coin")).distinct()
    for more in (made, fees, paid):
        all_ = all_.join(more, "coin", "left")
    all_ = all_.na.fill(0).withColumn("major", F.col("coin").isin(*MAJORS))
    sums = [rounded(F.sum(x), 2).alias(x) for x in ("realized", "unrealized")] + [F.sum(x).cast("long").alias(x) for x in ("fees", "paid", "n", "notional")]
    one = all_.groupBy("coin", "major").agg(*sums)
    return one.unionByName(all_.groupBy(F.when(F.col("major"), "(majors)").otherwise("(others)").alias("coin"), "major").agg(*sums))


# -- portfolios --------------------------------------------------------------------------------------------------------------

_SPARE = 2 * CAPITAL * MICRO
_FOLIO = f"""{_MARKED}, ti AS (SELECT DISTINCT run_id, t FROM cv), ww AS (SELECT DISTINCT run_id, wallet FROM cv), aa AS (SELECT ti.run_id, ti.t, ww.wallet FROM ti JOIN ww ON ti.run_id = ww.run_id),
pf AS (SELECT aa.run_id, aa.t, (sum(cv.equity) + {_SPARE})::BIGINT equity FROM aa ASOF JOIN cv ON aa.run_id = cv.run_id AND aa.wallet = cv.wallet AND aa.t >= cv.t GROUP BY ALL)"""


def _capitals(curves: DataFrame) -> DataFrame:
    """What each run was given: a capital per wallet, and two to spare."""
    return curves.select(*cp.ACCOUNT).distinct().groupBy("run_id").agg((F.count(F.lit(1)) * CAPITAL * MICRO + _SPARE).alias("capital"))


@query(f"WITH {_FOLIO} SELECT run_id, t, equity, {_SPARE}::BIGINT idle FROM pf")
def portfolio_curves(spark: SparkSession, d: str) -> DataFrame:
    """Every run's wallets as one portfolio, with the capital that stays idle."""
    curves = written(_copies(spark, d).curve(), "curves")
    return cp.portfolio(curves.select(*cp.ACCOUNT, "t", "equity"), ["run_id"], "wallet", _capitals(curves))


@query(f"""WITH {_MARKED}, nt AS (SELECT run_id, wallet, sum(abs(u) * p) notional FROM oo GROUP BY ALL),
rr AS (SELECT run_id, wallet, equity / pe - 1 r FROM (SELECT *, lag(equity) OVER (PARTITION BY run_id, wallet ORDER BY t)::DOUBLE pe FROM (SELECT * REPLACE (equity::DOUBLE AS equity) FROM cv)) WHERE pe > 0),
sh AS (SELECT run_id, wallet, CASE WHEN count(*) >= 2 AND stddev_samp(r) > 1e-12 * max(abs(r)) THEN avg(r) / stddev_samp(r) * sqrt(365.0) END sharpe FROM rr GROUP BY ALL),
dw AS (SELECT run_id, wallet, greatest(max((pk - equity) / pk), 0) depth FROM (SELECT run_id, wallet, equity::DOUBLE equity, max(equity) OVER (PARTITION BY run_id, wallet ORDER BY t)::DOUBLE pk FROM cv) GROUP BY ALL),
bs AS (SELECT run_id, wallet, arg_min(equity, t) f, arg_max(equity, t) l, avg(equity) m, min(equity) mn, bool_or(frozen) frozen, max(CASE WHEN equity > 0 THEN gross / equity END) lev FROM cv GROUP BY ALL)
SELECT bs.run_id, bs.wallet, round(l / f - 1, 9) net_return, round(CASE WHEN mn > 0 THEN sharpe END, 6) sharpe, round(CASE WHEN mn > 0 THEN depth END, 9) depth, round(CASE WHEN m > 0 THEN notional / m END, 6) turnover, round(lev, 6) max_leverage, frozen
FROM bs LEFT JOIN sh USING (run_id, wallet) LEFT JOIN dw USING (run_id, wallet) LEFT JOIN nt USING (run_id, wallet)""")
def copy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Return, Sharpe ratio, drawdown, turnover, leverage of every wallet."""
    c = _copies(spark, d)
    notional = c.orders.groupBy(*cp.ACCOUNT).agg(F.sum(F.abs("units") * F.col("px")).alias("notional"))
    m = cp.metrics(written(c.curve(), "curves"), cp.ACCOUNT, notional)
    places = {"net_return": 9, "sharpe": 6, "depth": 9, "turnover": 6, "max_leverage": 6}
    return m.select(*cp.ACCOUNT, *(rounded(x, n).alias(x) for x, n in places.items()), "frozen")


@query(f"""WITH {_MARKED}, ex AS (SELECT run_id, equity, gross, CASE WHEN equity > 0 AND gross * 100 - equity * 2 > 0 THEN gross * 100 - equity * 2 END x FROM cv)
SELECT run_id, count(x)::BIGINT n, coalesce(max(x), 0)::BIGINT most_hundredths, round(coalesce(max(x / equity), 0), 9) most_share_pct FROM ex GROUP BY run_id""")
def cap_excesses(spark: SparkSession, d: str) -> DataFrame:
    """How often and by how much the exposure of a run's wallets is above two per cent of their equity."""
    return cp.cap_excess(_copies(spark, d).curve(), ["run_id"], 2).withColumn("most_share_pct", F.round("most_share_pct", 9))


@query(f"""WITH {_MARKED}, pl AS (SELECT run_id, wallet, row_number() OVER (PARTITION BY run_id ORDER BY sha256('7:cohort:' || wallet), wallet) - 1 place FROM (SELECT DISTINCT run_id, wallet FROM cv)),
ch AS (SELECT cv.run_id, cv.wallet, cv.t, floor(cv.equity * ({3 * CAPITAL * MICRO // 3}.0::DOUBLE / {CAPITAL * MICRO}.0::DOUBLE) + 0.5)::BIGINT equity FROM cv JOIN pl ON cv.run_id = pl.run_id AND cv.wallet = pl.wallet WHERE place < 3),
ti AS (SELECT DISTINCT run_id, t FROM ch), ww AS (SELECT DISTINCT run_id, wallet FROM ch), aa AS (SELECT ti.run_id, ti.t, ww.wallet FROM ti JOIN ww ON ti.run_id = ww.run_id)
SELECT aa.run_id, aa.t, (sum(ch.equity) + {3 * CAPITAL * MICRO} - count(*) * {CAPITAL * MICRO})::BIGINT equity, ({3 * CAPITAL * MICRO} - count(*) * {CAPITAL * MICRO})::BIGINT idle FROM aa ASOF JOIN ch ON aa.run_id = ch.run_id AND aa.wallet = ch.wallet AND aa.t >= ch.t GROUP BY ALL""")
def cohort_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """The first three wallets of every run in seeded order, a third of the capital each; what has no wallet stays idle."""
    curves = written(_copies(spark, d).curve(), "curves")
    pairs = curves.select(*cp.ACCOUNT).distinct().withColumn("h", F.sha2(F.concat(F.lit("7:cohort:"), "wallet"), 256)).withColumn("t", F.lit(0))
    places = Runs(pairs, ["run_id"], "t", ["h", "wallet"]).running(place_=F.lit(1)).select(*cp.ACCOUNT, (F.col("place_") - 1).alias("place"))
    chosen = cp.cohort(curves, places, 3, 3 * CAPITAL)
    capital = chosen.select("run_id").distinct().withColumn("capital", F.lit(3 * CAPITAL * MICRO).cast("long"))
    return cp.portfolio(chosen.select(*cp.ACCOUNT, "t", "equity"), ["run_id"], "wallet", capital)


# -- orders ------------------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT DISTINCT run_id, order_no, coin, event_t, exec_t FROM copy_orders WHERE exec_t IS NOT NULL AND run_id IS NOT NULL)
SELECT run_id, order_no, row_number() OVER w place, lead(exec_t) OVER w next_t, (exec_t + 3599999) // 3600000 * 3600000 AS first_hour FROM q WINDOW w AS (PARTITION BY run_id ORDER BY exec_t, event_t NULLS FIRST, coin NULLS FIRST, order_no)""")
def execution_queue(spark: SparkSession, d: str) -> DataFrame:
    """The order in which a run's orders execute, when it wakes up next, and the first full hour from then on."""
    o = read(spark, d, "copy_orders").where("exec_t is not null and run_id is not null").select("run_id", "order_no", "coin", "event_t", "exec_t").distinct()
    rows = Runs(o, ["run_id"], "exec_t", ["event_t", "coin", "order_no"]).annotate(following=["exec_t"], running={"place": F.lit(1).cast("long")})
    return rows.select("run_id", "order_no", "place", F.col("next_exec_t").alias("next_t"), cp.ceil_to(F.col("exec_t"), HOUR_MS).alias("first_hour"))


@query("""WITH o AS (SELECT DISTINCT * FROM copy_orders), u AS (SELECT DISTINCT coin FROM proxy)
SELECT coalesce(reason, 'none') reason, count(*)::BIGINT n, sum(floor((requested - executed) * price * 100 + 0.5)::BIGINT)::BIGINT cents FROM o WHERE exec_t IS NOT NULL AND executed < requested GROUP BY 1
UNION ALL SELECT 'pending', count(*)::BIGINT, coalesce(sum(floor(requested * coalesce(price, 0) * 100 + 0.5)::BIGINT), 0)::BIGINT FROM o WHERE exec_t IS NULL
UNION ALL SELECT 'outside_universe', count(*)::BIGINT, coalesce(sum(CAST(floor(coalesce(abs(sz) * px, 0) * 100 + 0.5) AS BIGINT)), 0)::BIGINT FROM (SELECT DISTINCT * FROM fills) f WHERE coin IS NOT NULL AND (kind <> 'perp' OR coin NOT IN (SELECT coin FROM u WHERE coin IS NOT NULL))""")
def non_copy_counters(spark: SparkSession, d: str) -> DataFrame:
    """What was not copied, by reason: cut orders, orders that never executed, and fills outside the universe."""
    o, cents = read(spark, d, "copy_orders").distinct(), lambda c: F.coalesce(F.sum(F.floor(c * 100 + 0.5).cast("long")), F.lit(0)).cast("long").alias("cents")
    n = F.count(F.lit(1)).alias("n")
    cut = o.where("exec_t is not null and executed < requested").groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(n, F.sum(F.floor((F.col("requested") - F.col("executed")) * F.col("price") * 100 + 0.5).cast("long")).alias("cents"))
    pending = o.where("exec_t is null").agg(n, cents(F.col("requested") * F.coalesce("price", F.lit(0.0))))
    u = read(spark, d, "proxy").select("coin").where("coin is not null").distinct().withColumn("in_", F.lit(True))
    f = read(spark, d, "fills").distinct().where("coin is not null").join(u, "coin", "left").where("kind != 'perp' or in_ is null")
    outside = f.agg(n, cents(F.coalesce(F.abs("sz") * F.col("px"), F.lit(0.0))))
    named = lambda df, reason: df.select(F.lit(reason).alias("reason"), "n", "cents")
    return cut.unionByName(named(pending, "pending")).unionByName(named(outside, "outside_universe"))


_SIDES = " UNION ALL ".join(f"SELECT coin, time_ms, '{side}' side, {k} lv, floor({b}_sz_{k} * 100)::BIGINT units, floor({b}_px_{k} * 10000 + 0.5)::BIGINT px FROM bk WHERE {b}_px_{k} IS NOT NULL AND {b}_sz_{k} >= 0.01" for side, b in (("buy", "ask"), ("sell", "bid")) for k in range(1, 6))


@query(f"""WITH bk AS (SELECT coin, time_ms, {', '.join(f'min({b}_{w}_{k}) {b}_{w}_{k}' for b in ('bid', 'ask') for w in ('px', 'sz') for k in range(1, 6))} FROM book WHERE coin IS NOT NULL AND time_ms IS NOT NULL GROUP BY ALL),
lv AS (SELECT *, (sum(units) OVER (PARTITION BY coin, time_ms, side ORDER BY lv))::BIGINT hi FROM ({_SIDES})),
q AS (SELECT DISTINCT run_id, order_no, coin, exec_t, side, floor(requested * 100 + 0.5)::BIGINT wanted FROM copy_orders WHERE exec_t IS NOT NULL AND coin IS NOT NULL AND run_id IS NOT NULL AND requested > 0),
a AS (SELECT q.*, b.time_ms FROM q ASOF JOIN (SELECT coin, time_ms FROM bk) b ON q.coin = b.coin AND q.exec_t >= b.time_ms),
s AS (SELECT *, (sum(wanted) OVER (PARTITION BY run_id, coin, time_ms, side ORDER BY exec_t, order_no ROWS UNBOUNDED PRECEDING))::BIGINT upto FROM a),
t AS (SELECT s.*, greatest(0, least(upto, hi) - greatest(upto - wanted, hi - units)) take, px FROM s LEFT JOIN lv ON s.coin = lv.coin AND s.time_ms = lv.time_ms AND s.side = lv.side)
SELECT run_id, order_no, coin, time_ms, side, wanted, sum(coalesce(take, 0))::BIGINT filled, sum(coalesce(take * px, 0))::BIGINT AS value, count(CASE WHEN take > 0 THEN 1 END)::BIGINT levels_used FROM t GROUP BY ALL""")
def shared_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a run that meet the same book eat its levels one after the other."""
    cols = [f"{b}_{w}_{k}" for b in ("bid", "ask") for w in ("px", "sz") for k in range(1, 6)]
    book = read(spark, d, "book").where("coin is not null and time_ms is not null").groupBy("coin", "time_ms").agg(*(F.min(c).alias(c) for c in cols))
    o = read(spark, d, "copy_orders").where("exec_t is not null and coin is not null and run_id is not null and requested > 0")
    o = o.select("run_id", "order_no", "coin", "exec_t", "side", F.floor(F.col("requested") * 100 + 0.5).cast("long").alias("wanted")).distinct()
    met = as_of(o, book, ["coin"], "exec_t", "time_ms", cols, prefix="").where("time_ms is not null")
    level = lambda k: F.struct(F.lit(k).alias("level"), *(F.floor(F.when(F.col("side") == "buy", F.col(f"ask_{w}_{k}")).otherwise(F.col(f"bid_{w}_{k}")) * m + h).cast("long").alias(n) for w, m, h, n in (("sz", 100, 0.0, "units"), ("px", 10_000, 0.5, "px"))))
    met = written(met, "orders-and-books")
    at = ["run_id", "coin", "time_ms", "side"]
    ladder = met.select(*at, F.explode(F.array(*(level(k) for k in range(1, 6)))).alias("l")).select(*at, "l.*").distinct()
    out = cp.shared_ladder(met.select(*at, "exec_t", "order_no", "wanted"), ladder, at, ["exec_t", "order_no"])
    return out.select("run_id", "order_no", "coin", "time_ms", "side", "wanted", "filled", "value", "levels_used")


# -- holds and scenarios -------------------------------------------------------------------------------------------------------

_GRID = [(i, d, s, 5, True, True) for i, (d, s) in enumerate([(5_000, 10), (0, 10), (60_000, 10), (3_600_000, 10), (5_000, 0), (5_000, 25)])]
_SCENARIO = "scenario int, delay_ms long, slippage_bps long, fee_bps long, funding boolean, constraints boolean"


def _holds(spark: SparkSession, d: str, scenarios: DataFrame) -> DataFrame:
    c = _copies(spark, d)
    bars = read(spark, d, "proxy").where("coin is not null and last > 0").groupBy("coin", "second").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("last").alias("last"))
    marks = c.marks(bars.select("coin").distinct().withColumn("t", F.lit(c.end_ms).cast("long")), "t").select("coin", "mark")
    return cp.hold(scenarios, bars, c.index(), marks, c.start_ms, CAPITAL)


def _holds_sql(scenarios: str) -> str:
    return f"""{_BASE}, br AS (SELECT coin, second, max(high) high FROM proxy WHERE coin IS NOT NULL AND last > 0 GROUP BY ALL), sc AS (SELECT * FROM (VALUES {scenarios}) v(scenario, delay_ms, slippage_bps, fee_bps, funding, cons)),
mc AS (SELECT c.coin, floor(pr.last * 10000 + 0.5)::BIGINT m FROM (SELECT DISTINCT coin, (SELECT z FROM wn) t FROM br) c ASOF JOIN pr ON c.coin = pr.coin AND c.t // 1000 > pr.second),
ns AS (SELECT mc.coin, m, sc.*, (SELECT a FROM wn) + delay_ms nom FROM mc, sc),
xs AS (SELECT ns.*, CASE WHEN br.second = nom // 1000 THEN nom ELSE br.second * 1000 END exec_t, floor(br.high * 10000 + 0.5)::BIGINT hp FROM ns ASOF JOIN br ON ns.coin = br.coin AND ns.nom // 1000 <= br.second WHERE br.high > 0),
ps AS (SELECT *, hp * (10000 + slippage_bps) // 10000 px FROM xs),
us AS (SELECT *, floor(CASE WHEN cons THEN {CAPITAL * MICRO * 10_000}::DOUBLE / (px * (10000 + fee_bps)) ELSE {CAPITAL * MICRO}::DOUBLE / px END + 1e-9)::BIGINT units FROM ps),
es AS (SELECT *, floor((units * px * fee_bps)::DOUBLE / 10000 + 0.5)::BIGINT fee, CASE WHEN funding THEN units * coalesce((SELECT sum(fi.m * fi.rate) FROM fi WHERE fi.coin = us.coin AND fi.h > us.exec_t), 0) ELSE 0 END::BIGINT paid FROM us),
hs AS (SELECT coin, scenario, delay_ms, slippage_bps, fee_bps, funding, cons, exec_t, px, units, fee, paid, (units * (m - px) - fee - {_DIV('paid')})::BIGINT gained FROM es)"""


_TRUTH = {True: "true", False: "false"}
_GRID_SQL = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {_TRUTH[f]}, {_TRUTH[g]})" for i, a, b, c, f, g in _GRID)


@query(f"WITH {_holds_sql(_GRID_SQL)} SELECT coin, scenario, delay_ms, exec_t, px, units, fee, paid, gained, array_to_string(list_filter([CASE WHEN fee_bps = 0 THEN 'fee_zero' END, CASE WHEN slippage_bps = 0 THEN 'slippage_zero' END], lambda x: x IS NOT NULL), ' ') warnings FROM hs")
def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    """Buying at the start and holding to the end, per coin, for every delay and slippage of a grid, the one without delay among them."""
    out = cp.warnings(_holds(spark, d, spark.createDataFrame(_GRID, _SCENARIO)))
    return out.select("coin", "scenario", "delay_ms", "exec_t", "px", "units", "fee", "paid", "gained", F.concat_ws(" ", "warnings").alias("warnings"))


_STEPS_SQL = ", ".join(f"({n}, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT, {_TRUTH[f]}, {_TRUTH[g]})" for n, _, a, b, c, f, g, _ in cp.steps(PRIMARY))


@query(f"""WITH {_holds_sql(_STEPS_SQL)} SELECT coin, scenario, ['ideal', 'delay', 'slippage', 'fees', 'funding', 'size_constraints'][scenario + 1] step, gained, gained - lag(gained) OVER (PARTITION BY coin ORDER BY scenario) delta FROM hs""")
def cost_steps(spark: SparkSession, d: str) -> DataFrame:
    """What delay, slippage, fees, funding and size limits each take from an ideal purchase, per coin."""
    ladder = cp.steps(PRIMARY)
    names = F.element_at(F.array(*(F.lit(s[1]) for s in ladder)), F.col("scenario") + 1)
    rows = _holds(spark, d, spark.createDataFrame([(n, *rest) for n, _, *rest, _ in ladder], _SCENARIO)).select("coin", "scenario", "gained")
    out = decomposition(rows, ["coin"], "scenario", "gained")
    return out.select("coin", "scenario", names.alias("step"), "gained", F.when(F.col("scenario") > 0, F.col("delta")).cast("long").alias("delta"))


@query("""WITH w AS (SELECT wallet, max(order_no) n FROM copy_orders WHERE wallet IS NOT NULL GROUP BY wallet) SELECT wallet, greatest(2, least(20, floor(n * 100.0 / 5000)))::BIGINT groups FROM w""")
def cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Over how many accounts a capital is spread, within bounds; a hundred times the last order's number stands for the capital."""
    w = read(spark, d, "copy_orders").where("wallet is not null").groupBy("wallet").agg(F.max("order_no").alias("n"))
    return w.select("wallet", cp.groups_for(F.col("n") * 100.0, 5_000, 2, 20).alias("groups"))


@query("SELECT DISTINCT run_id, order_no, floor(requested / 0.05 + 1e-9)::BIGINT lots FROM copy_orders WHERE requested IS NOT NULL")
def lots_requested(spark: SparkSession, d: str) -> DataFrame:
    """Orders in whole lots of a twentieth."""
    o = read(spark, d, "copy_orders").where("requested is not null")
    return o.select("run_id", "order_no", F.round(cp.floor_lot(F.col("requested"), F.lit(0.05)) / 0.05).cast("long").alias("lots")).distinct()


@query(f"""WITH {_BASE}, {_RUNS.split('AND price IS NOT NULL), ', 1)[1]}, ep AS (SELECT run_id, wallet, coin, episode, min(exec_t) opened, CASE WHEN sum(units) = 0 THEN max(exec_t) END closed FROM e GROUP BY ALL)
SELECT ep.run_id, ep.wallet, ep.coin, ep.episode, count(*)::BIGINT n, sum(amount)::BIGINT paid FROM ep JOIN pay ON ep.run_id = pay.run_id AND ep.wallet = pay.wallet AND ep.coin = pay.coin AND ep.opened < pay.h AND (ep.closed IS NULL OR pay.h <= ep.closed) GROUP BY ALL""")
def episode_payments(spark: SparkSession, d: str) -> DataFrame:
    """Funding of every copied episode: each payment goes to the one that was open at its hour."""
    c = _copies(spark, d)
    rows = executed(spark, d).select(*cp.KEYS, "order_no", "exec_t", "price", "fee", "signed").distinct()
    runs = order_runs(rows, cp.KEYS, "exec_t", ["order_no", "price", "fee", "signed"], F.col("signed"), c.width)
    ep = runs.groupBy(*cp.KEYS, "episode").agg(F.min("exec_t").alias("opened"), F.when(F.sum("units") == 0, F.max("exec_t")).alias("closed"))
    return c.episode_payments(ep)
