"""Copied orders: runs of orders from flat to flat, average cost, curves and what they show, walks down the book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.numbers import rounded
from tideline.functions.timeops import DAY_MS, utc_day
from tideline.operators.curves import average_cost, drawdowns, ladder_fill, order_runs, returns, sharpe, together
from tideline.operators.ordered import Runs, split_ms
from tideline.plans.registry import Registry
from tideline.session import written
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

KEYS = ["run_id", "wallet", "coin"]


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Executed orders, without rows repeated as a whole, with a signed size."""
    o = read(spark, d, "copy_orders").distinct().where("exec_t is not null and coin is not null and run_id is not null and wallet is not null and executed > 0 and price is not null")
    return o.withColumn("signed", F.when(F.col("side") == "buy", F.col("executed")).otherwise(-F.col("executed")))


_O = """o AS (SELECT DISTINCT run_id, order_no, wallet, coin, exec_t, CASE WHEN side = 'buy' THEN executed ELSE -executed END signed, price, fee FROM copy_orders
 WHERE exec_t IS NOT NULL AND coin IS NOT NULL AND run_id IS NOT NULL AND wallet IS NOT NULL AND executed > 0 AND price IS NOT NULL)"""
_RUNS = f"""{_O}, n AS (SELECT *, floor(signed * 100 + 0.5)::BIGINT u FROM o), a AS (SELECT *, sum(u) OVER (PARTITION BY run_id, wallet, coin ORDER BY exec_t, order_no ROWS UNBOUNDED PRECEDING)::BIGINT af FROM n WHERE u <> 0),
p AS (SELECT *, 0 part, CASE WHEN sign(af - u) * sign(af) < 0 THEN -(af - u) ELSE u END units, af - u bf FROM a UNION ALL SELECT *, 1, af, 0 FROM a WHERE sign(af - u) * sign(af) < 0),
e AS (SELECT *, sum(CASE WHEN bf = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, wallet, coin ORDER BY exec_t, order_no, part ROWS UNBOUNDED PRECEDING)::BIGINT episode FROM p)"""


def _width(spark: SparkSession, d: str) -> int:
    return split_ms(read(spark, d, "copy_orders"), KEYS, "exec_t")


def _runs(spark: SparkSession, d: str, width: int | None = None) -> DataFrame:
    rows = orders(spark, d).select(*KEYS, "order_no", "exec_t", "price", "fee", "signed")
    return order_runs(rows, KEYS, "exec_t", ["order_no"], F.col("signed"), _width(spark, d) if width is None else width)


def _costs(spark: SparkSession, d: str) -> DataFrame:
    width = _width(spark, d)
    return average_cost(written(_runs(spark, d, width), "order-runs"), KEYS, "exec_t", ["order_no"], bucket_ms=width)


@query(f"WITH {_RUNS} SELECT run_id, wallet, coin, episode, min(exec_t) opened, max(exec_t) last_t, count(*)::BIGINT n_parts, sum(units)::BIGINT net_units FROM e GROUP BY ALL")
def copied_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).groupBy(*KEYS, "episode").agg(F.min("exec_t").alias("opened"), F.max("exec_t").alias("last_t"), F.count(F.lit(1)).alias("n_parts"), F.sum("units").alias("net_units"))


_COST = f"""{_RUNS}, k AS (SELECT run_id, wallet, coin, episode, min(exec_t) opened, count(*)::BIGINT n_parts, sum(abs(units) / 100.0::DOUBLE * price) notional,
 list_reduce(list_prepend([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE], list([units / 100.0::DOUBLE, price, 0.0::DOUBLE] ORDER BY exec_t, order_no, part)),
  lambda s, f: CASE WHEN abs(s[1] + f[1]) > abs(s[1]) THEN [s[1] + f[1], (s[1] * s[2] + f[1] * f[2]) / (s[1] + f[1]), s[3]]
   ELSE [CASE WHEN abs(s[1] + f[1]) < 0.005 THEN 0 ELSE s[1] + f[1] END, s[2], s[3] - f[1] * (f[2] - s[2])] END) z FROM e GROUP BY ALL)"""


@query(f"WITH {_COST} SELECT run_id, wallet, coin, episode, opened, n_parts, round(z[3], 2) realized, round(z[2], 8) AS cost, round(z[1], 6) AS size, round(notional, 2) notional FROM k")
def average_costs(spark: SparkSession, d: str) -> DataFrame:
    """Realized result, average cost and size left of each copied episode."""
    places = (("realized", 2), ("cost", 8), ("size", 6), ("notional", 2))
    return _costs(spark, d).select(*KEYS, "episode", "opened", "n_parts", *(rounded(c, n).alias(c) for c, n in places))


@query(f"WITH {_COST} SELECT run_id, count(*)::BIGINT n, round(avg(CASE WHEN round(z[3], 6) > 0 THEN 1.0 ELSE 0.0 END), 9) hit_rate FROM k WHERE z[1] = 0 GROUP BY run_id")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per run: closed episodes, and the share of them that gained."""
    c = _costs(spark, d).where("size = 0")
    return c.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.round("realized", 6) > 0).cast("double")), 9).alias("hit_rate"))


# -- curves --------------------------------------------------------------------------------------------------------------


def curve(spark: SparkSession, d: str) -> DataFrame:
    """run_id, wallet, t (a day's end), equity: a million plus a hundredth of the cash flows so far, in whole cents."""
    flow = F.floor(-F.col("signed") * F.col("price") + 0.5).cast("long")
    daily = orders(spark, d).groupBy("run_id", "wallet", ((utc_day("exec_t") + 1) * DAY_MS).alias("t")).agg(F.sum(flow).alias("cents"))
    so_far = Runs(daily, ["run_id", "wallet"], "t", []).running(sum_=F.col("cents"))
    return so_far.select("run_id", "wallet", "t", (F.lit(1e6) + F.col("sum_") / 100.0).alias("equity"))


_CURVE = f"""{_O}, y AS (SELECT run_id, wallet, (exec_t // {DAY_MS} + 1) * {DAY_MS} AS t, sum(floor(-signed * price + 0.5)::BIGINT) cents FROM o GROUP BY ALL),
curve AS (SELECT run_id, wallet, t, 1e6::DOUBLE + sum(cents) OVER (PARTITION BY run_id, wallet ORDER BY t)::BIGINT / 100.0::DOUBLE equity FROM y)"""
_RET = "r AS (SELECT run_id, wallet, t, equity / pe - 1 ret FROM (SELECT *, lag(equity) OVER (PARTITION BY run_id, wallet ORDER BY t) pe FROM curve) WHERE pe > 0)"


@query(f"WITH {_CURVE} SELECT run_id, wallet, t, equity FROM curve")
def equity_curves(spark: SparkSession, d: str) -> DataFrame:
    return curve(spark, d)


@query(f"WITH {_CURVE}, {_RET} SELECT run_id, wallet, t, round(ret, 9) ret FROM r")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return returns(curve(spark, d), ["run_id", "wallet"]).withColumn("ret", F.round("ret", 9))


@query(f"WITH {_CURVE}, {_RET} SELECT run_id, wallet, count(*)::BIGINT n, round(CASE WHEN count(*) >= 2 AND stddev_samp(ret) > 1e-12 * max(abs(ret)) THEN avg(ret) / stddev_samp(ret) * sqrt(365.0) END, 6) sharpe FROM r GROUP BY ALL")
def sharpe_ratios(spark: SparkSession, d: str) -> DataFrame:
    return sharpe(returns(curve(spark, d), ["run_id", "wallet"]), ["run_id", "wallet"], 365).withColumn("sharpe", F.round("sharpe", 6))


@query(f"""WITH {_CURVE}, m AS (SELECT *, max(equity) OVER w pk FROM curve WINDOW w AS (PARTITION BY run_id, wallet ORDER BY t)),
k AS (SELECT m.*, (pk - equity) / pk depth, (SELECT min(c.t) FROM curve c WHERE c.run_id = m.run_id AND c.wallet = m.wallet AND c.equity = m.pk AND c.t <= m.t) pt FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, wallet ORDER BY depth DESC, t) rn FROM k)
SELECT b.run_id, b.wallet, round(depth, 9) depth, CASE WHEN depth > 0 THEN pt END peak_t, CASE WHEN depth > 0 THEN t END trough_t,
 CASE WHEN depth > 0 THEN (SELECT min(c.t) FROM curve c WHERE c.run_id = b.run_id AND c.wallet = b.wallet AND c.t > b.t AND c.equity >= b.pk) END recovery_t FROM b WHERE rn = 1""")
def max_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return drawdowns(curve(spark, d), ["run_id", "wallet"]).withColumn("depth", F.round("depth", 9))


@query(f"""WITH {_CURVE}, i AS (SELECT DISTINCT run_id, t FROM curve), w AS (SELECT DISTINCT run_id, wallet FROM curve), a AS (SELECT i.run_id, i.t, w.wallet FROM i JOIN w ON i.run_id = w.run_id)
SELECT a.run_id, a.t, round(sum(c.equity), 2) equity FROM a ASOF JOIN curve c ON a.run_id = c.run_id AND a.wallet = c.wallet AND a.t >= c.t GROUP BY ALL""")
def curve_align(spark: SparkSession, d: str) -> DataFrame:
    """All wallets of a run as one curve: each counts with its last point so far."""
    return together(curve(spark, d), ["run_id"], "wallet").withColumn("equity", F.round("equity", 2))


# -- books and counters --------------------------------------------------------------------------------------------------

_WANTED = 25.0


@query(f"""WITH b AS (SELECT DISTINCT coin, time_ms, recv_ms, conn_ms, {', '.join(f'ask_px_{k}, ask_sz_{k}' for k in range(1, 6))} FROM book WHERE time_ms IS NOT NULL AND coin IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY coin, time_ms ORDER BY recv_ms, conn_ms, ask_px_1, ask_sz_1, ask_px_2, ask_sz_2) rn FROM b),
l AS ({' UNION ALL '.join(f'SELECT coin, time_ms, {k} lv, ask_px_{k} px, ask_sz_{k} sz FROM r WHERE rn = 1 AND ask_px_{k} IS NOT NULL AND ask_sz_{k} > 0' for k in range(1, 6))}),
c AS (SELECT *, greatest(0, least(sz, {_WANTED} - coalesce(sum(sz) OVER (PARTITION BY coin, time_ms ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) take FROM l)
SELECT coin, time_ms, round(sum(take), 6) filled, round(sum(take * px) / sum(take), 6) avg_px, count(CASE WHEN take > 0 THEN 1 END)::BIGINT levels_used FROM c GROUP BY ALL""")
def ladder_walks(spark: SparkSession, d: str) -> DataFrame:
    """A buy of stated size walked up the asks of every book."""
    cols = [f"ask_{w}_{k}" for k in range(1, 6) for w in ("px", "sz")]
    b = read(spark, d, "book").where("time_ms is not null and coin is not null").select("coin", "time_ms", "recv_ms", "conn_ms", *cols)
    known = [F.coalesce(c, F.lit(float("inf"))).alias(f"o_{c}") for c in cols[:4]]  # nulls last
    one = b.groupBy("coin", "time_ms").agg(F.min(F.struct("recv_ms", "conn_ms", *known, *cols)).alias("x"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("lv"), F.col(f"x.ask_px_{k}").alias("px"), F.col(f"x.ask_sz_{k}").alias("sz")) for k in range(1, 6))))
    rows = one.select("coin", "time_ms", levels.alias("l")).select("coin", "time_ms", "l.*")
    out = ladder_fill(rows, ["coin", "time_ms"], "lv", "sz", "px", _WANTED)
    return out.select("coin", "time_ms", F.round("filled", 6).alias("filled"), F.round("avg_px", 6).alias("avg_px"), "levels_used")


@query("""SELECT reason, count(*)::BIGINT n, sum(floor((requested - executed) * price * 100 + 0.5)::BIGINT)::BIGINT cents FROM (SELECT DISTINCT * FROM copy_orders) WHERE executed < requested GROUP BY reason""")
def not_copied(spark: SparkSession, d: str) -> DataFrame:
    """What was asked for but not executed, by reason."""
    o = read(spark, d, "copy_orders").distinct().where("executed < requested")
    return o.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor((F.col("requested") - F.col("executed")) * F.col("price") * 100 + 0.5).cast("long")).alias("cents"))


@query(f"""WITH {_O}, u AS (SELECT DISTINCT coin FROM proxy), x AS (SELECT coin, count(*) n, sum(floor(abs(signed) * price * 100 + 0.5)::BIGINT) c FROM o GROUP BY coin)
SELECT coalesce(u.coin, '(all)') coin, coalesce(sum(x.n), 0)::BIGINT n, coalesce(sum(x.c), 0)::BIGINT cents FROM u LEFT JOIN x USING (coin) GROUP BY ROLLUP (u.coin)""")
def asset_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Orders and notional per coin of the universe, idle ones as zero, and in all."""
    cents = F.floor(F.abs("signed") * F.col("price") * 100 + 0.5).cast("long")
    per = orders(spark, d).groupBy("coin").agg(F.count(F.lit(1)).alias("n_"), F.sum(cents).alias("c_"))
    u = read(spark, d, "proxy").select("coin").distinct().join(per, "coin", "left")
    return u.rollup("coin").agg(F.coalesce(F.sum("n_"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("c_"), F.lit(0)).cast("long").alias("cents")).select(F.coalesce("coin", F.lit("(all)")).alias("coin"), "n", "cents")


@query(f"WITH {_O} SELECT run_id, sum(floor(abs(signed) * price * 100 + 0.5)::BIGINT)::BIGINT turnover_cents, count(*)::BIGINT n, sum(floor(fee * 1e6 + 0.5)::BIGINT)::BIGINT fee_millionths FROM o GROUP BY run_id")
def turnovers(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy("run_id").agg(F.sum(F.floor(F.abs("signed") * F.col("price") * 100 + 0.5).cast("long")).alias("turnover_cents"), F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("fee") * 1e6 + 0.5).cast("long")).alias("fee_millionths"))
