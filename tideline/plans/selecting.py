"""Choosing coins and accounts: proxy checks, the universe, facts of all accounts, filters F1 to F10 and their funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS
from tideline.operators import selection as sel
from tideline.operators.account import Measures
from tideline.operators.choosing import failed, funnel
from tideline.operators.feeds import invalid_quote
from tideline.plans.account import _LEVELS, _PNL, END, START, window
from tideline.plans.registry import Registry
from tideline.session import written
from tideline.sources.tables import read

query = Registry()
QUERIES, SQL = query.queries, query.sql

LIMITS = sel.Limits(account_value=20_000.0, max_fills=5_000, tolerance_bps=10_000.0, closed_episodes=1, active_blocks=1, shortest_ms=1_000.0, longest_ms=60.0 * DAY_MS, taker_pct=10.0, open_coins=60, universe_pct=1.0)
MAX_ASSETS, MIN_FILLS, DEVIATION_BPS, LEVEL_BPS = 24, 20, 12.0, 25.0
_CENTS = "CAST(floor(coalesce(abs(sz) * px, 0) * 100 + 0.5) AS BIGINT)"
_FILLS = "(SELECT DISTINCT address, seq, time_ms, coin, kind, px, sz, side, start_position, liquidated_user FROM fills WHERE address IS NOT NULL AND time_ms IS NOT NULL)"


def _fills(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fills").where("address is not null and time_ms is not null").select("address", "seq", "time_ms", "coin", "kind", "px", "sz", "side", "start_position", "liquidated_user").distinct()


# -- prices against the proxy ----------------------------------------------------------------------------------------------

_CHECK = f"""pl AS (SELECT coin, second, min(last) AS last FROM proxy WHERE last > 0 GROUP BY ALL), ff AS {_FILLS},
pf AS (SELECT ff.coin, time_ms // {DAY_MS} AS day, (px / pl.last - 1) * 1e4 AS bps FROM ff LEFT JOIN pl ON ff.coin = pl.coin AND time_ms // 1000 = pl.second WHERE ff.coin IS NOT NULL),
pm AS (SELECT coin, day, count(*) n, median(bps) m FROM pf WHERE bps IS NOT NULL GROUP BY ALL),
po AS (SELECT coin, count(*) n, list_sort(list(x))[greatest(1, (count(*) * 95 + 99) // 100)] q FROM (SELECT pf.coin, abs(bps - m) x FROM pf JOIN pm USING (coin, day) WHERE bps IS NOT NULL) GROUP BY coin),
pc AS (SELECT c.coin, c.compared, c.skipped, po.q deviation_bps, lv.level_bps, lv.shift_bps, coalesce(po.q <= {DEVIATION_BPS} AND lv.level_bps <= {LEVEL_BPS}, false) AS valid
 FROM (SELECT coin, count(bps)::BIGINT compared, count(CASE WHEN bps IS NULL THEN 1 END)::BIGINT skipped FROM pf GROUP BY coin) c LEFT JOIN po USING (coin)
 LEFT JOIN (SELECT coin, max(abs(m)) level_bps, max(m) - min(m) shift_bps FROM pm GROUP BY coin) lv USING (coin))"""


@query(f"WITH {_CHECK} SELECT coin, day, n::BIGINT n, round(m, 6) median_bps FROM pm")
def day_levels(spark: SparkSession, d: str) -> DataFrame:
    """Median distance of fills from the proxy, per coin and day, exactly."""
    return sel.day_levels(sel.compared(_fills(spark, d), read(spark, d, "proxy"))).withColumn("median_bps", F.round("median_bps", 6))


@query(f"WITH {_CHECK} SELECT coin, compared, skipped, round(deviation_bps, 6) deviation_bps, round(level_bps, 6) level_bps, round(shift_bps, 6) shift_bps, valid FROM pc")
def proxy_checks(spark: SparkSession, d: str) -> DataFrame:
    """How well the proxy stands for each coin's prices, and whether within both limits."""
    c = _checks(spark, d)
    return c.select("coin", "compared", "skipped", *(F.round(x, 6).alias(x) for x in ("deviation_bps", "level_bps", "shift_bps")), "valid")


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return sel.proxy_check(_fills(spark, d), read(spark, d, "proxy"), 95, DEVIATION_BPS, LEVEL_BPS)


# -- the universe ----------------------------------------------------------------------------------------------------------

# accounts whose last ingestion of the window ended well: here, all whose number of fills seven does not divide
_WALLETS = f"cv AS (SELECT address, count(*) n, max(seq) x FROM {_FILLS} GROUP BY address), ok AS (SELECT address FROM cv WHERE n % 7 <> 0)"
_ASSETS = f"""{_WALLETS}, pd AS (SELECT DISTINCT coin, second // 86400 AS day FROM proxy WHERE last > 0), dd AS (SELECT min(day) a, max(day) z FROM pd),
mm AS (SELECT * FROM ff WHERE address IN (SELECT address FROM ok)),
ca AS (SELECT coin, sum({_CENTS})::BIGINT cents, count(*)::BIGINT n_fills, coalesce((SELECT count(*) FROM pd WHERE pd.coin = mm.coin) = (SELECT z - a + 1 FROM dd), false) meets_i FROM mm WHERE kind = 'perp' AND coin IS NOT NULL GROUP BY coin),
co AS (SELECT DISTINCT coin FROM book WHERE bid_px_1 > 0 AND ask_px_1 > 0 AND bid_px_1 <= ask_px_1 AND isfinite(bid_px_1) AND isfinite(ask_px_1)),
rk AS (SELECT *, CASE WHEN meets_i THEN row_number() OVER (PARTITION BY meets_i ORDER BY cents DESC, coin) END::INTEGER place FROM ca),
un AS (SELECT rk.*, CASE WHEN NOT meets_i THEN 'i' WHEN place > {MAX_ASSETS} THEN 'ii' WHEN n_fills < {MIN_FILLS} THEN 'iii' WHEN NOT coalesce(pc.valid, false) THEN 'iv' WHEN co.coin IS NULL THEN 'v' END excluded_by
 FROM rk LEFT JOIN pc USING (coin) LEFT JOIN co USING (coin))"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """A coverage row per account for the window of the table."""
    start, end = window(spark, d)
    n = _fills(spark, d).groupBy("address").agg(F.count(F.lit(1)).alias("n_fills"))
    return n.select("address", F.lit(start).cast("long").alias("start_ms"), F.lit(end).cast("long").alias("end_ms"), F.lit(0).cast("long").alias("ingested_at_ms"), "n_fills", F.when(F.col("n_fills") % 7 == 0, "failed").otherwise("ok").alias("status"))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).where("status = 'ok'").select("address")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    days = sel.proxied_days(read(spark, d, "proxy"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    return sel.candidates(_fills(spark, d), _covered(spark, d), days, first or 0, last or 0)


def _universe(spark: SparkSession, d: str) -> DataFrame:
    costs = read(spark, d, "book").where(~invalid_quote("bid_px_1", "ask_px_1")).select("coin")
    return written(sel.form_universe(_assets(spark, d), _checks(spark, d), costs, MAX_ASSETS, MIN_FILLS), "universe")


@query(f"WITH {_CHECK}, {_ASSETS} SELECT coin, cents, n_fills, meets_i FROM ca")
def candidate_assets(spark: SparkSession, d: str) -> DataFrame:
    """Perpetuals in the fills of covered accounts, and whether each has prices on every day."""
    return _assets(spark, d)


@query(f"WITH {_CHECK}, {_ASSETS} SELECT coin, cents, n_fills, meets_i, place, excluded_by FROM un")
def universe(spark: SparkSession, d: str) -> DataFrame:
    """The universe: every candidate with the first condition it fails."""
    return _universe(spark, d)


@query(f"""WITH {_CHECK}, {_ASSETS}, ii AS (SELECT coalesce(sum(cents), 0)::BIGINT cents FROM un WHERE excluded_by IS NULL), aa AS (SELECT coalesce(sum({_CENTS}), 0)::BIGINT a, coalesce(sum(CASE WHEN kind = 'perp' THEN {_CENTS} ELSE 0 END), 0)::BIGINT p FROM mm)
SELECT cents, a all_cents, p perp_cents, CASE WHEN a > 0 THEN cents / a END of_all, CASE WHEN p > 0 THEN cents / p END of_perps FROM ii, aa""")
def universe_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of all notional, and of perpetuals, the universe covers."""
    return sel.universe_cover(_universe(spark, d), _fills(spark, d), _covered(spark, d))


@query(f"""WITH {_CHECK}, {_ASSETS}, w AS (SELECT *, coalesce(sum(CASE WHEN meets_i THEN 1 ELSE 0 END) OVER (ORDER BY cents DESC, coin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT met_before FROM ca)
SELECT coin, cents, n_fills, meets_i, met_before FROM w WHERE met_before < 5 OR coin IN ('NUBUME')""")
def market_walk(spark: SparkSession, d: str) -> DataFrame:
    """Coins visited in order of notional until five of them have prices on every day, and one that always is."""
    return sel.market_walk(_assets(spark, d), 5, ["NUBUME"])


# -- facts of accounts -----------------------------------------------------------------------------------------------------


def facts_sql(inside: str) -> str:
    """CTEs up to ``fx``, the facts of every account; ``inside``: a condition on coin."""
    return f"""{_PNL}, df AS {_FILLS}, wz AS (SELECT {START} a, {END} z),
fb AS (SELECT address, count(*)::BIGINT n_fills, sum(coalesce(abs(sz) * px, 0)) notional, sum(CASE WHEN kind = 'perp' THEN coalesce(abs(sz) * px, 0) ELSE 0 END) perp_notional, count(CASE WHEN lower(liquidated_user) = lower(address) THEN 1 END)::BIGINT liquidated_fills,
 sum(CASE WHEN {inside} THEN coalesce(abs(sz) * px, 0) ELSE 0 END) un,
 count(CASE WHEN kind IN ('perp', 'hip3') AND (px IS NULL OR sz IS NULL OR side IS NULL OR start_position IS NULL OR side NOT IN ('A', 'B')) THEN 1 END)::BIGINT n_ignored,
 count(CASE WHEN kind = 'perp' AND (px IS NULL OR sz IS NULL OR side IS NULL OR start_position IS NULL OR side NOT IN ('A', 'B')) THEN 1 END)::BIGINT invalid_perp_fills FROM df GROUP BY address),
bk AS (SELECT address, count(*)::BIGINT n_breaks FROM s WHERE broke AND {inside} GROUP BY address),
px AS (SELECT ep.*, opened_from_flat AND closed IS NOT NULL whole, bps FROM ep LEFT JOIN checked USING (address, coin, episode) WHERE {inside}),
rn AS (SELECT address, count(CASE WHEN whole THEN 1 END)::BIGINT closed_episodes, CASE WHEN sum(CASE WHEN opened_from_flat THEN op END) > 0 THEN sum(CASE WHEN opened_from_flat THEN tk END) / sum(CASE WHEN opened_from_flat THEN op END) END taker_share,
 count(DISTINCT CASE WHEN opened_from_flat THEN ((SELECT z FROM wz) - 1 - opened) // {7 * DAY_MS} END)::BIGINT active_blocks, max(CASE WHEN whole THEN bps END) max_divergence_bps, count(CASE WHEN bps > 10 THEN 1 END)::BIGINT n_violations,
 count(CASE WHEN whole AND bps IS NULL THEN 1 END)::BIGINT unreconciled_episodes, median(CASE WHEN whole THEN closed - opened END) median_duration_ms FROM px GROUP BY address),
ov AS (SELECT address, coin, time_ms AS t, arg_min(bf, seq) pp, arg_max(af, seq) po FROM s GROUP BY ALL), od AS (SELECT *, lag(po) OVER w pr, row_number() OVER w rn FROM ov WINDOW w AS (PARTITION BY address, coin ORDER BY t)),
ch AS (SELECT address, {START} t, CASE WHEN pp <> 0 THEN 1 ELSE 0 END delta FROM od WHERE rn = 1 UNION ALL SELECT address, t, CASE WHEN po <> 0 THEN 1 ELSE 0 END - CASE WHEN CASE WHEN rn = 1 THEN pp ELSE pr END <> 0 THEN 1 ELSE 0 END FROM od),
{_LEVELS}, mo AS (SELECT address, min(lv)::BIGINT median_open FROM k WHERE cum * 100 >= tot * 50 GROUP BY address),
fx AS (SELECT fb.address, n_fills, round(notional, 4) notional, round(perp_notional, 4) perp_notional, liquidated_fills, n_ignored, invalid_perp_fills, CASE WHEN notional > 0 THEN round(un / notional, 9) END universe_share,
 coalesce(n_breaks, 0)::BIGINT n_breaks, coalesce(closed_episodes, 0)::BIGINT closed_episodes, round(taker_share, 9) taker_share, coalesce(active_blocks, 0)::BIGINT active_blocks, round(max_divergence_bps, 6) max_divergence_bps,
 coalesce(n_violations, 0)::BIGINT n_violations, coalesce(unreconciled_episodes, 0)::BIGINT unreconciled_episodes, median_duration_ms, median_open FROM fb LEFT JOIN bk USING (address) LEFT JOIN rn USING (address) LEFT JOIN mo USING (address))"""


_ROUND = {"notional": 4, "perp_notional": 4, "universe_share": 9, "taker_share": 9, "max_divergence_bps": 6}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, _ROUND[c]).alias(c) if c in _ROUND else F.col(c) for c in df.columns))


@query(f"WITH {facts_sql('true')} SELECT * FROM fx")
def account_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures of all accounts in one table, over all days that have fills and all coins."""
    return rounded(Measures(read(spark, d, "fills").where("address is not null"), *window(spark, d)).facts())


_INSIDE = "coin IN (SELECT coin FROM un WHERE excluded_by IS NULL)"
_KNOWN = "(CASE WHEN n_fills % 7 <> 0 THEN true ELSE false END)"


def _facts(spark: SparkSession, d: str) -> tuple[Measures, DataFrame]:
    """Facts inside the universe, with account values and roles as a made-up listing has them."""
    coins = _universe(spark, d).where("excluded_by is null").select("coin")
    listing = _fills(spark, d).groupBy("address").agg((F.count(F.lit(1)) * 2_000.0).alias("account_value"), F.when(F.max("seq") % 5 == 0, "vault").otherwise("user").alias("role"))
    m = Measures(read(spark, d, "fills").where("address is not null"), *window(spark, d), universe=coins)
    return m, written(m.facts(accounts=listing, coverage=_coverage(spark, d)), "facts")


_SELECT = f"""WITH {_CHECK}, {_ASSETS}, {facts_sql(_INSIDE)}, fy AS (SELECT fx.*, n_fills * 2000.0::DOUBLE account_value, CASE WHEN cv.x % 5 = 0 THEN 'vault' ELSE 'user' END AS role, n_fills % 7 <> 0 coverage_ok FROM fx JOIN cv USING (address))"""


@query(f"{_SELECT} SELECT * FROM fy")
def universe_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts that the filters ask for: inside the universe, with coverage, account value and role."""
    return rounded(_facts(spark, d)[1])


_L = LIMITS
_CONDITIONS = {
    "F2": f"account_value >= {_L.account_value}", "F3": f"coverage_ok AND n_fills <= {_L.max_fills} AND invalid_perp_fills = 0 AND n_breaks = 0 AND unreconciled_episodes = 0 AND coalesce(max_divergence_bps, 0) <= {_L.tolerance_bps}",
    "F4": f"closed_episodes >= {_L.closed_episodes}", "F5": f"active_blocks >= {_L.active_blocks}", "F6": f"median_duration_ms BETWEEN {_L.shortest_ms} AND {_L.longest_ms}", "F7": f"taker_share * 100 >= {_L.taker_pct}",
    "F8": f"median_open <= {_L.open_coins}", "F9": f"universe_share * 100 >= {_L.universe_pct}", "F10": f"liquidated_fills <= {_L.liquidated_fills}", "F1": f"role = '{_L.role}'",
}


@query(f"{_SELECT} SELECT address, array_to_string(list_filter([{', '.join(f'''CASE WHEN NOT coalesce({c}, false) THEN '{n}' END''' for n, c in _CONDITIONS.items())}], lambda x: x IS NOT NULL), ' ') failed FROM fy")
def failed_filters(spark: SparkSession, d: str) -> DataFrame:
    """Every filter that each account fails, in order."""
    return _facts(spark, d)[1].select("address", F.concat_ws(" ", failed(sel.filters(LIMITS))).alias("failed"))


_EXPOSED = f"""ev AS (SELECT address, coin, time_ms AS t, seq, floor(abs(bf) * px * 100 + 0.5)::BIGINT fr, floor(abs(af) * px * 100 + 0.5)::BIGINT too FROM s WHERE {_INSIDE}),
ed AS (SELECT *, lag(too) OVER w pr, row_number() OVER w rn FROM ev WINDOW w AS (PARTITION BY address, coin ORDER BY t, seq)),
eh AS (SELECT address, {START} t, fr delta FROM ed WHERE rn = 1 UNION ALL SELECT address, t, too - CASE WHEN rn = 1 THEN fr ELSE pr END FROM ed),
{_LEVELS.replace('c AS', 'c2 AS').replace('FROM ch', 'FROM eh').replace('l AS', 'l2 AS').replace('FROM c)', 'FROM c2)').replace('h AS', 'h2 AS').replace('FROM l ', 'FROM l2 ').replace('k AS', 'k2 AS').replace('FROM h)', 'FROM h2)').replace('FROM c),', 'FROM c2),')},
ex AS (SELECT address, min(lv) exposure FROM k2 WHERE cum * 100 >= tot * 95 GROUP BY address)"""
_STAGES = [*_CONDITIONS.items(), ("N*", "exposure > 0")]


@query(
    f"{_SELECT}, {_EXPOSED}, sf AS (SELECT CASE "
    + " ".join(f"WHEN NOT coalesce({c}, false) THEN {i}" for i, (_, c) in enumerate(_STAGES))
    + f" ELSE {len(_STAGES)} END k FROM fy LEFT JOIN ex USING (address)), g AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, (n, _) in enumerate(_STAGES))}) v(stage_no, stage))"
    + " SELECT g.stage_no::INTEGER stage_no, g.stage, (SELECT count(*) FROM sf WHERE k >= g.stage_no)::BIGINT entered, (SELECT count(*) FROM sf WHERE k = g.stage_no)::BIGINT removed FROM g"
)
def eligibility_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Accounts entering and leaving at each filter, in order, and at the reference exposure after them."""
    m, facts = _facts(spark, d)
    rows = facts.join(m.exposure(), "address", "left")
    return funnel(rows, [*sel.filters(LIMITS), sel.reference_stage()])
