"""Market feeds: bars, messages to rows, gaps between messages, quotes weighted by time, coverage and delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, day_start, floor_div, utc_day
from tideline.operators.intervals import Intervals
from tideline.operators.ordered import Runs, as_of
from tideline.operators.stats import weighted_percentile
from tideline.session import written
from tideline.sources.tables import SCHEMAS


def bars(trades: DataFrame, keys: list[str], time: str, price: str, order: list[str], width_ms: int = 1_000) -> DataFrame:
    """keys, slot, low, high, last (by time, then ``order``), n_trades. Slots without trades have no bar."""
    rows = trades.where(F.col(time).isNotNull() & F.col(price).isNotNull())
    return rows.groupBy(*keys, floor_div(time, width_ms).alias("slot")).agg(
        F.min(price).alias("low"), F.max(price).alias("high"), F.max_by(price, F.struct(time, *order)).alias("last"), F.count(F.lit(1)).alias("n_trades")
    )


# -- messages ----------------------------------------------------------------------------------------------------------

_LEVEL = "struct<px:string, sz:string>"


def message_rows(records: DataFrame, channel: str) -> DataFrame:
    """Rows of the ``channel`` table from raw messages; unreadable ones, and those of another coin than ``coin``, make none."""
    num = lambda c: F.expr(f"try_cast({c} as double)")
    keep = ["coin", "recv_ms", "conn_ms"]
    if channel == "trades":
        item = "struct<coin:string, side:string, px:string, sz:string, time:bigint, tid:bigint, users:array<string>>"
        rows = _checked(records, f"struct<data:array<{item}>>").select(*keep, F.explode("m.data").alias("d"))
        return rows.where("d.coin <=> coin").select(
            "coin", F.col("d.time").alias("time_ms"), "recv_ms", "conn_ms", num("d.px").alias("px"), num("d.sz").alias("sz"), "d.side", F.get("d.users", F.lit(0)).alias("buyer"), F.get("d.users", F.lit(1)).alias("seller"), "d.tid"
        )
    if channel == "bbo":
        rows = _checked(records, f"struct<data:struct<coin:string, time:bigint, bbo:array<{_LEVEL}>>>").where("m.data.coin <=> coin").select(*keep, "m.data.*", F.col("coin").alias("c"))
        sides = [(s, w, f"bbo[{i}].{w}") for i, s in enumerate(("bid", "ask")) for w in ("px", "sz")]
        return rows.select(F.col("c").alias("coin"), F.col("time").alias("time_ms"), "recv_ms", "conn_ms", *(num(p).alias(f"{s}_{w}") for s, w, p in sides))
    if channel == "book":
        rows = _checked(records, f"struct<data:struct<coin:string, time:bigint, levels:array<array<{_LEVEL}>>>>").where("m.data.coin <=> coin")
        rows = rows.select(F.col("coin").alias("c"), "recv_ms", "conn_ms", F.col("m.data.time").alias("time_ms"), F.col("m.data.levels").alias("l"))
        out = {f"{s}_{w}_{k}": num(f"get(get(l, {i}), {k - 1}).{w}") for i, s in enumerate(("bid", "ask")) for k in range(1, 6) for w in ("px", "sz")}
        return rows.select(F.col("c").alias("coin"), "time_ms", "recv_ms", "conn_ms", *(out[f.name].alias(f.name) for f in SCHEMAS["book"].fields if f.name in out))
    raise ValueError(f"unknown channel {channel}")


def _checked(records: DataFrame, schema: str) -> DataFrame:
    """Only whole JSON, read by the schema."""
    return records.where(F.try_parse_json("raw").isNotNull()).withColumn("m", F.from_json("raw", schema)).where("m.data is not null")


def drop_first(records: DataFrame, stream: list[str], order: list[str]) -> DataFrame:
    """Messages without the first of each connection of a stream (a snapshot of what came before)."""
    head = records.groupBy(*(F.col(c).alias(f"h_{c}") for c in [*stream, "conn_ms"])).agg(F.min(F.struct(*order)).alias("h_first"))
    on = F.lit(True)
    for c in [*stream, "conn_ms"]:
        on &= F.col(c).eqNullSafe(F.col(f"h_{c}"))
    return records.join(head, on).where(F.struct(*order) > F.col("h_first")).select(*records.columns)


def message_gaps(points: DataFrame, key: str, order: list[str], max_silence_ms: int) -> DataFrame:
    """key, start_ms, end_ms, reason: where a message follows on another connection, or more than the limit later. In receive order."""
    rows = points.where(F.col("time_ms").isNotNull())
    seen = Runs(rows, [key], "recv_ms", order).previous(["time_ms", "conn_ms"])
    moved, silent = ~F.col("conn_ms").eqNullSafe(F.col("prev_conn_ms")), F.col("time_ms") - F.col("prev_time_ms") > max_silence_ms
    reason = F.when(moved, "disconnect").when(silent, "silence")
    return seen.where("has_prev").select(key, F.col("prev_time_ms").alias("start_ms"), F.col("time_ms").alias("end_ms"), reason.alias("reason")).where("reason is not null")


def open_silence(points: DataFrame, key: str, now_ms: int, max_silence_ms: int) -> DataFrame:
    """key, start_ms, end_ms, reason: keys whose newest message is older than the limit, until now."""
    newest = points.where(F.col("time_ms").isNotNull()).groupBy(key).agg(F.max_by("time_ms", F.struct("recv_ms", "time_ms")).alias("start_ms"))
    return newest.where(F.lit(now_ms) - F.col("start_ms") > max_silence_ms).select(key, "start_ms", F.lit(now_ms).cast("long").alias("end_ms"), F.lit("silence").alias("reason"))


def edge_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, first and last row (as structs) in the given order."""
    row, by = F.struct(*df.columns), F.struct(*order)
    return df.groupBy(key).agg(F.min_by(row, by).alias("first"), F.max_by(row, by).alias("last"))


# -- quotes ------------------------------------------------------------------------------------------------------------


def invalid_quote(bid: str = "bid_px", ask: str = "ask_px") -> Column:
    """True without a price, with one that is not positive or not finite, or with bid above ask. Never null."""
    b, a = F.col(bid), F.col(ask)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce((b <= 0) | (a <= 0) | (b > a) | ~finite(b) | ~finite(a), F.lit(True))


def gap_measure(instants: DataFrame, key: str, time: str, outages: DataFrame, out: str) -> DataFrame:
    """``instants`` with the total outage time of the key before each: whole outages and the part of the running one."""
    so_far = Runs(outages.withColumn("len_", F.col("end_ms") - F.col("start_ms")), ["key"], "start_ms", []).running(upto_=F.col("len_"))
    table = so_far.select(F.col("key").alias(key), "start_ms", "len_", (F.col("upto_") - F.col("len_")).alias("before_"))
    found = as_of(instants, table, [key], time, "start_ms", ["start_ms", "len_", "before_"], prefix="g_")
    inside = F.least(F.col(time) - F.col("g_start_ms"), F.col("g_len_"))
    return found.withColumn(out, F.coalesce(F.col("g_before_") + inside, F.lit(0)).cast("long")).drop("g_start_ms", "g_len_", "g_before_")


def half_spreads(quotes: DataFrame, gaps: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """coin, half_spread_bps, skipped: median half spread weighted by how long each quote stood, outages left out.

    A quote stands until the next one of its day or the day's end. Invalid quotes are counted and their time is nobody's.
    ``quotes``: coin, time_ms, ord, bid_px, ask_px; ``days``: coin, day to restrict to.
    """
    rows = quotes.where(F.col("time_ms").isNotNull()).withColumn("day", utc_day("time_ms"))
    if days is not None:
        rows = rows.join(days.select("coin", "day").distinct(), ["coin", "day"], "left_semi")
    following = F.lead("time_ms").over(W.partitionBy("coin", "day").orderBy("time_ms", "ord"))
    rows = rows.withColumn("until", F.coalesce(following, day_start("day") + DAY_MS))
    # a quote stands inside one day, so it meets the disjoint outages of its coin and day only
    pieces = Intervals(gaps, "coin", "start_ms", "end_ms").pieces.groupBy(F.col("key").alias("coin"), F.col("bucket").alias("day")).agg(F.collect_list(F.struct("s", "e")).alias("out_"))
    rows = rows.join(pieces, ["coin", "day"], "left")
    meet = lambda acc, x: acc + F.greatest(F.lit(0).cast("long"), F.least(x["e"], F.col("until")) - F.greatest(x["s"], F.col("time_ms")))
    rows = rows.withColumn("lost_", F.when(F.col("out_").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate("out_", F.lit(0).cast("long"), meet))).drop("out_")
    spread = (F.col("ask_px") - F.col("bid_px")) / (F.col("ask_px") + F.col("bid_px")) * 1e4
    rows = rows.withColumn("bad", invalid_quote()).withColumn("value", F.when(~F.col("bad"), spread)).withColumn("weight", F.col("until") - F.col("time_ms") - F.col("lost_"))
    rows = written(rows.select("coin", "bad", "value", "weight"), "spreads")
    found = weighted_percentile(rows.where("not bad"), ["coin"], "value", "weight", 50, "half_spread_bps")
    skipped = rows.groupBy("coin").agg(F.sum(F.col("bad").cast("long")).alias("skipped"))
    return skipped.join(found.select("coin", "half_spread_bps"), "coin")


# -- coverage ----------------------------------------------------------------------------------------------------------


def day_coverage(outages: Intervals, since: DataFrame, now_ms: int) -> DataFrame:
    """coin, day, gap_ms, unrecorded_ms, observed_ms, complete: each UTC day from ``since`` (coin, since_ms) until now."""
    days = since.where("since_ms is not null").select("coin", "since_ms", F.explode(F.sequence(utc_day("since_ms"), F.lit(now_ms // DAY_MS))).alias("day"))
    start, end = day_start("day"), day_start("day") + DAY_MS
    days = days.withColumn("complete", end <= now_ms).withColumn("observed_ms", F.least(end, F.lit(now_ms)) - start).where("observed_ms > 0")
    pieces = outages.pieces.select(F.col("key").alias("coin"), F.col("bucket").alias("day"), F.greatest(F.lit(0), F.least("e", F.lit(now_ms)) - F.col("s")).alias("ms"))
    total = pieces.groupBy("coin", "day").agg(F.sum("ms").alias("gap_ms"))
    return days.join(total, ["coin", "day"], "left").select(
        "coin", "day", F.coalesce("gap_ms", F.lit(0)).cast("long").alias("gap_ms"), F.greatest(F.lit(0), F.col("since_ms") - start).cast("long").alias("unrecorded_ms"), F.col("observed_ms").cast("long").alias("observed_ms"), "complete"
    )


def qualifying_days(coverage: DataFrame, min_pct: int, first: int) -> DataFrame:
    """coin, day: the first few complete days covered by at least min_pct percent, in integers."""
    covered = (F.col("observed_ms") - F.col("gap_ms") - F.col("unrecorded_ms")) * 100 >= F.col("observed_ms") * min_pct
    good = coverage.where(F.col("complete") & covered).select("coin", "day").distinct()
    return good.withColumn("k", F.row_number().over(W.partitionBy("coin").orderBy("day"))).where(F.col("k") <= first).drop("k")
