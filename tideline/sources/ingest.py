"""Documents of outside services to typed rows: account lists, instruments, fills in pages, funding hours, daily trade archives."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS, hour_floor
from tideline.operators.feeds import bars
from tideline.operators.ordered import as_of
from tideline.session import written
from tideline.sources.tables import SCHEMAS, schema

# -- JSON documents ------------------------------------------------------------------------------------------------------


def account_list(raw: DataFrame, body: str = "body") -> DataFrame:
    """address (lower case), account_value, valid, repeated: one row per entry of ``leaderboardRows``."""
    kind = "struct<leaderboardRows:array<struct<ethAddress:string, accountValue:string>>>"
    rows = raw.select(F.explode(F.from_json(F.col(body).cast("string"), kind)["leaderboardRows"]).alias("r"))
    rows = rows.select(F.lower("r.ethAddress").alias("address"), F.expr("try_cast(r.accountValue as double)").alias("account_value"))
    counts = rows.groupBy("address").agg(F.count(F.lit(1)).alias("n_"))
    valid = F.coalesce(F.col("address").rlike("^0x[0-9a-f]{40}$") & F.col("account_value").isNotNull(), F.lit(False))
    return rows.join(counts, "address", "left").select("address", "account_value", valid.alias("valid"), F.coalesce(F.col("n_") > 1, F.lit(False)).alias("repeated"))


def instruments(raw: DataFrame, body: str = "body") -> DataFrame:
    """coin, sz_decimals from ``universe``."""
    rows = raw.select(F.explode(F.from_json(F.col(body).cast("string"), "struct<universe:array<struct<name:string, szDecimals:bigint>>>")["universe"]).alias("r"))
    return rows.select(F.col("r.name").alias("coin"), F.col("r.szDecimals").alias("sz_decimals"))


def require(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself, if it has all of ``columns``."""
    if gone := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks the columns {gone}")
    return df


def instrument_kind(coin: Column, perps: Sequence[str] | Column) -> Column:
    """First rule first: a listed perpetual, a name with a colon, a pair or numbered spot token, an outcome token, other."""
    listed = perps if isinstance(perps, Column) else coin.isin(list(perps))
    return F.when(listed, "perp").when(coin.contains(":"), "hip3").when(coin.startswith("@") | coin.contains("/"), "spot").when(coin.startswith("#"), "outcome").otherwise("other")


_FILL_JSON = "struct<time:string, coin:string, px:string, sz:string, side:string, startPosition:string, dir:string, closedPnl:string, fee:string, crossed:string, tid:string, oid:string, twapId:string, liquidation:struct<liquidatedUser:string>>"


def fill_rows(pages: DataFrame, perps: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the fills table from address, raw (one JSON fill each) and the columns that order them.

    A field that cannot be read becomes null and the row stays; seq is the place in arrival order within the address.
    """
    num = lambda c: F.expr(f"try_cast(m.{c} as double)")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    positive = lambda c: F.when(c > 0, c)
    whole = lambda c: F.expr(f"try_cast(m.{c} as bigint)")
    rows = pages.withColumn("m", F.from_json("raw", _FILL_JSON)).withColumn("seq", (F.row_number().over(W.partitionBy("address").orderBy(*order)) - 1).cast("long"))
    cols = {
        "address": F.col("address"), "seq": F.col("seq"), "time_ms": positive(whole("time")), "coin": F.col("m.coin"), "kind": instrument_kind(F.col("m.coin"), perps), "px": positive(finite(num("px"))), "sz": positive(finite(num("sz"))),
        "side": F.col("m.side"), "start_position": finite(num("startPosition")), "dir": F.col("m.dir"), "crossed": F.expr("try_cast(m.crossed as boolean)"), "closed_pnl": finite(num("closedPnl")), "fee": finite(num("fee")),
        "tid": positive(whole("tid")), "oid": positive(whole("oid")), "twap_id": whole("twapId"), "liquidated_user": F.col("m.liquidation.liquidatedUser"),
    }
    return rows.select(*(cols[f.name].alias(f.name) for f in SCHEMAS["fills"].fields))


def collect_pages(fetch: Callable[[int, int], list[dict]], start_ms: int, end_ms: int, page_max: int, cap: int) -> tuple[list[dict], int, bool]:
    """Items of [start, end) from a service that answers at most ``page_max`` of them, oldest first: items, pages, capped.

    Each page starts at the instant where the last one ended, so items of that instant come again: they are taken off as
    often as the last page had them. More than ``cap`` items end the collection: it is ``capped``, and all that came so
    far is returned. A page out of order or outside what was asked for, and a full page that leads no further, are errors.
    """
    spelled = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    kept: list[dict] = []
    at, pages = start_ms, 0
    again: Counter[str] = Counter()
    while True:
        page = fetch(at, end_ms)
        pages += 1
        times = [x.get("time") for x in page]
        if not all(isinstance(t, int) and at <= t < end_ms for t in times):
            raise ValueError(f"an item outside [{at}, {end_ms})")
        if any(a > b for a, b in zip(times, times[1:])):
            raise ValueError("a page out of order")
        left, fresh = Counter(again), []
        for x, t in zip(page, times):
            if t == at and left[key := spelled(x)] > 0:
                left[key] -= 1
            else:
                fresh.append(x)
        kept += fresh
        if len(kept) > cap or len(page) < page_max:
            return kept, pages, len(kept) > cap
        if not fresh:
            raise ValueError("a full page of one instant leads no further")
        at = times[-1]
        again = Counter(spelled(x) for x, t in zip(page, times) if t == at)


def latest_coverage(coverage: DataFrame, window: Sequence[str], at: str = "ingested_at_ms") -> DataFrame:
    """Of the coverage rows recorded for a window, the one that stands: the last; of several at one instant the greatest."""
    row = F.struct(at, *(c for c in coverage.columns if c not in {at, *window}))
    return coverage.groupBy(*window).agg(F.max(row).alias("x")).select(*window, "x.*")


def uncovered(addresses: DataFrame, coverage: DataFrame, start_ms: int, end_ms: int, done: Sequence[str] = ("ok",)) -> DataFrame:
    """Addresses that still need fetching: without a finished coverage row of exactly this window."""
    have = coverage.where((F.col("start_ms") == start_ms) & (F.col("end_ms") == end_ms) & F.col("status").isin(list(done))).select("address")
    return addresses.join(have, "address", "left_anti")


def funding_hours(rows: DataFrame, start_ms: int, end_ms: int) -> tuple[DataFrame, DataFrame]:
    """Rates per coin and hour, and problems: coin, hour_ms, n with n = 0 (missing) or more than one."""
    hours = rows.withColumn("hour_ms", hour_floor("time_ms")).where((F.col("hour_ms") >= start_ms) & (F.col("hour_ms") < end_ms))
    counts = hours.groupBy("coin", "hour_ms").agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.select("coin").distinct().select("coin", F.explode(F.sequence(F.lit(start_ms), F.lit(end_ms - HOUR_MS), F.lit(HOUR_MS))).alias("hour_ms"))
    bad = wanted.join(counts, ["coin", "hour_ms"], "left").select("coin", "hour_ms", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("n != 1")
    return hours, bad


# -- daily archives --------------------------------------------------------------------------------------------------------

LINES = 50_000  # of an archive at a time
TRADE_CSV = schema("agg_trade_id:l price:d quantity:d first_trade_id:l last_trade_id:l transact_time:l is_buyer_maker:s")


def archive_symbol(coin: Column, exceptions: dict[str, str]) -> Column:
    """The archive's name of a coin: a listed one, else with a leading k as 1000, and the quote currency behind."""
    out = F.concat(F.regexp_replace(coin, "^k(?=.)", "1000"), F.lit("USDT"))
    for c, s in exceptions.items():
        out = F.when(coin == c, F.lit(s)).otherwise(out)
    return out


def trade_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Trades of CSV files, with or without a header line: a line whose first field is no number is none."""
    text = spark.read.schema(", ".join(f"{f.name} string" for f in TRADE_CSV.fields)).csv(paths)
    return text.select(*(F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) for f in TRADE_CSV.fields)).where("agg_trade_id is not null")


def archives(spark: SparkSession, paths: str | list[str], checksums: DataFrame) -> DataFrame:
    """path, ok and the trades of zipped CSV files; a file whose SHA-256 is not the listed one (path, sha256) has no trades."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("found"))
    files = files.join(checksums, "path", "left").withColumn("ok", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)))

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, ok in zip(b["path"], b["content"], b["ok"]):
                if not ok:
                    yield pd.DataFrame({"path": [path], "ok": [False], "line": [None]})
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:  # unpacked as it is read
                            text = io.TextIOWrapper(f, "utf-8")
                            while lines := [x.rstrip("\r\n") for x in islice(text, LINES)]:
                                yield pd.DataFrame({"path": path, "ok": True, "line": lines})

    rows = files.select("path", "content", "ok").mapInPandas(unzip, "path string, ok boolean, line string")
    parts = F.split("line", ",")
    cells = [F.try_element_at(parts, F.lit(i + 1)).alias(f.name) for i, f in enumerate(TRADE_CSV.fields)]
    typed = rows.select("path", "ok", *cells)
    return typed.select("path", "ok", *(F.expr(f"try_cast({f.name} as {f.dataType.simpleString()})").alias(f.name) for f in TRADE_CSV.fields)).where("agg_trade_id is not null or not ok")


def second_series(trades: DataFrame, day: int) -> DataFrame:
    """second, low, high, last, n_trades of one UTC day; trades of another day are an error."""
    bounds = trades.agg(F.min("transact_time").alias("a"), F.max("transact_time").alias("b")).first()
    if bounds.a is not None and not (day * DAY_MS <= bounds.a and bounds.b < (day + 1) * DAY_MS):
        raise ValueError("trades outside the file's day")
    return bars(trades.withColumn("k_", F.lit(0)), ["k_"], "transact_time", "price", ["agg_trade_id"]).select(F.col("slot").alias("second"), "low", "high", "last", "n_trades")


def store_archive(spark: SparkSession, path: str, sha256: str, store, coin: str, day: int) -> int:
    """A day's archive as prices per second in ``store``, the archive taken away once they are there; returns the seconds.

    A file whose digest is another, or with trades of another day, is an error and stays.
    """
    rows = archives(spark, path, spark.createDataFrame([(r.path, sha256) for r in spark.read.format("binaryFile").load(path).select("path").collect()], "path string, sha256 string"))
    rows = written(rows, "archive")
    if not rows.where("not ok").isEmpty():
        raise ValueError(f"{path} is not what was listed")
    bars_ = second_series(rows.where("ok"), day).select(F.lit(coin).alias("coin"), "second", "low", "high", "last", "n_trades")
    store.write("proxy", (coin, str(day)), bars_, (day * DAY_MS // 1000, (day + 1) * DAY_MS // 1000), "second")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False)
    return store.read("proxy", (coin, str(day))).count()


def tsv_recording(spark: SparkSession, path: str) -> DataFrame:
    """file, recv_ms, raw of recordings of one message per line, receive time and message with a tab between."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"))
    return lines.select("file", F.expr("try_cast(substring_index(value, '\t', 1) as bigint)").alias("recv_ms"), F.expr("substring(value, locate('\t', value) + 1)").alias("raw")).where("recv_ms is not null")


def without_snapshots(messages: DataFrame, connects: DataFrame, stream: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Messages without the first at or after each connect of their stream (``connects``: stream, at_ms), and those first ones."""
    first = as_of(connects, messages, list(stream), "at_ms", "recv_ms", [c for c in messages.columns if c not in stream], forward=True, prefix="m_")
    keys = first.where("m_recv_ms is not null").select(*stream, *(F.col(f"m_{o}").alias(o) for o in order)).distinct()
    live = messages.join(keys, [*stream, *order], "left_anti")
    return live, messages.join(keys, [*stream, *order], "left_semi")


def until_first_missing(days: DataFrame) -> DataFrame:
    """coin, day up to the first day that was not found."""
    missing = days.where("not found").groupBy("coin").agg(F.min("day").alias("stop_"))
    return days.join(missing, "coin", "left").where("stop_ is null or day < stop_").select("coin", "day")


def params_hash(params: dict) -> str:
    """SHA-256 of a parameter tree in one spelling: keys sorted, no spacing."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
