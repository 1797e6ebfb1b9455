"""Closed UTC days of raw segments into typed tables, gaps and a report per day, then the segments away.

A day is due when it is over and has closed segments but none that is still open. Of every stream the first message of
each connection goes (it repeats what came before), but for the connection whose rows are stored already, which simply
goes on. Rows are stored by coin and day of receipt, replacing what an earlier run of the same day stored. Gaps follow from
the book's messages in order of receipt, carried over from the last one stored. Rows are read back and counted, and
only if every stream has as many as its messages make are the segments given up for deletion.

Unreadable messages and messages of another coin make no rows and are counted; a day with any keeps its segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, utc_day
from tideline.operators.feeds import drop_first, message_gaps, message_rows
from tideline.operators.ordered import join_same
from tideline.session import written

CHANNELS = ("bbo", "book", "trades")
STREAM = ["coin", "channel"]
ORDER = ["recv_ms", "opened_ms", "path", "record_no"]


def due_days(segments: DataFrame, today: int) -> DataFrame:
    """day: days before ``today`` with closed segments of a channel that has a table, and none open."""
    s = segments.where(F.col("channel").isin(*CHANNELS)).groupBy(utc_day("hour_ms").alias("day")).agg(F.bool_and("closed").alias("all_"))
    return s.where("all_").where(F.col("day") < today).select("day")


@dataclass
class Days:
    rows: dict[str, DataFrame]  # per channel, with the day of receipt
    gaps: DataFrame  # coin, start_ms, end_ms, reason, day
    report: DataFrame  # day, messages, dropped_first, unreadable, n_rows, n_gaps, segments, whole
    segments: DataFrame  # day, path: what may be deleted


def convert(records: DataFrame, due: DataFrame, live: DataFrame | None = None, last_book: DataFrame | None = None, max_silence_ms: int = 10_000) -> Days:
    """``records``: coin, channel, hour_ms, opened_ms, path, record_no, recv_ms, conn_ms, raw. ``due``: day.

    ``live``: coin, channel, conn_ms of the last rows stored. ``last_book``: coin, time_ms, recv_ms, conn_ms likewise.
    """
    mine = records.where(F.col("channel").isin(*CHANNELS) & F.col("coin").isNotNull()).withColumn("day", utc_day("hour_ms")).join(due, "day")
    mine = written(mine, "due-records")
    if live is not None:
        # the connection that goes on has had its first message before
        mine_live = join_same(mine, live.select(*STREAM, "conn_ms").distinct().withColumn("live_", F.lit(True)), [*STREAM, "conn_ms"], "left")
        going, fresh = mine_live.where("live_").drop("live_"), mine_live.where("live_ is null").drop("live_")
        kept = drop_first(fresh, STREAM, ORDER).unionByName(going.select(*fresh.columns))
    else:
        kept = drop_first(mine, STREAM, ORDER)
    kept = written(kept, "kept-records")
    rows = {c: written(message_rows(kept.where(F.col("channel") == c), c).withColumn("day", utc_day("recv_ms")), f"{c}-rows") for c in CHANNELS}
    points = rows["book"].select("coin", "time_ms", "recv_ms", "conn_ms", F.lit(True).alias("new_"))
    if last_book is not None:
        points = points.unionByName(last_book.select("coin", "time_ms", "recv_ms", "conn_ms", F.lit(False).alias("new_")))
    gaps = message_gaps(points.drop("new_"), "coin", ["time_ms", "conn_ms"], max_silence_ms)
    gaps = gaps.distinct().withColumn("day", utc_day("end_ms"))
    n = F.count(F.lit(1))
    readable = kept.where(F.try_parse_json("raw").isNotNull())
    of = lambda df, name: df.groupBy("day").agg(n.alias(name))
    all_rows = None
    for c in CHANNELS:
        part = rows[c].select("day")
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    single = rows["bbo"].select("day").unionByName(rows["book"].select("day"))
    report = due.join(of(mine, "messages"), "day", "left").join(of(kept, "kept_"), "day", "left").join(of(readable, "readable_"), "day", "left").join(of(all_rows, "n_rows"), "day", "left").join(of(gaps, "n_gaps"), "day", "left")
    report = report.join(of(single, "single_"), "day", "left").join(of(kept.where("channel != 'trades'"), "want_"), "day", "left").join(mine.groupBy("day").agg(F.countDistinct("path").alias("segments")), "day", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    unreadable = zero("kept_") - zero("readable_")
    report = written(report.select("day", zero("messages").alias("messages"), (zero("messages") - zero("kept_")).alias("dropped_first"), unreadable.alias("unreadable"), zero("n_rows").alias("n_rows"), zero("n_gaps").alias("n_gaps"), zero("segments").alias("segments"), ((unreadable == 0) & (zero("single_") == zero("want_"))).alias("whole")), "day-report")
    return Days(rows, gaps, report, mine.join(report.where("whole").select("day"), "day").select("day", "path").distinct())


def compact(store, records: DataFrame, segments: DataFrame, today: int, max_silence_ms: int = 10_000) -> Days:
    """Converts every due day into ``store``, reads back and counts; what it returns as segments may be deleted. Eager."""
    due = written(due_days(segments, today), "due-days")
    first, last = due.agg(F.min("day"), F.max("day")).first()
    span = ((first or 0) * DAY_MS, ((last or 0) + 1) * DAY_MS)
    live = book = None
    for c in CHANNELS:
        stored = store.scan(c, lambda p: int(p[1]) < (first or 0))
        newest = stored.groupBy("coin").agg(F.max_by(F.struct("time_ms", "recv_ms", "conn_ms"), F.struct("recv_ms", "time_ms")).alias("x")).select("coin", F.lit(c).alias("channel"), "x.*")
        newest = written(newest, f"last-{c}")
        live = newest if live is None else live.unionByName(newest)
        book = newest if c == "book" else book
    done = convert(records, due, live, book, max_silence_ms)
    days = {r.day for r in due.collect()}  # a row per day
    for c in CHANNELS:
        inside = done.rows[c].where((F.col("recv_ms") >= span[0]) & (F.col("recv_ms") < span[1]))
        store.write_all(c, inside, span, "recv_ms")
        back = store.scan(c, lambda p: int(p[1]) in days).groupBy("coin", "day").agg(F.count(F.lit(1)).alias("n"))
        want = inside.groupBy("coin", "day").agg(F.count(F.lit(1)).alias("want"))
        off = join_same(want, back, ["coin", "day"], "left").where("n is null or n != want").limit(3).collect()
        if off:
            raise RuntimeError(f"{c}: rows written and read back differ: {off}")
    everything = (-(1 << 62), 1 << 62)
    old = store.scan("gaps").select("coin", "start_ms", "end_ms", "reason")
    both = written(old.unionByName(done.gaps.select(*old.columns)).distinct(), "all-gaps")
    store.write_all("gaps", both, everything, "start_ms")
    return done
