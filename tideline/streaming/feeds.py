"""Streams of market data: bars with a watermark, gaps by keyed state, late-aware hourly partials per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tideline.operators.daily import compact
from tideline.operators.lateness import LatePeriods
from tideline.session import shared_path
from tideline.sources import segments
from tideline.sources.store import Store

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder in the order of their arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bars(trades: DataFrame, lateness: str = "2 hours", width: str = "1 second") -> DataFrame:
    """coin, slot, low, high, last (by time and trade), n_trades; each bar appears once, when the watermark passes its end."""
    rows = trades.where("time_ms is not null and px is not null").withColumn("at", F.timestamp_millis("time_ms")).withWatermark("at", lateness)
    out = rows.groupBy("coin", F.window("at", width).alias("w")).agg(F.min("px").alias("low"), F.max("px").alias("high"), F.max_by("px", F.struct("time_ms", "tid", "px")).alias("last"), F.count(F.lit(1)).alias("n_trades"))
    return out.select("coin", F.call_function("div", F.unix_millis("w.start"), F.lit(1000)).alias("slot"), "low", "high", "last", "n_trades")


class GapFinder(StatefulProcessor):
    """Keeps each coin's last message; a message on another connection, or after too long, makes a gap."""

    def __init__(self, max_silence_ms: int):
        self.max_silence_ms = max_silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time_ms long, conn_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values(["recv_ms", "time_ms", "conn_ms"])
        before = self.last.get() if self.last.exists() else None
        times, conns = batch["time_ms"].to_numpy(), batch["conn_ms"].to_numpy()
        out = []
        t0, c0 = (before[0], before[1]) if before else (None, None)
        for t, c in zip(times.tolist(), conns.tolist()):
            if t0 is not None and (c != c0 or t - t0 > self.max_silence_ms):
                out.append((key[0], t0, t, "disconnect" if c != c0 else "silence"))
            t0, c0 = t, c
        self.last.update((t0, c0))
        if out:
            yield pd.DataFrame(out, columns=["coin", "start_ms", "end_ms", "reason"])

    def close(self) -> None:
        pass


def gaps(points: DataFrame, max_silence_ms: int) -> DataFrame:
    """coin, start_ms, end_ms, reason, as messages come. Needs the RocksDB state store."""
    rows = points.where("coin is not null and time_ms is not null").select("coin", "time_ms", "recv_ms", "conn_ms")
    return rows.groupBy("coin").transformWithStateInPandas(GapFinder(max_silence_ms), "coin string, start_ms long, end_ms long, reason string", "Append", "None")


class FirstDropper(StatefulProcessor):
    """Remembers the connections of a stream; the first message of each is left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "conn_ms long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values(["recv_ms", "opened_ms", "path", "record_no"], kind="stable")
        keep = []
        for c in batch["conn_ms"].tolist():
            known = self.seen.containsKey((c,))
            if not known:
                self.seen.updateValue((c,), (1,))
            keep.append(known)
        if any(keep):
            yield batch[keep]

    def close(self) -> None:
        pass


def first_dropped(records: DataFrame) -> DataFrame:
    """Messages (coin, channel, opened_ms, path, record_no, recv_ms, conn_ms, raw) without the first of each connection of a
    coin and channel, as they come, in order of receipt. Needs the RocksDB state store."""
    rows = records.where("coin is not null and channel is not null and conn_ms is not null").select("coin", "channel", "opened_ms", "path", "record_no", "recv_ms", "conn_ms", "raw")
    return rows.groupBy("coin", "channel").transformWithStateInPandas(FirstDropper(), rows.schema, "Append", "None")


def recorded(messages: DataFrame, root: str, checkpoint: str | None = None) -> StreamingQuery:
    """Writes messages (coin, channel, recv_ms, conn_ms, raw) as segments of an hour each; a micro-batch that is repeated adds nothing."""
    return (
        messages.writeStream.foreachBatch(lambda df, n: segments.write(df, root) and None)
        .option("checkpointLocation", checkpoint or shared_path(messages.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )


def close_days(spark: SparkSession, root: str, store: Store, today: int, max_silence_ms: int = 10_000) -> DataFrame:
    """Every day before ``today`` whose segments are all closed goes into ``store``, its segments away; returns the report."""
    records = segments.read(spark, root)
    listed = records.groupBy("path").agg(*(F.first(c).alias(c) for c in ("coin", "channel", "hour_ms", "opened_ms", "closed")))
    done = compact(store, records, listed, today, max_silence_ms)
    segments.delete(spark, root, [r.path for r in done.segments.select("path").toLocalIterator()])
    return done.report


def hourly_partials(events: DataFrame, late: LatePeriods, store: str, checkpoint: str | None = None) -> StreamingQuery:
    """Adds each micro-batch to the store of late-aware partials; deliveries must come in receive order."""
    spark = events.sparkSession
    return (
        events.writeStream.foreachBatch(lambda df, n: late.ingest(df.sparkSession, store, df, n) and None)
        .option("checkpointLocation", checkpoint or shared_path(spark, "stream"))
        .trigger(availableNow=True)
        .start()
    )


def drained(df: DataFrame, out: str, name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there into a Parquet folder, exactly once per checkpoint, and reads it."""
    spark = df.sparkSession
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
