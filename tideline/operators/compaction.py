"""Many tiny segments into few well-filled files per coin, channel and UTC day, every record exactly once.

1. Equal records (same connection and receive time, same JSON value) of different segments of a coin and channel are
   one record: that of the first segment by (opened_ms, path) stays. Segments are numbered in that order, and first
   numbers come from an aggregate with map-side combine, so a value with any number of copies is no hot task.
2. Each kept record gets a Hilbert code over (receive time, event time), on a grid between the first and last receive
   time of its day. Exact byte histograms per code cut each day into ranges of equal size, one per file; inside the code
   in which a file ends, the order of receive and event times decides.
3. Cuts are few, one per file, so each message finds its file where it is read, moves once, and is written in code order.
4. The files are read back. Row count, sum and xor of row hashes per day must agree: source = files + dropped.
   Otherwise the call fails.

Segments listed twice count once; open segments count like closed ones; segments without records and records
without a segment make no output. Null keys and record numbers are values.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tideline.functions.hashing import row_hash
from tideline.functions.hilbert import grid, hilbert2
from tideline.functions.search import count_upto
from tideline.functions.timeops import utc_day
from tideline.operators.ordered import Runs, join_same
from tideline.session import shared_path, written
from tideline.sources.messages import canonical_json, event_time

GROUP = ["coin", "channel", "day"]
RECORD = ["path", "record_no", "recv_ms", "conn_ms", "raw"]
FILES_PER_TASK, TASK_BYTES = 64, 256 << 20  # what one task writes at most, by files and by bytes
BROADCAST_ROWS = 250_000  # of segments, repeats, or cuts; beyond it they are joined by shuffle
OPEN_COST = 1 << 16  # what opening a small file counts when files are packed into tasks
KEY = "struct<code: bigint, recv: bigint, event: bigint, h: bigint>"


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row per path. Closed wins over open where a path is listed as both."""
    return segments.where("path is not null").groupBy("path").agg(
        *(F.min(c).alias(c) for c in ("coin", "channel", "hour_ms", "opened_ms")), F.max(F.coalesce("closed", F.lit(False))).alias("closed")
    )


@contextmanager
def packed(spark: SparkSession) -> Iterator[None]:
    """Reads planned inside put many small files into one task."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_COST))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass
class Compaction:
    files: DataFrame  # what was written: GROUP, file_no where any day has several, hour_ms, path, record_no, recv_ms, conn_ms, raw
    dropped: DataFrame  # records that repeat one of an earlier segment: GROUP, hour_ms, path, record_no, row_hash
    digests: DataFrame  # per GROUP: source, written and dropped counts and hashes, files, their sizes and overlap, ok
    location: str


class SegmentCompactor:
    """Decisions are made on narrow rows of hashes, times and sizes; the messages themselves move once, at the end."""

    def __init__(self, segments: DataFrame, records: DataFrame, target_bytes: int = 128 << 20, bits: int = 10):
        """``bits`` of each axis: a day has 4 ** bits codes at most, the rows of its histogram."""
        self.target_bytes, self.bits = target_bytes, bits
        found = distinct_segments(segments).withColumn("day", utc_day("hour_ms")).withColumn("at", F.coalesce("opened_ms", F.lit(-(1 << 62))))
        numbered = Runs(found, ["coin", "channel"], "at", ["path"]).running(segment_no=F.lit(1).cast("long"))
        self.segments = small(written(numbered.select("path", *GROUP, "hour_ms", "segment_no"), "segments"))
        records = records.select(*RECORD).where("path is not null")
        self.records = records.withColumn("row_hash", row_hash(records, RECORD)).join(self.segments, "path")

    def keyed(self) -> DataFrame:
        """One narrow row per record: its segment's coin, channel, day, hour and number; value hashes; times; size."""
        equal = [F.col("conn_ms"), F.col("recv_ms"), canonical_json("raw")]
        parts = [p for c in equal for p in (c.isNull(), c)]
        stream = [F.coalesce("coin", F.lit("")), F.coalesce("channel", F.lit("")), F.col("coin").isNull(), F.col("channel").isNull()]
        return self.records.select(
            *GROUP, "hour_ms", "segment_no", "path", "record_no", "row_hash", F.xxhash64(*stream, *parts).alias("v1"), F.xxhash64(F.lit(1), *stream, *parts).alias("v2"),
            F.col("recv_ms").alias("recv"), self._event().alias("event"), (F.coalesce(F.octet_length("raw"), F.lit(0)) + 32).cast("long").alias("weight"),
        )

    @staticmethod
    def _event() -> Column:
        return F.coalesce(event_time("raw", "channel"), "recv_ms")

    def repeats(self, keyed: DataFrame) -> DataFrame:
        """Records equal to one of an earlier segment of the same coin and channel."""
        several = keyed.groupBy("v1", "v2").agg(F.min("segment_no").alias("first"), F.max("segment_no").alias("last")).where("first != last").drop("last")
        return keyed.join(small(written(several, "values")), ["v1", "v2"]).where("segment_no > first").select(*GROUP, "hour_ms", "path", "record_no", "row_hash")

    # -- which file ----------------------------------------------------------------------------------------------------

    def _code(self, recv: Column, event: Column) -> Column:
        at = lambda c: grid(c, F.col("low"), F.col("high") + 1, self.bits)
        return hilbert2(at(recv), at(event), self.bits)

    def bounds(self, kept: DataFrame) -> DataFrame:
        """GROUP, low, high (receive times), n_files, file_weight."""
        out = kept.groupBy(*GROUP).agg(F.min("recv").alias("low"), F.max("recv").alias("high"), F.sum("weight").alias("total"))
        n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / self.target_bytes))
        return out.withColumn("n_files", n).withColumn("file_weight", F.col("total") / F.col("n_files")).drop("total")

    def cuts(self, kept: DataFrame, bounds: DataFrame) -> DataFrame:
        """GROUP, cuts: for each day of several files, the least key of each file but the first, in order."""
        several = bounds.where("n_files > 1")
        rows = join_same(kept, several, GROUP).select(*GROUP, "recv", "event", "row_hash", "weight", "n_files", "file_weight", self._code(F.col("recv"), F.col("event")).alias("code"))
        rows = written(rows, "codes")
        day = W.partitionBy(*GROUP)
        codes = rows.groupBy(*GROUP, "n_files", "file_weight", "code").agg(F.sum("weight").alias("code_weight"))
        codes = codes.withColumn("below", F.sum("code_weight").over(day.orderBy("code").rowsBetween(W.unboundedPreceding, 0)) - F.col("code_weight"))
        of = lambda weight: F.least(F.floor(weight / F.col("file_weight")), F.col("n_files") - 1)
        codes = codes.withColumn("first", of(F.col("below"))).withColumn("last", of(F.col("below") + F.col("code_weight") - 1))
        least = F.lit(-(1 << 63)).cast("long")
        whole = codes.where("first = last").select(*GROUP, F.col("first").alias("file"), F.struct("code", least.alias("recv"), least.alias("event"), least.alias("h")).cast(KEY).alias("key"))
        split = codes.where("first != last").select(*GROUP, "code", "below")
        inside = join_same(rows, split, [*GROUP, "code"]).withColumn("at", F.coalesce("recv", F.lit(0)))
        inside = Runs(inside, [*GROUP, "code"], "at", ["event", "row_hash"], 1_000).running(upto=F.col("weight"))
        inside = inside.select(*GROUP, of(F.col("below") + F.col("upto") - F.col("weight")).alias("file"), F.struct("code", F.coalesce("recv", least).alias("recv"), F.coalesce("event", least).alias("event"), F.col("row_hash").alias("h")).cast(KEY).alias("key"))
        firsts = whole.unionByName(inside).groupBy(*GROUP, "file").agg(F.min("key").alias("key")).where("file > 0")
        return firsts.groupBy(*GROUP).agg(F.array_sort(F.collect_list("key")).alias("cuts"))

    def placed(self, rows: DataFrame, bounds: DataFrame, several: bool, kept: DataFrame) -> DataFrame:
        """``rows`` with code and file_no."""
        least = F.lit(-(1 << 63)).cast("long")
        if several:
            cut = self.cuts(kept, bounds)
            layout = written(join_same(bounds, cut, GROUP, "left").select(*GROUP, "low", "high", "cuts"), "layout")
        else:
            layout = written(bounds.select(*GROUP, "low", "high", F.lit(None).cast(f"array<{KEY}>").alias("cuts")), "layout")
        size = layout.agg(F.count(F.lit(1)) + F.sum(F.coalesce(F.size("cuts"), F.lit(0)))).first()[0] or 0
        layout = F.broadcast(layout) if size <= BROADCAST_ROWS else layout
        out = join_same(rows, layout, GROUP)
        out = out.withColumn("event_", self._event()).withColumn("code", self._code(F.col("recv_ms"), F.col("event_")))
        key = F.struct("code", F.coalesce("recv_ms", least).alias("recv"), F.coalesce("event_", least).alias("event"), F.col("row_hash").alias("h")).cast(KEY)
        file_no = F.when(F.col("cuts").isNull(), 0).otherwise(count_upto(F.col("cuts"), key)) if several else F.lit(0)
        return out.withColumn("file_no", file_no.cast("int")).drop("low", "high", "cuts")

    def run(self, location: str | None = None) -> Compaction:
        """Writes the files and checks them. Eager."""
        spark = self.records.sparkSession
        location = location or shared_path(spark, "compacted")
        keyed = written(self.keyed(), "record-keys")
        dropped = written(self.repeats(keyed), "repeats")
        gone = small(dropped.select("path", "row_hash").distinct()) if dropped.count() > BROADCAST_ROWS else F.broadcast(dropped.select("path", "row_hash"))
        kept = keyed.join(gone, ["path", "row_hash"], "left_anti")
        bounds = written(self.bounds(kept), "bounds")
        n_files, most, weight = bounds.agg(F.sum("n_files"), F.max("n_files"), F.sum(F.col("n_files") * F.col("file_weight"))).first()
        rows = self.records.join(gone, ["path", "row_hash"], "left_anti")
        levels = [*GROUP, *(["file_no"] if (most or 1) > 1 else [])]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((weight or 0) / TASK_BYTES), min((n_files or 0) // FILES_PER_TASK, 20_000))
        spread = F.pmod(F.xxhash64(*GROUP) + F.col("file_no"), F.lit(tasks)).cast("int")  # a day's files go to different tasks
        (
            self.placed(rows, bounds, (most or 1) > 1, kept)
            .select(*GROUP, "file_no", "code", "hour_ms", *RECORD, "event_")
            .repartitionById(tasks, spread)
            .sortWithinPartitions(*GROUP, "file_no", "code", "recv_ms", "event_", "path", "record_no")
            .select(*GROUP, "file_no", "hour_ms", *RECORD)
            .write.option("compression", "zstd")
            .partitionBy(*levels)
            .parquet(location)
        )
        kinds = {f.name: f for f in (*self.records.schema, StructField("file_no", LongType()))}
        files = spark.read.schema(StructType([kinds[n] for n in ("hour_ms", *RECORD, *levels)])).parquet(location)
        with packed(spark):
            digests = written(self._digests(keyed, files, dropped), "digests")
        bad = digests.where("not ok").limit(5).collect()
        if bad:
            raise RuntimeError(f"source and destination differ: {bad}")
        return Compaction(files, dropped, digests, location)

    def _digests(self, source: DataFrame, files: DataFrame, dropped: DataFrame) -> DataFrame:
        wide = F.col("h").cast("decimal(38,0)")
        none = F.lit(None).cast("long")
        part = lambda df, side, h, f, bytes_, recv: df.select(*GROUP, F.lit(side).alias("side"), f.cast("string").alias("f"), h.alias("h"), bytes_.alias("bytes"), recv.alias("recv"))
        rows = (
            part(source, "source", F.col("row_hash"), none, none, none)
            .unionByName(part(files, "written", row_hash(files, RECORD), F.input_file_name(), F.octet_length("raw").cast("long"), F.col("recv_ms")))
            .unionByName(part(dropped, "dropped", F.col("row_hash"), none, none, none))
        )
        per = rows.groupBy(*GROUP, "side", "f").agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("s"), F.bit_xor("h").alias("x"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.min("recv").alias("a"), F.max("recv").alias("z"))
        of = lambda s, x: F.when(F.col("side") == s, x)
        count = lambda s: F.coalesce(F.sum(of(s, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{s}")
        out = per.groupBy(*GROUP).agg(
            *(count(s) for s in ("source", "written", "dropped")),
            F.sum(F.when(F.col("side") == "source", F.col("s")).otherwise(-F.col("s"))).alias("sum_off"),
            F.bit_xor("x").alias("xor_off"),
            F.count("f").alias("n_files"),
            F.min(of("written", F.col("bytes"))).alias("least_bytes"),
            F.max(of("written", F.col("bytes"))).alias("most_bytes"),
            (F.sum(F.col("z") - F.col("a")) - (F.max("z") - F.min("a"))).alias("overlap_ms"),
        )
        return out.withColumn("overlap_ms", F.greatest("overlap_ms", F.lit(0))).withColumn("ok", F.expr("n_source = n_written + n_dropped and sum_off = 0 and xor_off = 0"))


def deleted_segments(segments: DataFrame) -> DataFrame:
    """day, n: distinct paths of closed segments per UTC day, what a day's report must state as deleted."""
    return distinct_segments(segments).where("closed").groupBy(utc_day("hour_ms").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def wrong_reports(segments: DataFrame, reports: DataFrame) -> DataFrame:
    """day: days of which some report states another number. A day without closed segments has none deleted."""
    stated = reports.where("day is not null and deleted_segments is not null").select("day", "deleted_segments").distinct()
    return stated.join(deleted_segments(segments), "day", "left").where("deleted_segments != coalesce(n, 0)").select("day").distinct()
