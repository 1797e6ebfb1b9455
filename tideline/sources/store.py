"""A store of tables in partitions: listing, bounded reads, replacing an interval of a partition, logs that only grow.

A partition (an address, or a coin and day) is a folder ``table/column=value/...`` of versions, numbered from 1; the
newest version with a record of its intervals beside its data is the partition, so a version appears whole or not at
all. A version follows exactly one other: of two writers that start from the same one, the second is refused. Reads of
many partitions list folders and hand Spark the newest versions only, so partitions outside a request cost no reading.
All listing and renaming goes through the Hadoop file system of the root.

Partition values are never null. Rows outside the interval that a write declares are an error, as is another schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tideline.functions.timeops import DAY_MS
from tideline.operators.storage import LookaheadError, content_hashes, in_spans, intersect, multiset_difference, normalize, overlapping, replace_interval, window
from tideline.sources.tables import PARTITIONS, SCHEMAS

SPANS, LOCK, VERSION = "_spans.json", "_lock", "version_"
Span = tuple[int, int]
Partition = tuple[str, ...]


class MissingPartition(LookupError):
    """A partition or snapshot that was asked for is not there."""


class Conflict(RuntimeError):
    """Another writer got there first."""


@dataclass
class Outcome:
    """What a write did: the rows of frozen intervals that it kept against the new ones, and the new ones it refused."""

    kept: DataFrame
    refused: DataFrame

    def diverged(self) -> bool:
        return not (self.kept.isEmpty() and self.refused.isEmpty())


class Store:
    def __init__(self, spark: SparkSession, root: str, frozen: Sequence[Span] = (), partitions: dict[str, list[str]] | None = None, schemas: dict[str, StructType] | None = None):
        self.spark, self.root, self.frozen = spark, root.rstrip("/"), normalize(frozen)
        self.columns, self.schemas = partitions or PARTITIONS, schemas or SCHEMAS
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._names_as = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils  # as Spark spells values in paths
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- folders ---------------------------------------------------------------------------------------------------------

    def _names(self, path: str) -> list[str]:
        p = self._Path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _dir(self, table: str, partition: Partition) -> str:
        names = self.columns[table]
        if len(partition) != len(names):
            raise ValueError(f"{table} has the partition columns {names}")
        return "/".join([f"{self.root}/{table}", *(f"{n}={self._names_as.escapePathName(str(v))}" for n, v in zip(names, partition))])

    def _version(self, table: str, partition: Partition) -> int:
        """The newest version that is whole; 0 if there is none."""
        base = self._dir(table, partition)
        found = sorted((int(n.rpartition("=")[2]) for n in self._names(base) if n.startswith(f"{VERSION}=")), reverse=True)
        return next((v for v in found if self._fs.exists(self._Path(f"{base}/{VERSION}={v}/{SPANS}"))), 0)

    def _write_text(self, path: str, text: str) -> None:
        """Written under a hidden name and renamed, so it is there whole or not at all."""
        hidden = self._Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(hidden, self._Path(path)):
            self._fs.delete(hidden, False)
            raise Conflict(path)

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._Path(path))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    # -- what is there -----------------------------------------------------------------------------------------------------

    def partitions(self, table: str) -> list[Partition]:
        """All partitions that have a whole version, in order; hidden folders do not count."""
        level = [((), f"{self.root}/{table}")]
        for column in self.columns[table]:
            level = [((*values, self._names_as.unescapePathName(n[len(column) + 1 :])), f"{path}/{n}") for values, path in level for n in self._names(path) if n.startswith(f"{column}=")]
        return sorted(values for values, _ in level if self._version(table, values))

    def exists(self, table: str, partition: Partition) -> bool:
        return self._version(table, partition) > 0

    def disk_bytes(self, table: str) -> int:
        """Bytes of all that is kept of a table: older versions and files being written too."""
        p = self._Path(f"{self.root}/{table}")
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0

    def spans(self, table: str, partition: Partition) -> list[Span]:
        """The intervals written so far; none if the partition is not there."""
        v = self._version(table, partition)
        return [tuple(s) for s in json.loads(self._read_text(f"{self._dir(table, partition)}/{VERSION}={v}/{SPANS}"))] if v else []

    # -- reads -------------------------------------------------------------------------------------------------------------

    def _load(self, table: str, partitions: Sequence[Partition]) -> DataFrame:
        kind = self.schemas[table]
        paths = [f"{self._dir(table, p)}/{VERSION}={v}" for p in partitions if (v := self._version(table, p))]
        have = {f.name for f in kind.fields}
        more = [StructField(c, LongType()) for c in self.columns[table] if c not in have]
        if not paths:
            return self.spark.createDataFrame([], StructType([*kind.fields, *more]))
        full = StructType([*kind.fields, *more, StructField(VERSION, LongType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*have_order(kind, more))

    def read(self, table: str, partition: Partition, columns: Sequence[str] | None = None) -> DataFrame:
        """One partition, which must be there; only ``columns`` are read if they are given."""
        if not self.exists(table, partition):
            raise MissingPartition(f"{table} {partition}")
        df = self._load(table, [partition])
        return df if columns is None else df.select(*columns)

    def scan(self, table: str, where: Callable[[Partition], bool] = lambda _: True) -> DataFrame:
        """All partitions whose values meet a condition; none is no error."""
        return self._load(table, [p for p in self.partitions(table) if where(p)])

    # -- writes ------------------------------------------------------------------------------------------------------------

    def _publish(self, table: str, partition: Partition, base: int, spans: Sequence[Span], staged: str) -> None:
        """Makes the staged data the version after ``base``, unless another writer has."""
        folder = self._dir(table, partition)
        self._fs.mkdirs(self._Path(folder))
        if not self._fs.createNewFile(self._Path(f"{folder}/.after-{base}")):
            raise Conflict(f"{table} {partition}: another version follows {base}")
        target = f"{folder}/{VERSION}={base + 1}"
        self._fs.delete(self._Path(target), True)
        if not self._fs.rename(self._Path(staged), self._Path(target)):
            raise Conflict(f"{table} {partition}")
        self._write_text(f"{target}/{SPANS}", json.dumps([list(s) for s in spans]))

    def _stage(self, table: str, df: DataFrame, by: Sequence[str] = ()) -> str:
        staged = f"{self.root}/{table}/.staged-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        (writer.partitionBy(*by) if by else writer).parquet(staged)
        return staged

    def _plain(self, table: str, df: DataFrame) -> DataFrame:
        kind = self.schemas[table]
        want = {f.name: f.dataType.simpleString() for f in kind.fields}
        have = {c: k for c, k in df.dtypes if c in want or c not in self.columns[table]}
        if have != {c: k for c, k in want.items() if c in have or c not in self.columns[table]}:
            raise ValueError(f"schema differs from that of {table}: {have}")
        return df.select(*(c for c in want if c not in self.columns[table]))

    def write(self, table: str, partition: Partition, new: DataFrame, span: Span, instant: str | Column) -> Outcome:
        """Makes ``new`` the whole content of ``span`` in a partition. What is frozen and was written before stays as it is.

        Only this partition is rewritten.
        """
        new, when = self._plain(table, new), F.col(instant) if isinstance(instant, str) else instant
        within = lambda spans: F.coalesce(_any(when, spans), F.lit(False))
        if not new.where(~within([span])).isEmpty():
            raise ValueError("rows outside the declared interval")
        base, before = self._version(table, partition), self.spans(table, partition)
        stored = self._plain(table, self._load(table, [partition]))
        protected = intersect(intersect([span], self.frozen), before) if base else []
        inside, kept = within([span]), within(protected)
        staged = self._stage(table, stored.where(~inside | kept).unionByName(new.where(~kept)).sortWithinPartitions(when))
        self._publish(table, partition, base, normalize([*before, span]), staged)
        off = multiset_difference(stored.where(kept), new.where(kept))
        return Outcome(off.where("n_more > 0"), off.where("n_more < 0").withColumn("n_more", -F.col("n_more")))

    def write_all(self, table: str, new: DataFrame, span: Span, instant: str) -> list[Partition]:
        """The same for every partition that ``new`` has rows of, in one job; returns them. ``new`` has the partition columns.

        Only partitions with rows are touched. Each appears whole; the job's end is not one instant for all of them.
        """
        names = self.columns[table]
        if not new.where(~F.coalesce(in_spans(instant, [span]), F.lit(False))).isEmpty():
            raise ValueError("rows outside the declared interval")
        touched = sorted(tuple(str(v) for v in r) for r in new.select(*names).distinct().collect())  # a row per partition
        state = {p: (self._version(table, p), self.spans(table, p)) for p in touched}
        known = [p for p in touched if state[p][0]]
        rows = new
        if known:
            # partitions differ in what was written of them, and with it in what is protected
            kinds = {c: k for c, k in new.dtypes}
            parts = {}
            for p in known:
                parts.setdefault(tuple(intersect(intersect([span], self.frozen), state[p][1])), []).append(p)
            rows = None
            mine = lambda ps: F.struct(*(F.col(n).cast("string") for n in names)).isin([F.struct(*(F.lit(v) for v in p)) for p in ps])
            fresh = [p for p in touched if not state[p][0]]
            for protected, ps in [*parts.items(), ((), fresh)]:
                if ps:
                    stored = self._load(table, ps).select(*(F.col(c).cast(k) for c, k in kinds.items()))
                    made = replace_interval(stored, new.where(mine(ps)), instant, span, protected)
                    rows = made if rows is None else rows.unionByName(made)
        staged = self._stage(table, rows.sortWithinPartitions(*names, instant), names)
        for p in touched:
            base, before = state[p]
            self._publish(table, p, base, normalize([*before, span]), self._dir(table, p).replace(f"{self.root}/{table}", staged, 1))
        self._fs.delete(self._Path(staged), True)
        return touched

    def create(self, table: str, partition: Partition, df: DataFrame) -> None:
        """A partition that is written once and never again."""
        if self.exists(table, partition):
            raise Conflict(f"{table} {partition} exists already and is never overwritten")
        self._publish(table, partition, 0, [], self._stage(table, self._plain(table, df)))

    def append(self, table: str, partition: Partition, df: DataFrame) -> None:
        """Adds rows to a log. What is there is neither read nor written again, and frozen intervals do not matter."""
        df, base = self._plain(table, df), self._version(table, partition)
        if not base:
            self._publish(table, partition, 0, [], self._stage(table, df))
        else:
            df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self._dir(table, partition)}/{VERSION}={base}")

    # -- upkeep ------------------------------------------------------------------------------------------------------------

    @contextmanager
    def exclusive(self) -> Iterator[None]:
        """The only writer of the whole store while inside; a second one is refused at once."""
        path = self._Path(f"{self.root}/{LOCK}")
        self._fs.mkdirs(self._Path(self.root))
        if not self._fs.createNewFile(path):
            raise Conflict(f"{self.root} is locked")
        try:
            yield
        finally:
            self._fs.delete(path, False)

    def recover(self, table: str) -> int:
        """After a writer was lost: takes away what it had staged or half published; returns how much. Call it inside ``exclusive``."""
        gone = 0
        for n in self._names(f"{self.root}/{table}"):
            if n.startswith(".staged-"):
                gone += bool(self._fs.delete(self._Path(f"{self.root}/{table}/{n}"), True))
        level = [f"{self.root}/{table}"]
        for column in self.columns[table]:
            level = [f"{path}/{n}" for path in level for n in self._names(path) if n.startswith(f"{column}=")]
        for path in level:
            names = self._names(path)
            for n in names:
                if n.startswith(".after-") and not self._fs.exists(self._Path(f"{path}/{VERSION}={int(n[7:]) + 1}/{SPANS}")):
                    self._fs.delete(self._Path(f"{path}/{VERSION}={int(n[7:]) + 1}"), True)
                    gone += bool(self._fs.delete(self._Path(f"{path}/{n}"), False))
        return gone

    def vacuum(self, table: str, keep: int = 1) -> int:
        """Takes away versions older than the ``keep`` newest of each partition; returns how many."""
        gone = 0
        for p in self.partitions(table):
            newest, base = self._version(table, p), self._dir(table, p)
            for n in self._names(base):
                if n.startswith(f"{VERSION}=") and int(n.rpartition("=")[2]) <= newest - keep:
                    gone += bool(self._fs.delete(self._Path(f"{base}/{n}"), True))
        return gone


def have_order(kind: StructType, more: Sequence[StructField]) -> list[str]:
    return [*(f.name for f in kind.fields), *(f.name for f in more)]


def _any(when: Column, spans: Sequence[Span]) -> Column:
    out = F.lit(False)
    for a, b in spans:
        out |= (when >= a) & (when < b)
    return out


class Repository:
    """Reads of the store by entity and time. Each touches the partitions that can hold what is asked for, and no others.

    With ``cutoff_ms``, a read that asks for an instant at or after it is an error. A partition that is not there has no
    rows; a snapshot that is not there is an error.
    """

    SNAPSHOTS = ("leaderboard", "meta", "roles", "raw_leaderboard")

    def __init__(self, store: Store, cutoff_ms: int | None = None):
        self.store, self.cutoff_ms = store, cutoff_ms

    def _bounded(self, end_ms: int) -> None:
        if self.cutoff_ms is not None and end_ms > self.cutoff_ms:
            raise LookaheadError(f"read until {end_ms}, cut-off {self.cutoff_ms}")

    def _one(self, table: str, key: str) -> DataFrame:
        return self.store._load(table, [(key,)])

    def _days(self, table: str, coin: str, first: int, last: int) -> DataFrame:
        return self.store._load(table, [(coin, str(day)) for day in range(first, last + 1)])

    def _window(self, df: DataFrame, instant: str, start: int, end: int, *order: str) -> DataFrame:
        self._bounded(end)
        return window(df, instant, start, end).orderBy(*order) if order else window(df, instant, start, end)

    # -- by address
    def fills(self, address: str, start: int, end: int) -> DataFrame:
        return self._window(self._one("fills", address), "time_ms", start, end, "time_ms", "seq")

    def coverage(self, address: str, start: int, end: int) -> DataFrame:
        self._bounded(end)
        return overlapping(self._one("coverage", address), "start_ms", "end_ms", start, end).orderBy("start_ms")

    def divergences(self, address: str, start: int, end: int) -> DataFrame:
        return self._window(self._one("divergences", address), "time_ms", start, end)

    # -- by coin
    def funding(self, coin: str, start: int, end: int) -> DataFrame:
        return self._window(self._one("funding", coin), "hour_ms", start, end, "hour_ms")

    def proxy(self, coin: str, start: int, end: int) -> DataFrame:
        """Seconds that begin in [start, end), from the days around them."""
        days = self._days("proxy", coin, start // DAY_MS, (end - 1) // DAY_MS).withColumn("at_", F.col("second") * 1000)
        return self._window(days, "at_", start, end, "second").drop("at_")

    def proxy_days(self, coin: str, start: int, end: int) -> DataFrame:
        rows = self._one("proxy_days", coin).withColumn("at_", F.col("day") * DAY_MS)
        return self._window(rows, "at_", start, end, "day").drop("at_")

    def by_event_time(self, table: str, coin: str, start: int, end: int) -> DataFrame:
        """bbo, book or trades by event time: partitions are by receive day, so one more day is opened on either side."""
        return self._window(self._days(table, coin, start // DAY_MS - 1, (end - 1) // DAY_MS + 1), "time_ms", start, end, "time_ms", "recv_ms")

    def gaps(self, coin: str, start: int, end: int) -> DataFrame:
        self._bounded(end)
        return overlapping(self._one("gaps", coin), "start_ms", "end_ms", start, end).orderBy("start_ms", "end_ms")

    # -- snapshots
    def snapshots(self, table: str) -> list[int]:
        if table not in self.SNAPSHOTS and self.store.columns[table] != ["snapshot_ms"]:
            raise ValueError(f"{table} is no table of snapshots")
        return sorted(int(p[0]) for p in self.store.partitions(table))

    def snapshot(self, table: str, snapshot_ms: int) -> DataFrame:
        self._bounded(snapshot_ms + 1)
        return self.store.read(table, (str(snapshot_ms),))

    # -- hashes
    def content_hashes(self, table: str, keys: Sequence[str], instant: str, start: int, end: int) -> DataFrame:
        """partition columns, n, sha256 of the rows of every partition with their instant in [start, end)."""
        self._bounded(end)
        return content_hashes(window(self.store.scan(table), instant, start, end), self.store.columns[table], keys)
