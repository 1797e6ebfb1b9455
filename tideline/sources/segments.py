"""Segment files: one per coin, channel and hour of receipt, gzip members of records that state their length.

``<coin>/<channel>/<hour>.<opened>.jsonl.gz``, with ``.open`` behind it while it is being written. A record is receive
time, connection and length in bytes as decimal text, each with a tab behind it, then the message and a line feed, so a
message may hold line feeds of its own. A file holds any number of gzip members, each a whole number of records. A closed
file must be whole; of an open one the part up to the first unfinished member is read.

Files are listed, read and written by Spark through the Hadoop file system; many tiny files share a task, by size. Names
of coins that a path cannot hold are percent-encoded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import hour_floor
from tideline.operators.compaction import packed
from tideline.session import shared_path

SUFFIX, OPEN = ".jsonl.gz", ".open"
SCHEMA = "coin string, channel string, hour_ms long, opened_ms long, closed boolean, path string, record_no long, recv_ms long, conn_ms long, raw string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_PATH = re.compile(r"([^/]+)/([^/]+)/(-?\d+)\.(-?\d+)\.jsonl\.gz(\.open)?$")
#: Where connections and messages of no coin are kept.
EVENTS = ("_events", "events")


def encode(records: Iterable[tuple[int, int, bytes]]) -> bytes:
    """One gzip member."""
    body = b"".join(b"%d\t%d\t%d\t%b\n" % (recv, conn, len(raw), raw) for recv, conn, raw in records)
    packer = zlib.compressobj(wbits=31)
    return packer.compress(body) + packer.flush()


def members(data: bytes, tolerant: bool) -> Iterator[bytes]:
    """Contents of the members of a file. A damaged or unfinished one ends an open file and is an error in a closed one."""
    while data:
        unpacker = zlib.decompressobj(wbits=31)
        try:
            body = unpacker.decompress(data)
        except zlib.error as e:
            if tolerant:
                return
            raise ValueError(f"damaged segment: {e}") from e
        if not unpacker.eof:
            if tolerant:
                return
            raise ValueError("segment ends inside a member")
        yield body
        data = unpacker.unused_data


def decode(body: bytes) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while at < len(body):
        head = body[at : at + 80].split(b"\t", 3)  # three numbers of at most twenty digits
        if len(head) < 4:
            raise ValueError("record header cut off")
        recv, conn, n = (int(x) for x in head[:3])
        at += sum(len(x) + 1 for x in head[:3])
        if body[at + n : at + n + 1] != b"\n":
            raise ValueError("record without its end")
        yield recv, conn, body[at : at + n]
        at += n + 1


def whole_length(data: bytes) -> int:
    """Bytes up to the end of the last whole member: where a crashed writer's file may be cut and continued."""
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(wbits=31)
        try:
            unpacker.decompress(data[at:])
        except zlib.error:
            break
        if not unpacker.eof:
            break
        at = len(data) - len(unpacker.unused_data)
    return at


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and next(iter_files(fs, path), None) is not None


def iter_files(fs, path) -> Iterator:
    found = fs.listFiles(path, True)
    while found.hasNext():
        yield found.next()


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of all segment files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}*").load(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row per record of every segment below ``root``; ``path`` is relative to it."""
    if not _exists(spark, root):
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                m = _PATH.search(path)
                if m is None:
                    continue
                coin, channel, hour, opened, still = m.groups()
                no = 0
                for body in members(data, tolerant=still is not None):
                    rows = list(decode(body))
                    n = len(rows)
                    same = lambda v, t, n=n: pa.array([v] * n, t)
                    cols = [
                        same(unquote(coin), pa.string()), same(channel, pa.string()), same(int(hour), pa.int64()), same(int(opened), pa.int64()), same(still is None, pa.bool_()), same(m.group(), pa.string()),
                        pa.array(range(no, no + n), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode(errors="replace") for r in rows], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=_NAMES)
                    no += n

    with packed(spark):
        return files(spark, root).select("path", "content").mapInArrow(run, SCHEMA)


def write(records: DataFrame, root: str) -> list[str]:
    """Adds segments of ``records`` (coin, channel, recv_ms, conn_ms, raw): a closed file per coin, channel and hour of receipt.

    Written under a hidden name and renamed when all of it is there; returns the new paths. A file's ``opened`` is its
    first receive time; one that is there already is not replaced, so a delivery that is repeated adds nothing.
    """
    spark = records.sparkSession
    rows = records.where("coin is not null and channel is not null and recv_ms is not null").select(
        "coin", "channel", hour_floor("recv_ms").alias("hour_"), "recv_ms", F.concat_ws("\t", "recv_ms", F.coalesce("conn_ms", F.lit(0)), F.octet_length(F.coalesce("raw", F.lit(""))), F.coalesce("raw", F.lit(""))).alias("value")
    )
    first = rows.groupBy("coin", "channel", "hour_").agg(F.min("recv_ms").alias("opened_"))
    staged = shared_path(spark, "segments-staged")
    named = rows.join(first, ["coin", "channel", "hour_"]).repartition("coin", "channel", "hour_").sortWithinPartitions("coin", "channel", "hour_", "opened_", "recv_ms", "value")
    named.select("coin", "channel", "hour_", "opened_", "value").write.partitionBy("coin", "channel", "hour_", "opened_").option("compression", "gzip").text(staged)
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    target = Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in list(iter_files(target, Path(staged))):
        parts = dict(p.split("=", 1) for p in status.getPath().toString().split("/") if "=" in p)
        if "opened_" not in parts:
            continue
        path = f"{parts['coin']}/{parts['channel']}/{parts['hour_']}.{parts['opened_']}{SUFFIX}"
        goal = Path(f"{root.rstrip('/')}/{path}")
        target.mkdirs(goal.getParent())
        if not target.exists(goal) and target.rename(status.getPath(), goal):
            out.append(path)
    target.delete(Path(staged), True)
    return sorted(out)


def recover(spark: SparkSession, root: str) -> list[str]:
    """Closes what a lost writer left open: each such file is cut after its last whole member and renamed; one without any goes.

    A writer has one open file per coin and channel, and files of an hour are small, so they are gone through one by one.
    """
    if not _exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    left = files(spark, root).where(F.col("path").endswith(OPEN)).select("path", "content")
    for row in left.toLocalIterator():
        name = row.path
        whole = bytes(row.content)[: whole_length(bytes(row.content))]
        source, goal = jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(name[: -len(OPEN)])
        if whole:
            hidden = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}")
            stream = fs.create(hidden)
            stream.write(bytearray(whole))
            stream.close()
            fs.rename(hidden, goal)
            out.append(_PATH.search(name[: -len(OPEN)]).group())
        fs.delete(source, False)
    return sorted(out)


def delete(spark: SparkSession, root: str, paths: Iterable[str]) -> int:
    """Takes segments away; returns how many were there."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(bool(fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}"), False)) for p in paths)
