"""Tables in time: bounded reads, replacing an interval, differences with multiplicity, field-level change logs, content hashes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.hashing import canonical
from tideline.functions.timeops import DAY_MS


class LookaheadError(ValueError):
    """A read asks for more than its cut-off allows."""


class Bounded:
    """Reads that never see an instant at or after ``cutoff_ms``; a wider request is an error, not a shorter answer."""

    def __init__(self, cutoff_ms: int):
        self.cutoff_ms = cutoff_ms

    def window(self, df: DataFrame, instant: str, start_ms: int, end_ms: int) -> DataFrame:
        if end_ms > self.cutoff_ms:
            raise LookaheadError(f"read until {end_ms}, cut-off {self.cutoff_ms}")
        return window(df, instant, start_ms, end_ms)

    def view(self, df: DataFrame, instant: str) -> DataFrame:
        return df.where(F.col(instant) < self.cutoff_ms)


class Cursor:
    """Time that only moves on, and views that hold what is known ``delay_ms`` after it happened, never more."""

    def __init__(self, start_ms: int, delay_ms: int = 0):
        self.now_ms, self.delay_ms, self.closed = start_ms, delay_ms, False

    def advance(self, to_ms: int) -> None:
        if self.closed or to_ms < self.now_ms:
            raise LookaheadError(f"from {self.now_ms} to {to_ms}, closed: {self.closed}")
        self.now_ms = to_ms

    def view(self, df: DataFrame, instant: str) -> DataFrame:
        """Rows of instants up to now less the delay."""
        return df.where(F.col(instant) <= self.now_ms - self.delay_ms)

    def close(self) -> None:
        self.closed = True


def window(df: DataFrame, instant: str, start_ms: int, end_ms: int) -> DataFrame:
    """Rows with start <= instant < end."""
    return df.where((F.col(instant) >= start_ms) & (F.col(instant) < end_ms))


def overlapping(df: DataFrame, start: str, end: str, low_ms: int, high_ms: int) -> DataFrame:
    """Intervals [start, end) that meet [low, high)."""
    return df.where((F.col(start) < high_ms) & (F.col(end) > low_ms))


def event_window(df: DataFrame, day: str, instant: str, start_ms: int, end_ms: int, slack_days: int = 1) -> DataFrame:
    """Rows by event time from a table partitioned by receive day: prunes to the days around, then filters exactly."""
    first, last = start_ms // DAY_MS - slack_days, (end_ms - 1) // DAY_MS + slack_days
    return window(df.where(F.col(day).between(first, last)), instant, start_ms, end_ms)


def in_spans(instant: str, spans: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in spans:
        out |= (F.col(instant) >= a) & (F.col(instant) < b)
    return out


# -- differences ---------------------------------------------------------------------------------------------------------


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both, and ``n_more``: how many more copies of a row left has (positive) or right has (negative).

    NaN equals NaN, -0.0 equals 0.0, null equals null; a row comes out as the side that has more of it stores it, with
    -0.0 where any of its copies has it. One aggregate, with map-side combine, for both directions.
    """
    cols, doubles = left.columns, [c for c, k in left.dtypes if k in ("double", "float")]
    below_zero = lambda c: F.when(F.col(f"`{c}`") == 0, F.col(f"`{c}`").cast("string") == "-0.0")
    flat = lambda df, n: df.select(*(canonical(df, c).alias(c) for c in cols), F.lit(n).alias("n_"), F.array(*(F.coalesce(below_zero(c), F.lit(False)) for c in doubles)).alias("minus_"))
    of = lambda n: [F.bool_or(F.when(F.col("n_") == n, F.get("minus_", F.lit(i)))).alias(f"minus_{n}_{i}") for i in range(len(doubles))]
    out = flat(left, 1).unionByName(flat(right, -1)).groupBy(*cols).agg(F.sum("n_").alias("n_more"), *of(1), *of(-1)).where("n_more != 0")
    sign = lambda i: F.when(F.col("n_more") > 0, F.col(f"minus_1_{i}")).otherwise(F.col(f"minus_-1_{i}"))
    stored = {c: F.when(sign(i), F.lit(-0.0)).otherwise(F.col(f"`{c}`")) for i, c in enumerate(doubles)}
    return out.select(*(stored.get(c, F.col(f"`{c}`")).alias(c) for c in cols), "n_more")


def copies(diff: DataFrame, positive: bool) -> DataFrame:
    """The rows of one direction of ``multiset_difference``, each as often as it is missing."""
    n = F.col("n_more") if positive else -F.col("n_more")
    return diff.where(n > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("n_more", "copy_")


def change_log(old: DataFrame, new: DataFrame, pair: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """pair columns, field, old, new: one row per field that differs between two versions of a table.

    Rows that both have are set aside. The rest are paired by ``pair`` and place among equals; rows without a partner
    are ``row_removed`` or ``row_added``, with the whole row as text.
    """
    cols = [c for c in old.columns if c not in skip]
    diff = multiset_difference(old.select(*cols), new.select(*cols))
    order = W.partitionBy(*pair).orderBy(*(F.col(c).asc_nulls_last() for c in cols if c not in pair))
    side = lambda p, tag: copies(diff, p).withColumn("k_", F.row_number().over(order)).select(*(F.col(c).alias(f"{tag}_{c}") for c in [*cols, "k_"]))
    o, n = side(True, "o"), side(False, "n")
    on = F.col("o_k_") == F.col("n_k_")
    for c in pair:
        on &= F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    both = o.join(n, on, "full_outer")
    text = lambda tag: F.to_json(F.struct(*(F.col(f"{tag}_{c}").alias(c) for c in sorted(cols))))
    field = lambda f, a, b: F.struct(F.lit(f).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))
    none = F.lit(None)
    changed = [F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), field(c, F.col(f"o_{c}"), F.col(f"n_{c}"))) for c in cols if c not in pair]
    removed, added = F.array(field("row_removed", text("o"), none)), F.array(field("row_added", none, text("n")))
    found = F.when(F.col("n_k_").isNull(), removed).when(F.col("o_k_").isNull(), added).otherwise(F.filter(F.array(*changed), lambda x: x.isNotNull()))
    keys = [F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in pair]
    return both.select(*keys, F.explode(found).alias("x")).select(*pair, "x.*")


# -- writes --------------------------------------------------------------------------------------------------------------


def replace_interval(stored: DataFrame, new: DataFrame, instant: str, span: tuple[int, int], protected: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """The table after ``new`` becomes its content in ``span``. Rows in a protected part of the span stay as stored."""
    inside, kept = in_spans(instant, [span]), in_spans(instant, [(max(a, span[0]), min(b, span[1])) for a, b in protected if max(a, span[0]) < min(b, span[1])])
    return stored.where(~inside | kept).unionByName(new.where(inside & ~kept))


def add_only(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with rows of new keys added, and the rows of ``new`` that would change what is there. Equal rows are neither."""
    added = existing.unionByName(new.join(existing.select(key), key, "left_anti"))
    clashes = multiset_difference(new.join(existing.select(key).distinct(), key, "left_semi"), existing).where("n_more > 0").drop("n_more")
    return added, clashes


def normalize(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals, touching ones joined. For the few intervals of one table's bookkeeping."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def intersect(left: Sequence[tuple[int, int]], right: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    return normalize([(max(a, c), min(b, d)) for a, b in left for c, d in right if max(a, c) < min(b, d)])


# -- hashes --------------------------------------------------------------------------------------------------------------


def table_digest(df: DataFrame) -> DataFrame:
    """n, sum and xor of row hashes: equal for equal multisets of rows, in any order and partitioning."""
    from tideline.functions.hashing import row_hash

    h = row_hash(df, sorted(df.columns))
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


MAGIC = b"table-1"
_KINDS = {"tinyint": "i", "smallint": "i", "int": "i", "bigint": "i", "float": "f", "double": "f", "boolean": "b", "string": "s", "binary": "y"}


def _encoded(kind: str, column: pa.Array) -> tuple[bytes, bytes]:
    """Validity, a byte per row, and the values: 8 little-endian bytes for numbers, a byte for booleans, length and bytes for text."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    valid = known.astype(np.uint8).tobytes()
    if kind == "i":
        return valid, column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    if kind == "f":
        x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 is 0.0
        x[np.isnan(x)] = np.nan
        return valid, x.tobytes()
    if kind == "b":
        return valid, column.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    cells = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    return valid, b"".join(struct.pack("<Q", len(c)) + c for c in cells)


def content_sha256(rows: pa.Table, kinds: dict[str, str], keys: Sequence[str], magic: bytes = MAGIC) -> str:
    """SHA-256 of the rows in canonical order, whatever order they come in: by ``keys``, then all other columns, nulls last.

    Column by column in name order: name, kind, validity, values. ``kinds``: i (integer), f (double), b (boolean), s (text),
    y (bytes). -0.0 equals 0.0, all NaNs are one, and null is neither. For one partition's worth of rows.
    """
    flat = pa.table({c: pc.add(rows[c].cast(pa.float64()), 0.0) if kinds[c] == "f" else rows[c] for c in kinds})
    order = [*keys, *sorted(set(kinds) - set(keys))]
    at = pc.sort_indices(flat, sort_keys=[(c, "ascending") for c in order], null_placement="at_end")
    digest = hashlib.sha256(magic + struct.pack("<QQ", len(rows), len(kinds)))
    for name in sorted(kinds):
        column = flat[name].take(at).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        head = name.encode()
        digest.update(struct.pack("<Q", len(head)) + head + kinds[name].encode() + b"".join(_encoded(kinds[name], column)))
    return digest.hexdigest()


def content_hashes(df: DataFrame, partition: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """partition columns, n, sha256: the content hash of every partition, each made in one task over its rows as Arrow.

    A partition is what is stored and replaced as a whole, one address or one coin and day; its size is bounded by that.
    """
    kinds = {c: _KINDS[k] for c, k in df.dtypes if c not in partition}
    named = dict(df.dtypes)

    def run(rows: pa.Table) -> pa.Table:
        first = {p: rows[p].slice(0, 1) for p in partition}
        return pa.table(first | {"n": pa.array([rows.num_rows], pa.int64()), "sha256": pa.array([content_sha256(rows, kinds, keys)])})

    return df.groupBy(*partition).applyInArrow(run, ", ".join([*(f"`{p}` {named[p]}" for p in partition), "n long", "sha256 string"]))
