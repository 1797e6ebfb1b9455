"""What changed between consecutive full deliveries of a table, by invertible Bloom lookup tables.

Every row of a delivery is a pair (key hash, content hash). Pairs are spread over hash buckets; a bucket of a delivery is
summarised by a small table of cells, each the count and the sums of the pairs that fall on it, made where the rows are
read. Subtracting two deliveries' cells leaves the pairs of which one has more, which are peeled off cell by cell: a cell
whose sums divide by its count, and whose check agrees, holds copies of one pair. A digest over the bucket proves the
result; a bucket that does not come out is built again with more cells, and one that never does is compared pair by pair.
What moves between executors is cells, never rows; keys are looked up at the end for the differing pairs only, against
the rows themselves, where mere numbers of copies fall away. A delivery whose stated digest is that of the one before it
is the same delivery and is not compared.

Repeated rows of a delivery count once. Rows with a null group or delivery time belong to no delivery and are left
out; null keys are values. A listed delivery without rows is an empty one. The first delivery of a group has no
predecessor, hence no changes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.hashing import row_hash
from tideline.session import written

#: Fixed values of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED, CHECK, DIGEST = 42, 101, 103  # Spark's seed; salts of ours
WAYS = 3
#: What a cell sums up: lower and upper halves of key hash, content hash and check, so that sums are exact.
HALVES = ("kl", "kh", "rl", "rh", "cl", "ch")
PEELED = "pair long, bucket long, kh long, ok boolean"
CHUNK_CELLS = 1 << 18
BROADCAST_ROWS = 250_000  # of deliveries, and of keys that are looked up; beyond it they are joined by shuffle


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def hash_long(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of 8-byte integers, as Spark's xxhash64 chains it over long columns."""
    x = x.astype(np.int64).view(np.uint64)
    seed = np.full(len(x), seed, np.uint64) if np.isscalar(seed) else seed
    with np.errstate(over="ignore"):
        h = seed + P5 + np.uint64(8)
        h = _rotl(h ^ (_rotl(x * P2, 31) * P1), 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def salted(kh: np.ndarray, rh: np.ndarray, salt: int) -> np.ndarray:
    return hash_long(np.full(len(kh), salt, np.int64), hash_long(rh, hash_long(kh, SEED))).view(np.int64)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low


def peel(c: pd.DataFrame, cells: int) -> pd.DataFrame:
    """Key hashes of all tables in ``c`` (pair, bucket, cell, n and HALVES), peeled together round by round.

    Cell -1 of a table is its digest. A table is ok if all its cells end empty and its pairs give its digest.
    """
    table = c.groupby(["pair", "bucket"], sort=False).ngroup().to_numpy()
    firsts = c.assign(t=table).drop_duplicates("t").sort_values("t")
    slot = table.astype(np.int64) * (cells + 1) + c["cell"].to_numpy() + 1
    order = np.argsort(slot, kind="stable")
    slots, at = slot[order], table[order]
    n = c["n"].to_numpy()[order].astype(np.int64)
    sums = [c[x].to_numpy()[order].astype(np.int64) for x in HALVES]
    is_digest = slots % (cells + 1) == 0
    third = cells // WAYS
    broken = np.zeros(len(firsts), bool)
    live = ~is_digest
    out: list[tuple[np.ndarray, ...]] = []

    def take(i: np.ndarray, m: np.ndarray, *hashes: np.ndarray) -> None:
        np.subtract.at(n, i, m)
        for j, h in enumerate(hashes):
            np.subtract.at(sums[2 * j], i, m * (h & 0xFFFFFFFF))
            np.subtract.at(sums[2 * j + 1], i, m * (h >> 32))

    for _ in range(4 * cells):
        i = np.flatnonzero(live & (n != 0))
        for x in sums:
            i = i[x[i] % n[i] == 0]
        m = n[i]
        one = [x[i] // m for x in sums]
        pure = np.ones(len(i), bool)
        for low, high in zip(one[::2], one[1::2]):
            pure &= (low >= 0) & (low < 1 << 32) & (high >= -(1 << 31)) & (high < 1 << 31)
        k, r, check = (_joined(low, high) for low, high in zip(one[::2], one[1::2]))
        pure &= salted(k, r, CHECK) == check
        if not pure.any():
            break
        got = pd.DataFrame({"t": at[i][pure], "k": k[pure], "r": r[pure], "m": m[pure]}).drop_duplicates(["t", "k", "r"])
        t, k, r, m = (got[x].to_numpy() for x in "tkrm")
        out.append((t, k, r, m))
        for j in range(WAYS):
            pos = t.astype(np.int64) * (cells + 1) + 1 + j * third + np.mod(salted(k, r, j), third)
            i = np.minimum(np.searchsorted(slots, pos), len(slots) - 1)
            there = slots[i] == pos
            broken[t[~there]] = True
            take(i[there], m[there], k[there], r[there], salted(k[there], r[there], CHECK))
        live &= ~broken[at]
    t, k, r, m = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 4))
    d = np.flatnonzero(is_digest)
    broken[np.setdiff1d(np.arange(len(broken)), at[d])] = True  # a digest that is empty although cells are not
    i = np.searchsorted(at[d], t)
    known = i < len(d)
    known[known] = at[d][i[known]] == t[known]
    zero = np.zeros(known.sum(), np.int64)
    take(d[i[known]], m[known], zero, zero, salted(k[known], r[known], DIGEST))
    left = n != 0
    for x in sums:
        left |= x != 0
    broken[at[left]] = True
    pairs = pd.DataFrame({"t": t, "kh": k, "ok": True})
    rows = pd.concat([pairs[~broken[t.astype(np.int64)]], pd.DataFrame({"t": np.flatnonzero(broken), "kh": np.int64(0), "ok": False})])
    names = firsts[["pair", "bucket"]].reset_index(drop=True).iloc[rows["t"].astype(np.int64)].reset_index(drop=True)
    return pd.concat([names, rows[["kh", "ok"]].reset_index(drop=True)], axis=1)


def _peel_stream(cells: int):
    """Tables arrive whole and in order within a task; chunks end where a table ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= CHUNK_CELLS:
                all_ = pd.concat(held, ignore_index=True)
                end = all_[["pair", "bucket"]].iloc[-1]
                tail = (all_["pair"] == end["pair"]) & (all_["bucket"] == end["bucket"])
                if (~tail).any():
                    yield peel(all_[~tail], cells)
                held, rows = [all_[tail]], int(tail.sum())
        if rows:
            yield peel(pd.concat(held, ignore_index=True), cells)

    return run


class SnapshotDiff:
    def __init__(self, df: DataFrame, group: str, at: str, keys: Sequence[str], deliveries: DataFrame | None = None, digest: str | None = None, bucket_keys: int = 1024, cells: int = 288, rounds: int = 4):
        """``deliveries``: further (group, at) that were delivered, possibly empty; ``digest``: their column that states what was delivered.

        ``cells`` must be a multiple of 3; a table of them gives back about 0.8 pairs a cell.
        """
        if cells % WAYS:
            raise ValueError(f"cells must be a multiple of {WAYS}")
        self.group, self.at, self.keys, self.cells, self.rounds = group, at, list(keys), cells, rounds
        content = sorted(c for c in df.columns if c not in {group, at, *keys})
        g, t = F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{at}`").cast("long").alias("at")
        hashed = df.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{at}`").isNotNull()).select(
            g, t, *(F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)), row_hash(df, keys).alias("kh"), row_hash(df, content).alias("rh")
        )
        listed = hashed.groupBy("g", "at").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"))
        if deliveries is not None:
            said = F.lit(None).cast("string") if digest is None else F.col(f"`{digest}`").cast("string")
            listed = listed.unionByName(deliveries.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{at}`").isNotNull()).select(g, t, F.lit(0).cast("long").alias("n"), said.alias("low"), said.alias("high")))
        listed = listed.groupBy("g", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        by_group, number = W.partitionBy("g").orderBy("at"), F.row_number().over(W.orderBy("g", "at")).cast("long")  # a row per delivery
        prev = lambda c: F.lag(c).over(by_group)
        listed = listed.withColumn("id", number).withColumn("prev_id", prev("id")).withColumn("same", F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == prev("low")) & (prev("low") == prev("high")), F.lit(False)))
        listed = listed.withColumn("plus", F.when(F.col("prev_id").isNotNull() & ~F.col("same"), F.col("id")))
        self.order = written(listed.withColumn("minus", F.lead("plus").over(by_group)).select("g", "at", "n", "id", "prev_id", "plus", "minus"), "deliveries")
        largest, count = self.order.agg(F.max("n"), F.count(F.lit(1))).first()
        self.buckets = max(1, -(-(largest or 1) // bucket_keys))
        compared = self.order.where("plus is not null or minus is not null").select("g", "at", "id", "plus", "minus")
        rows = hashed.join(F.broadcast(compared) if count <= BROADCAST_ROWS else compared, ["g", "at"])
        self.hashed = rows.drop("g", "at").withColumn("bucket", F.pmod(F.xxhash64("kh"), F.lit(self.buckets)))

    @staticmethod
    def _spots(cells: int) -> Column:
        """The cells a pair falls on, with what it adds to their sums; the digest is cell -1."""
        long = lambda v: F.lit(v).cast("long")
        mix = lambda salt: F.xxhash64("kh", "rh", long(salt))
        halves = lambda *hashes: [x for h, name in zip(hashes, "krc") for x in (h.bitwiseAND(long(0xFFFFFFFF)).alias(f"{name}l"), F.shiftright(h, 32).alias(f"{name}h"))]
        third = cells // WAYS
        spots = [F.struct((F.pmod(mix(j), long(third)) + j * third).alias("cell"), *halves(F.col("kh"), F.col("rh"), mix(CHECK))) for j in range(WAYS)]
        return F.explode(F.array(*spots, F.struct(long(-1).alias("cell"), *halves(long(0), long(0), mix(DIGEST)))))

    @staticmethod
    def _summed(rows: DataFrame, *by: str) -> DataFrame:
        """Signed sums per table and cell; only cells that are not empty."""
        made = rows.groupBy(*by, "bucket", "cell").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), *(F.sum(F.col("sign") * F.col(h)).alias(h) for h in HALVES))
        return made.where(" or ".join(f"{c} != 0" for c in ("n", *HALVES)))

    def delivered(self) -> DataFrame:
        """id, bucket, cell, n, HALVES: the tables of every delivery that is compared, summed up where its rows are read."""
        rows = self.hashed.select("id", "bucket", F.lit(1).alias("sign"), F.lit(1).cast("long").alias("n"), self._spots(self.cells).alias("x"))
        return self._summed(rows.select("id", "bucket", "sign", "n", "x.*"), "id")

    def subtracted(self) -> DataFrame:
        """pair, bucket, cell, n, HALVES: each compared delivery's tables less those of the one before it."""
        ends = self.order.select("id", F.explode(F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("pair"), F.lit(s).alias("sign"))) for c, s in (("plus", 1), ("minus", -1)))), lambda x: x.isNotNull())).alias("y"))
        return self._summed(self.delivered().join(ends.select("id", "y.*"), "id").repartition("pair", "bucket"), "pair")

    def again(self, failed: DataFrame) -> DataFrame:
        """pair, bucket, sign, kh, rh of the rows in tables that did not come out."""
        asked = failed.join(self.order.select(F.col("plus").alias("pair"), "prev_id"), "pair")
        sides = F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.lit(s).alias("sign")) for c, s in (("pair", 1), ("prev_id", -1)))))
        return self.hashed.select("id", "bucket", "kh", "rh").join(asked.select("pair", "bucket", sides.alias("y")).select("pair", "bucket", "y.*"), ["id", "bucket"])

    def differing(self) -> DataFrame:
        """pair, kh: keys that may differ between a delivery and the one before it, among them all that do. Eager: one pass per enlargement."""
        found, cells, tables = [], self.cells, self.subtracted()
        for _ in range(self.rounds):
            ordered = tables.sortWithinPartitions("pair", "bucket")
            got = written(ordered.mapInPandas(_peel_stream(cells), PEELED), "peeled")
            found.append(got.where("ok").select("pair", "kh"))
            failed = got.where("not ok").select("pair", "bucket").distinct()
            if failed.isEmpty():
                break
            todo, cells = self.again(failed), cells * 4
            rows = todo.select("pair", "bucket", "sign", F.lit(1).cast("long").alias("n"), self._spots(cells).alias("x")).select("pair", "bucket", "sign", "n", "x.*")
            tables = self._summed(rows, "pair").repartition("pair", "bucket")
        else:  # pair by pair
            rest = self.again(failed).groupBy("pair", "bucket", "kh", "rh").agg(F.sum("sign").alias("n")).where("n != 0")
            found.append(rest.select("pair", "kh"))
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct()

    def changes(self) -> DataFrame:
        """group, at, keys, change (added, removed, changed), one row per key and comparison."""
        keys = [f"key_{i}" for i in range(len(self.keys))]
        asked = self.differing().join(self.order.select(F.col("plus").alias("pair"), "g", "at", "prev_id"), "pair")
        sides = F.explode(F.array(F.struct(F.col("pair").alias("id"), F.lit(True).alias("new")), F.struct(F.col("prev_id").alias("id"), F.lit(False).alias("new"))))
        asked = written(asked.select("g", "at", "kh", sides.alias("x")).select("g", "at", "kh", "x.*"), "asked")
        looked = self.hashed.select("id", "kh", "rh", *keys).join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, ["id", "kh"])
        contents = lambda new: F.sort_array(F.collect_set(F.when(F.col("new") == new, F.col("rh"))))
        change = F.when(F.size("old_rows") == 0, "added").when(F.size("new_rows") == 0, "removed").otherwise("changed")
        return (
            looked.groupBy("g", "at", *keys)
            .agg(contents(False).alias("old_rows"), contents(True).alias("new_rows"))
            .where("old_rows != new_rows")  # copies, or two keys of one hash: only what differs stays
            .select(F.col("g").alias(self.group), F.col("at").alias(self.at), *(F.col(k).alias(n) for k, n in zip(keys, self.keys)), change.alias("change"))
        )
