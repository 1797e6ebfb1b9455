"""Ordered analytics over long runs: previous row, running totals and as-of look-ups that split every run by time.

A window over a whole run puts the run into one task. Here a run (the rows of some keys in some order) is cut into time
buckets; windows run inside a bucket, and one small row per bucket carries what the next buckets need. Only those small
rows are ordered along the whole run, so a key that holds a third of all rows is spread over its buckets.

Rows need a time; rows without one are left out. Null keys form a run of their own. The order must be total for the
result to be: give it enough columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS, floor_div, floor_to

BUCKET = "bucket_"
SHARE, LEAST_ROWS = 1 / 128, 20_000
UNCUT = 0  # the width of a bucket that holds a whole run
_WHOLE = {"whole_runs": True}  # what a bucket column says of itself then


def on_same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out &= left[a].eqNullSafe(right[b])
    return out


def join_same(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined by equal ``names``, null equal to null."""
    right = right.withColumnsRenamed({n: f"j_{n}" for n in names})
    return left.join(right, on_same(left, right, [(n, f"j_{n}") for n in names]), how).drop(*(f"j_{n}" for n in names))


def bucketed(df: DataFrame, keys: Sequence[str], time: str, bucket_ms: int) -> DataFrame:
    """``df`` placed by keys and time bucket, so that all later steps on the same runs find their rows where they need them.

    With ``UNCUT`` runs stay whole, and the column says so: nothing is carried from bucket to bucket then.
    """
    if bucket_ms == UNCUT:
        return df.repartition(*keys).withColumn(BUCKET, F.lit(0).cast("long").alias(BUCKET, metadata=_WHOLE))
    return df.withColumn(BUCKET, floor_to(time, bucket_ms)).repartition(*keys, BUCKET)


def split_ms(df: DataFrame, keys: Sequence[str], time: str, share: float = SHARE, least: int = LEAST_ROWS) -> int:
    """The bucket width at which no bucket of a run holds more than ``share`` of all rows, or ``least`` rows. Eager, over narrow rows.

    Follows from exact counts per run and day: as many days as the busiest day allows, an hour where a day is too much,
    and ``UNCUT`` where no run is that long, as each cut costs a row.
    """
    daily = df.where(F.col(time).isNotNull()).groupBy(*keys, floor_div(time, DAY_MS).alias("d_")).agg(F.count(F.lit(1)).alias("n_"))
    runs = daily.groupBy(*keys).agg(F.sum("n_").alias("n_"), F.max("n_").alias("top_"))
    total, longest, busiest = runs.agg(F.sum("n_"), F.max("n_"), F.max("top_")).first()
    room = max(least, int((total or 0) * share))
    if (longest or 0) <= room:
        return UNCUT
    return max(1, room // busiest) * DAY_MS if busiest <= room else HOUR_MS


class Runs:
    """``keys`` name a run, ``time`` and ``order`` its order. A frame that is ``bucketed`` keeps its buckets and its place.

    ``null_keys=False`` promises that keys are never null; joins then need no shuffle of their own.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], bucket_ms: int = DAY_MS, null_keys: bool = True):
        self.keys, self.order, self.null_keys = list(keys), [time, *(o for o in order if o != time)], null_keys
        self.kept = df.columns
        self.df = df.where(F.col(time).isNotNull())
        if BUCKET not in df.columns:
            cut = F.lit(0).cast("long").alias(BUCKET, metadata=_WHOLE) if bucket_ms == UNCUT else floor_to(time, bucket_ms)
            self.df = self.df.select("*", cut.alias(BUCKET) if bucket_ms != UNCUT else cut)
        self.uncut = bool(self.df.schema[BUCKET].metadata.get("whole_runs"))
        self.inside = W.partitionBy(*keys, BUCKET).orderBy(*self.order)
        self.along = W.partitionBy(*(f"c_{k}" for k in keys)).orderBy(f"c_{BUCKET}")

    def _carried(self, df: DataFrame, per_bucket: Sequence[Column], carried: Sequence[Column]) -> DataFrame:
        """``df`` with, on each row, ``carried``: columns over one row per bucket, along the run."""
        names = [*self.keys, BUCKET]
        edges = df.groupBy(*(F.col(k).alias(f"c_{k}") for k in names)).agg(*per_bucket).select(*(f"c_{k}" for k in names), *carried)
        if not self.null_keys:
            return df.join(edges.withColumnsRenamed({f"c_{k}": k for k in names}), names, "left")
        pairs = [(k, f"c_{k}") for k in names]
        return df.join(edges, on_same(df, edges, pairs), "left").drop(*(b for _, b in pairs))

    def previous(self, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
        """``df`` with the values of the run's previous row, and ``has_prev``."""
        return self.annotate(previous=columns, prefixes=(prefix, "next_"))

    def following(self, columns: Sequence[str], prefix: str = "next_") -> DataFrame:
        """``df`` with the values of the run's next row, and ``has_next``."""
        return self.annotate(following=columns, prefixes=("prev_", prefix))

    def running(self, **sums: Column) -> DataFrame:
        """``df`` with running sums up to and including each row."""
        return self.annotate(running=sums)

    def running_max(self, **tops: Column) -> DataFrame:
        """``df`` with running maxima up to and including each row; nulls do not count."""
        return self.annotate(highest=tops)

    def annotate(self, previous: Sequence[str] = (), following: Sequence[str] = (), running: dict[str, Column] | None = None, highest: dict[str, Column] | None = None, whole: dict[str, Column] | None = None, prefixes: tuple[str, str] = ("prev_", "next_")) -> DataFrame:
        """All of these in one pass: the rows below are read twice, once for the buckets' edges and once for the result.

        ``whole``: sums over the whole run.
        """
        sums, tops, alls, order = running or {}, highest or {}, whole or {}, F.struct(*self.order)
        before, upto = self.along.rowsBetween(W.unboundedPreceding, -1), self.inside.rowsBetween(W.unboundedPreceding, 0)
        edges, carried, out = [], [], list(self.kept)
        df = self.df.select("*", *(c.alias(f"x_{n}") for n, c in (sums | tops | alls).items()))
        near = {}
        if self.uncut:
            for columns, prefix, step in ((previous, prefixes[0], F.lag), (following, prefixes[1], F.lead)):
                if columns:
                    name = f"near_{prefix.rstrip('_')}_"
                    near[name] = step(F.struct(*columns)).over(self.inside)
                    out += [*(F.col(f"{name}.{c}").alias(f"{prefix}{c}") for c in columns), F.col(name).isNotNull().alias(f"has_{prefix.rstrip('_')}")]
            out += [F.coalesce(F.sum(f"x_{n}").over(upto), F.lit(0)).alias(n) for n in sums]
            out += [F.max(f"x_{n}").over(upto).alias(n) for n in tops]
            out += [F.sum(f"x_{n}").over(W.partitionBy(*self.keys, BUCKET)).alias(n) for n in alls]
            return (df.withColumns(near) if near else df).select(*out)
        for columns, prefix, edge, step in ((previous, prefixes[0], F.max_by, F.lag), (following, prefixes[1], F.min_by, F.lead)):
            if columns:
                row, name = F.struct(*columns), prefix.rstrip("_")
                edges.append(edge(row, order).alias(f"edge_{name}_"))
                carried.append(step(f"edge_{name}_").over(self.along).alias(f"far_{name}_"))
                near[f"near_{name}_"] = F.coalesce(step(row).over(self.inside), F.col(f"far_{name}_"))
                out += [*(F.col(f"near_{name}_.{c}").alias(f"{prefix}{c}") for c in columns), F.col(f"near_{name}_").isNotNull().alias(f"has_{name}")]
        for n in sums:
            edges.append(F.sum(f"x_{n}").alias(f"s_{n}"))
            carried.append(F.coalesce(F.sum(f"s_{n}").over(before), F.lit(0)).alias(f"b_{n}"))
            out.append((F.coalesce(F.sum(f"x_{n}").over(upto), F.lit(0)) + F.col(f"b_{n}")).alias(n))
        for n in tops:
            edges.append(F.max(f"x_{n}").alias(f"s_{n}"))
            carried.append(F.max(f"s_{n}").over(before).alias(f"b_{n}"))
            out.append(F.greatest(F.max(f"x_{n}").over(upto), F.col(f"b_{n}")).alias(n))
        for n in alls:
            edges.append(F.sum(f"x_{n}").alias(f"s_{n}"))
            carried.append(F.sum(f"s_{n}").over(W.partitionBy(*(f"c_{k}" for k in self.keys))).alias(f"b_{n}"))
            out.append(F.col(f"b_{n}").alias(n))
        return self._carried(df, edges, carried).withColumns(near).select(*out) if near else self._carried(df, edges, carried).select(*out)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    forward: bool = False,
    strict: bool = False,
    bucket_ms: int = DAY_MS,
    prefix: str = "r_",
) -> DataFrame:
    """``left`` with the values of the last right row at or before each row (``forward``: the first at or after it).

    ``strict`` leaves out equal times. Among right rows of one time the greatest (forward: least) values win, so the
    result is the same on every run. Left rows without partner keep nulls; those without time are left out. Keys are
    compared like values: null equals null.
    """
    reach = [c for c in left.columns]
    sign = -1 if forward else 1
    # in the direction of search: time, then which side comes first on a tie
    l = left.where(F.col(left_time).isNotNull()).select(*(F.col(f"`{k}`").alias(f"k_{i}") for i, k in enumerate(keys)), (sign * F.col(left_time)).cast("long").alias("t_"), F.struct(*(F.col(f"`{c}`") for c in reach)).alias("l_"), F.lit(0 if strict else 1).alias("side_"))  # noqa: E741
    packed = F.struct(F.col(right_time), *(F.col(f"`{v}`") for v in values if v != right_time))
    best = F.min if forward else F.max
    r = right.where(F.col(right_time).isNotNull()).groupBy(*(F.col(f"`{k}`").alias(f"k_{i}") for i, k in enumerate(keys)), (sign * F.col(right_time)).cast("long").alias("t_")).agg(best(packed).alias("r_"))
    r = r.withColumn("side_", F.lit(1 if strict else 0))
    ks = [f"k_{i}" for i in range(len(keys))]
    both = l.unionByName(r, allowMissingColumns=True).withColumn(BUCKET, floor_to("t_", bucket_ms))
    edges = both.groupBy(*(F.col(k).alias(f"c_{k}") for k in [*ks, BUCKET])).agg(F.max_by("r_", F.when(F.col("r_").isNotNull(), F.col("t_"))).alias("edge_"))
    before = W.partitionBy(*(f"c_{k}" for k in ks)).orderBy(f"c_{BUCKET}").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(*(f"c_{k}" for k in [*ks, BUCKET]), F.last("edge_", ignorenulls=True).over(before).alias("far_"))
    inside = W.partitionBy(*ks, BUCKET).orderBy("t_", "side_").rowsBetween(W.unboundedPreceding, 0)
    rows = both.join(edges, on_same(both, edges, [(k, f"c_{k}") for k in [*ks, BUCKET]]), "left")
    rows = rows.withColumn("near_", F.coalesce(F.last("r_", ignorenulls=True).over(inside), F.col("far_"))).where(F.col("l_").isNotNull())
    names = dict.fromkeys([right_time, *values])
    return rows.select(*(F.col(f"l_.`{c}`").alias(c) for c in reach), *(F.col(f"near_.`{v}`").alias(f"{prefix}{v}") for v in names))


def exists_between(left: DataFrame, right: DataFrame, keys: Sequence[str], low: str, high: str, time: str, out: str) -> DataFrame:
    """``left`` with whether a right row of the same keys has its time in [low, high]. Rows without bounds: false."""
    known = left.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    found = as_of(known, right, keys, low, time, [time], forward=True, prefix="at_").withColumn(out, F.coalesce(F.col(f"at_{time}") <= F.col(high), F.lit(False))).drop(f"at_{time}")
    return found.unionByName(left.where(F.col(low).isNull() | F.col(high).isNull()).withColumn(out, F.lit(False)))
