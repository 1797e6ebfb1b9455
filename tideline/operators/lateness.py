"""Aggregates per period of event time, corrected by what arrives late, with a cut-off.

Partial aggregates are kept per (stream, period, arrival batch). They merge by sums, minima and maxima, so any
number of batches combines on read. A period is *overtaken* for a row as soon as an earlier received row (strictly
smaller receive time) has an event at or after the period's end, and *closed* once such an event lies more than
the cut-off beyond the end. Both instants follow from the partials alone: they are minima of receive times over later
periods. Thus no stream is ever sorted by arrival as a whole, however large its share of the rows.

Rows without event or receive time are left out; repeated rows count like any row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.timeops import HOUR_MS, floor_to
from tideline.operators.ordered import join_same
from tideline.session import written

ON_TIME, CORRECTED, DROPPED = "on_time", "corrected", "dropped"


class LatePeriods:
    """``keys`` name a stream; ``event`` and ``recv`` are milliseconds; ``values`` are summed per period.

    ``cutoff_ms`` must be a multiple of ``period_ms``.
    """

    def __init__(self, keys: Sequence[str], event: str, recv: str, values: Sequence[str] = (), period_ms: int = HOUR_MS, cutoff_ms: int = 2 * HOUR_MS, batch_ms: int = HOUR_MS):
        if cutoff_ms % period_ms:
            raise ValueError("the cut-off must be whole periods")
        self.keys, self.event, self.recv, self.values = list(keys), event, recv, list(values)
        self.period_ms, self.cutoff_ms, self.batch_ms = period_ms, cutoff_ms, batch_ms

    def rows(self, df: DataFrame) -> DataFrame:
        out = df.select(
            *self.keys, F.col(self.event).cast("long").alias("event_ms"), F.col(self.recv).cast("long").alias("recv_ms"), *(F.col(v).cast("double").alias(f"v_{v}") for v in self.values)
        ).where("event_ms is not null and recv_ms is not null")
        return out.withColumn("period_ms", floor_to("event_ms", self.period_ms)).withColumn("batch_ms", floor_to("recv_ms", self.batch_ms))

    def _sums(self) -> list:
        return [F.count(F.lit(1)).alias("n"), *(F.sum(f"v_{v}").alias(f"sum_{v}") for v in self.values)]

    def arrivals(self, rows: DataFrame) -> DataFrame:
        """What the close instants need of a batch: the first receive time per period, of all rows and of those after its start."""
        after = F.when(F.col("event_ms") > F.col("period_ms"), F.col("recv_ms"))
        return rows.groupBy(*self.keys, "period_ms", "batch_ms").agg(F.min("recv_ms").alias("first_recv"), F.min(after).alias("first_after"))

    def closing(self, arrivals: DataFrame) -> DataFrame:
        """keys, period_ms, overtaken_at, closed_at: rows received strictly later are overtaken, or too late. Null: never so far."""
        merged = self.merged(arrivals).withColumn("down", -F.col("period_ms"))
        later = W.partitionBy(*self.keys).orderBy("down")  # the newest period first: growing frames only
        far = self.cutoff_ms + self.period_ms
        return merged.select(
            *self.keys,
            "period_ms",
            F.min("first_recv").over(later.rangeBetween(W.unboundedPreceding, -self.period_ms)).alias("overtaken_at"),
            F.least(
                F.min("first_after").over(later.rangeBetween(-far, -far)),
                F.min("first_recv").over(later.rangeBetween(W.unboundedPreceding, -far - self.period_ms)),
            ).alias("closed_at"),
        )

    def judged(self, rows: DataFrame, closing: DataFrame) -> DataFrame:
        """``rows`` with their outcome. Only periods that were overtaken at all take part in the join's right side."""
        marks = closing.where("overtaken_at is not null").select(*(F.col(k).alias(f"m_{k}") for k in self.keys), F.col("period_ms").alias("m_period"), "overtaken_at", "closed_at")
        on = F.col("period_ms") == F.col("m_period")
        for k in self.keys:
            on &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
        outcome = F.when(F.col("recv_ms") > F.col("closed_at"), DROPPED).when(F.col("recv_ms") > F.col("overtaken_at"), CORRECTED).otherwise(ON_TIME)
        return rows.join(marks, on, "left").withColumn("outcome", outcome).drop("m_period", *(f"m_{k}" for k in self.keys))

    def partials(self, judged: DataFrame) -> DataFrame:
        """The mergeable aggregates: keys, period_ms, batch_ms, outcome, n, sums, first and last receive time."""
        return judged.groupBy(*self.keys, "period_ms", "batch_ms", "outcome").agg(*self._sums(), F.min("recv_ms").alias("first_recv"), F.max("recv_ms").alias("last_recv"))

    def combine(self, partials: DataFrame) -> DataFrame:
        """Per period: counts by outcome, and n and sums of all that arrived before the period closed."""
        kept = F.col("outcome") != DROPPED
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        return partials.groupBy(*self.keys, "period_ms").agg(
            count(kept).alias("n"),
            *(F.sum(F.when(kept, F.col(f"sum_{v}"))).alias(f"sum_{v}") for v in self.values),
            count(F.col("outcome") == ON_TIME).alias("n_on_time"),
            count(F.col("outcome") == CORRECTED).alias("n_corrected"),
            count(F.col("outcome") == DROPPED).alias("n_dropped"),
        )

    def judge_all(self, df: DataFrame) -> DataFrame:
        rows = self.rows(df)
        return self.judged(rows, self.closing(self.arrivals(rows)))

    # -- the same, batch by batch ---------------------------------------------------------------------------------

    def merged(self, arrivals: DataFrame) -> DataFrame:
        return arrivals.groupBy(*self.keys, "period_ms").agg(F.min("first_recv").alias("first_recv"), F.min("first_after").alias("first_after"))

    def ingest(self, spark: SparkSession, store: str, df: DataFrame, delivery: int) -> DataFrame:
        """Adds a delivery of whole arrival batches to ``store`` and returns all partials kept there.

        Deliveries are numbered in receive order. One that is repeated, after a failure, replaces itself. Rows of periods
        that are closed by then are refused: they are kept as ``dropped`` counts only. What a delivery needs of the
        earlier ones is one row per period still open, and per stream the newest period closed; both are written anew
        with each delivery, so the work does not grow with what was ever stored.
        """
        rows = self.rows(df)
        own = self.arrivals(rows).drop("batch_ms")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/state")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [n for s in (fs.listStatus(path) if fs.exists(path) else []) if (n := int(s.getPath().getName().rpartition("=")[2])) < delivery]
        kind = own.withColumn("closed", F.lit(False)).schema
        before = spark.read.schema(kind).parquet(f"{store}/state/delivery={max(earlier)}") if earlier else spark.createDataFrame([], kind)
        live = written(self.merged(before.where("not closed").drop("closed").unionByName(own)), "periods")
        closing = self.closing(live)
        refused = before.where("closed").groupBy(*(F.col(k).alias(f"r_{k}") for k in self.keys)).agg(F.max("period_ms").alias("refused_upto"))
        on = F.lit(True)
        for k in self.keys:
            on &= F.col(k).eqNullSafe(F.col(f"r_{k}"))
        judged = self.judged(rows, closing).join(refused, on, "left").drop(*(f"r_{k}" for k in self.keys))
        judged = judged.withColumn("outcome", F.when(F.col("period_ms") <= F.col("refused_upto"), DROPPED).otherwise(F.col("outcome"))).drop("refused_upto")
        made = self.partials(judged)
        made.write.mode("overwrite").parquet(f"{store}/partials/delivery={delivery}")
        # a closed period needs no more than to be refused; periods close in order
        shut = join_same(live, closing.select(*self.keys, "period_ms", F.col("closed_at").isNotNull().alias("shut_")), [*self.keys, "period_ms"])
        newest = shut.where("shut_").groupBy(*self.keys).agg(F.max("period_ms").alias("period_ms")).unionByName(before.where("closed").select(*self.keys, "period_ms")).groupBy(*self.keys).agg(F.max("period_ms").alias("period_ms"))
        none = F.lit(None).cast("long")
        state = shut.where("not shut_").select(*self.keys, "period_ms", "first_recv", "first_after", F.lit(False).alias("closed"))
        state = state.unionByName(newest.select(*self.keys, "period_ms", none.alias("first_recv"), none.alias("first_after"), F.lit(True).alias("closed")))
        state.write.mode("overwrite").parquet(f"{store}/state/delivery={delivery}")
        return spark.read.schema(made.schema).parquet(f"{store}/partials")
