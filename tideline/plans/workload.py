"""A synthetic workload of fills for measuring: wallets that open and close hourly positions, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.timeops import DAY_MS, HOUR_MS
from tideline.sources.tables import SCHEMAS

FIRST_DAY, DAYS, COINS = 20_000, 56, 5


def fills(spark: SparkSession, wallets: int, episodes: int) -> DataFrame:
    """Two fills per episode: a position of one unit, held for an hour, its result reported exactly."""
    start, gap = FIRST_DAY * DAY_MS, DAYS * DAY_MS // episodes
    rows = spark.range(wallets * episodes * 2).select(
        F.call_function("div", F.col("id"), F.lit(episodes * 2)).alias("w"), F.pmod("id", F.lit(episodes * 2)).alias("seq")
    )
    e, closing = F.call_function("div", F.col("seq"), F.lit(2)), F.col("seq") % 2 == 1
    entry = 100.0 + F.pmod(F.col("w") * 31 + e * 17, F.lit(50))
    gain = F.pmod(F.col("w") + e, F.lit(7)) - 3.0
    px = F.when(closing, entry + gain).otherwise(entry)
    named = {
        "address": F.concat(F.lit("0x"), F.lpad(F.col("w").cast("string"), 40, "0")), "seq": F.col("seq"), "time_ms": F.lit(start) + e * gap + F.when(closing, HOUR_MS).otherwise(0),
        "coin": F.concat(F.lit("C"), (e % COINS).cast("string")), "kind": F.lit("perp"), "px": px, "sz": F.lit(1.0), "side": F.when(closing, "A").otherwise("B"),
        "start_position": F.when(closing, 1.0).otherwise(0.0), "crossed": e % 2 == 0, "closed_pnl": F.when(closing, gain).otherwise(0.0), "fee": F.lit(0.0), "tid": F.col("seq"), "oid": F.col("seq"),
    }
    return rows.select(*(named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["fills"].fields))
