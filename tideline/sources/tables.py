"""Explicit schemas of the domain tables, and their readers. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideline.session import ship

_TYPES = {"l": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "b": T.BooleanType(), "ts": T.TimestampType(), "bin": T.BinaryType()}


def schema(spec: str) -> T.StructType:
    """``"coin:s time_ms:l"`` as a StructType."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(":") for x in spec.split())])


_LEVELS = " ".join(f"{side}_{what}_{k}:d" for side in ("bid", "ask") for k in range(1, 6) for what in ("px", "sz"))
_TIMES = "time_ms:l recv_ms:l conn_ms:l"
_FILL = "kind:s px:d sz:d side:s start_position:d dir:s crossed:b closed_pnl:d fee:d tid:l oid:l twap_id:l liquidated_user:s"

SCHEMAS = {
    "book": schema(f"coin:s {_TIMES} {_LEVELS}"),
    "trades": schema(f"coin:s {_TIMES} px:d sz:d side:s buyer:s seller:s tid:l"),
    "bbo": schema(f"coin:s {_TIMES} bid_px:d bid_sz:d ask_px:d ask_sz:d"),
    "fills": schema(f"address:s seq:l time_ms:l coin:s {_FILL}"),
    "proxy": schema("coin:s second:l low:d high:d last:d n_trades:l"),
    "proxy_days": schema("coin:s day:l found:b"),
    "funding": schema("coin:s hour_ms:l time_ms:l rate:d premium:d"),
    "coverage": schema("address:s start_ms:l end_ms:l ingested_at_ms:l n_fills:l status:s content_hash:s"),
    "divergences": schema("address:s time_ms:l tid:l field:s old:s new:s detected_at_ms:l"),
    "raw_leaderboard": schema("snapshot_ms:l sha256:s body:bin"),
    "leaderboard": schema("snapshot_ms:l address:s account_value:d"),
    "meta": schema("snapshot_ms:l coin:s sz_decimals:l"),
    "roles": schema("snapshot_ms:l address:s role:s"),
    "copy_orders": schema("run_id:l order_no:l wallet:s event_t:l nominal_t:l exec_t:l coin:s side:s requested:d executed:d price:d fee:d reason:s"),
    "segments": schema("coin:s channel:s hour_ms:l opened_ms:l closed:b path:s n_records:l size_bytes:l"),
    "records": schema("path:s record_no:l recv_ms:l conn_ms:l raw:s"),
    "gaps": schema("coin:s start_ms:l end_ms:l reason:s"),
    "day_reports": schema("day:l n_rows:l dropped_first:l n_gaps:l deleted_segments:l"),
    "day_coverage": schema("coin:s day:l gap_ms:l unrecorded_ms:l observed_ms:l complete:b"),
    "fill_snapshots": schema("batch_id:l snapshot_ms:l address:s seq:l coin:s time_ms:l px:d sz:d side:s start_position:d closed_pnl:d fee:d tid:l"),
    "snapshot_results": schema("batch_id:l snapshot_ms:l sha256:s body_bytes:l wallets:l perps:l"),
    "eval_items": schema("item_id:l benchmark:s lang:s passage:s"),
    "source_targets": schema("source:s target_share:d max_repeats:l"),
    "documents": schema("doc_id:l text:s lang:s source:s n_chars:l paper_key:s version:l collection:s category:s title:s updated_at:ts"),
}
#: Partition columns and the instant of each table that has them.
PARTITIONS = {
    "fills": ["address"], "coverage": ["address"], "divergences": ["address"], "funding": ["coin"], "proxy": ["coin", "day"], "proxy_days": ["coin"],
    "bbo": ["coin", "day"], "book": ["coin", "day"], "trades": ["coin", "day"], "gaps": ["coin"], "leaderboard": ["snapshot_ms"], "meta": ["snapshot_ms"], "roles": ["snapshot_ms"], "raw_leaderboard": ["snapshot_ms"],
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``: with its declared schema where it has one, else with the file's own."""
    ship(spark)
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{root}/{name}.parquet")
