"""Columns out of raw JSON messages. A message that is no valid JSON as a whole yields null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_json(raw: Column | str) -> Column:
    """One text per JSON value: keys sorted, no spacing, numbers without trailing zeros. Other text stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(_c(raw))), _c(raw))


def event_time(raw: Column | str, channel: Column | str) -> Column:
    """``data.time``, for trades messages the time of the first trade; null if unreadable."""
    v = F.try_parse_json(_c(raw))
    first = F.try_variant_get(v, "$.data[0].time", "bigint")
    return F.when(_c(channel) == "trades", first).otherwise(F.try_variant_get(v, "$.data.time", "bigint"))


def channel_and_coin(raw: Column | str) -> tuple[Column, Column]:
    """Routing of a message: its channel, and the coin of its data or of its first item."""
    v = F.try_parse_json(_c(raw))
    coin = F.coalesce(F.try_variant_get(v, "$.data.coin", "string"), F.try_variant_get(v, "$.data[0].coin", "string"))
    return F.try_variant_get(v, "$.channel", "string"), coin


def times_in(raw: Column | str) -> Column:
    """Every instant that stands as ``"time": n`` in a message, in order, without reading the message; empty for none."""
    found = F.regexp_extract_all(_c(raw), F.lit(r'"time"\s*:\s*(\d+)'), F.lit(1))
    return F.transform(found, lambda x: x.cast("long"))
