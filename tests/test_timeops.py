from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline.functions import timeops as t


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_zone_plays_no_part(spark, zone):
    values = [0, -1, 1, 86_400_000, -86_400_001, 1_356_487_577_386, 951_782_400_000, None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(v,) for v in values], "x long")
        got = df.select("x", t.utc_day("x").alias("d"), t.hour_floor("x").alias("h"), t.second_of("x").alias("s"), t.iso_text("x").alias("i"), t.parse_utc_date(F.substring(t.iso_text("x"), 1, 10)).alias("p")).collect()
        naive = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:11.172999' AS ts").select(t.naive_ms("ts").alias("m")).first().m
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for r in got:
        if r.x is None:
            assert tuple(r) == (None,) * 6
            continue
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=r.x)
        assert r.i == at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
        assert (r.d, r.h, r.s, r.p) == (r.x // 86_400_000, r.x // 3_600_000 * 3_600_000, r.x // 1000, r.x // 86_400_000 * 86_400_000)
    assert naive == 1_704_067_211_172


def test_strict_dates(spark):
    df = spark.createDataFrame([("2013-01-01",), ("2013-1-1",), ("2013-02-30",), ("",), (None,)], "d string")
    assert [r.p for r in df.select(t.parse_utc_date("d").alias("p")).collect()] == [1_356_998_400_000, None, None, None, None]


def test_overlap(spark):
    df = spark.createDataFrame([(0, 10), (8, 20), (30, 40)], "a long, b long")
    assert [r.o for r in df.select(t.overlap_ms(F.col("a"), F.col("b"), F.lit(5), F.lit(12)).alias("o")).collect()] == [5, 4, 0]
