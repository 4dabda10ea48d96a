"""Keys of every ordered type meet as in a plain join, in any session time zone, clock changes included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rangeframe.operators import joins

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]
#: minutes around the nights in which New York's clocks change, twice a year
STARTS = ["2024-03-10 00:00:00", "2024-11-03 00:00:00", "1969-12-31 22:00:00"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", was)


def keys(spark, kind, n, seed):
    """``(id, key)``: random minutes after the starts, in the type asked for."""
    rng = random.Random(seed)
    rows = [(i, STARTS[i % 3], rng.randint(0, 300)) for i in range(n)]
    table = spark.createDataFrame(rows, "id bigint, start string, minutes bigint")
    local = F.col("start").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("minutes").cast("int"))
    made = {
        "timestamp_ntz": local,
        # instants, so that the hour that comes twice is there twice
        "timestamp": F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.col("start"))) + F.col("minutes") * 60),
        "date": F.date_add(local.cast("date"), (F.col("minutes") % 17).cast("int")),
        "decimal(20,3)": (F.col("minutes") / 7).cast("decimal(20,3)"),
        "float": (F.col("minutes") / 7).cast("float"),
    }[kind]
    return table.select("id", made.cast(kind).alias("key"))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "decimal(20,3)", "float"])
@pytest.mark.parametrize("tuning", [joins.DEFAULT_TUNING, joins.JoinTuning(broadcast_rows=0)], ids=["broadcast", "shuffled"])
def test_equal_to_a_plain_join(spark, zone, kind, tuning):
    data = keys(spark, kind, 400, 1).select("key", F.col("id").alias("value"))
    ends = keys(spark, kind, 60, 2).select(F.col("id").alias("qid"), F.col("key").alias("low"))
    ranges = ends.join(keys(spark, kind, 60, 3).select(F.col("id").alias("qid"), F.col("key").alias("high")), "qid")
    asked = keys(spark, kind, 200, 4).select(F.col("id").alias("qid"), F.col("key").alias("k"))
    for got, want in (
        (joins.match_key_ranges(data, ranges, tuning=tuning), data.join(ranges, F.col("key").between(F.col("low"), F.col("high")))),
        (joins.match_keys(data, asked, tuning=tuning), data.join(asked, F.col("key") == F.col("k"))),
    ):
        rows = sorted(map(tuple, want.select("qid", "value").collect()))
        assert sorted(map(tuple, got.collect())) == rows and rows


def test_bounds_reach_the_scan(spark, zone, tmp_path):
    data = keys(spark, "timestamp_ntz", 50, 1).select("key", F.col("id").alias("value"))
    data.write.parquet(str(tmp_path / "t"))
    asked = keys(spark, "timestamp_ntz", 9, 4).select(F.col("id").alias("qid"), F.col("key").alias("k"))
    plan = joins.match_keys(spark.read.parquet(str(tmp_path / "t")), asked)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan
