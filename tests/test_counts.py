"""Counts without pairs equal the counts of pairs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from catalog import views
from rangeframe.operators import counts, joins
from rangeframe.plans import workload as w

INF = float("inf")
SMALL = counts.CountTuning(cell_rows=4, hot_rows=10, side=4, levels=4)
SHUFFLED = counts.CountTuning(cell_rows=4, hot_rows=10, side=4, levels=4, joins=joins.JoinTuning(broadcast_rows=0, hot_rows=20))


def same(hits, pairs):
    want = {r["qid"]: r["n_results"] for r in w.hits_of(pairs).collect()}
    got = {r["qid"]: r["n_results"] for r in hits.collect()}
    assert got == want
    return want


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 1000), rng.uniform(0, 500)) for _ in range(600)]
    rows += [(rng.gauss(500, 0.5), rng.gauss(100, 0.2)) for _ in range(400)]  # a cluster far below the first grid's cells
    rows += [(7.0, 7.0)] * 300 + [(float(n % 10), float(n // 10)) for n in range(100)]
    rows += [(None, 1.0), (1.0, float("nan")), (INF, 3.0), (-INF, -INF), (1e300, -1e300)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "value bigint, x double, y double").repartition(5)


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(120):
        x, y, s = rng.uniform(-50, 1000), rng.uniform(-50, 500), rng.choice([0.0, 0.3, 5, 100, 700])
        rows.append((x, y, x + s, y + s * rng.random()))
    rows += [(499.5, 99.9, 500.2, 100.1), (500.0, 99.0, 500.5, 200.0), (7.0, 7.0, 7.0, 7.0), (2.0, 3.0, 5.0, 5.0)]
    rows += [(-INF, -INF, INF, INF), (0.0, -INF, INF, 100.0), (9.0, 9.0, 8.0, 10.0), (None, 0.0, 1.0, 1.0), (float("nan"), 0.0, 1.0, 1.0)]
    table = [(i, *r) for i, r in enumerate(rows)] + [(3, 0.0, 0.0, 900.0, 400.0)]  # a repeated id
    return spark.createDataFrame(table, "qid bigint, qxmin double, qymin double, qxmax double, qymax double")


@pytest.mark.parametrize("tuning", [counts.DEFAULT_COUNTS, SMALL, SHUFFLED], ids=["default", "small", "shuffled"])
def test_rectangles(points, boxes, tuning):
    found = same(counts.rect_hits(points, boxes, tuning=tuning), joins.match_points_in_rects(points, boxes))
    assert len(found) > 40


def test_nested_grids_end_the_comparison_of_rows(points, boxes, monkeypatch):
    """Inside the cluster a query compares few rows once hot cells are grids of their own."""
    compared = []
    whole = counts.join_on

    def counted(data, queries, keys, **options):
        met = whole(data, queries, keys, **options)
        compared.append(met.count())
        return met

    monkeypatch.setattr(counts, "join_on", counted)
    inside = boxes.filter("qid = 121").select("qid", *(F.lit(v).alias(n) for n, v in (("qxmin", 499.0), ("qymin", 99.5), ("qxmax", 501.0), ("qymax", 100.5))))
    got = {}
    for levels in (1, 4):
        compared.clear()
        tuning = counts.CountTuning(cell_rows=4, hot_rows=10, side=8, levels=levels)
        got[levels] = counts.rect_hits(points, inside, tuning=tuning).collect(), sum(compared)
    assert got[1][0] == got[4][0] and got[4][1] < got[1][1] / 2


def test_plan_holds_no_pairs(spark):
    """The records' values are not even read."""
    sf = "/root/testdata/sf0.001"
    found = counts.rect_hits(views.points(spark, sf), views.qrects(spark, sf))
    assert "o_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_keys_and_positions(spark, points):
    data = spark.createDataFrame([(n % 7, n) for n in range(100)] + [(None, 1)] * 3 + [(3, 5)] * 200, "key int, value bigint")
    asked = spark.createDataFrame([(n, n) for n in range(-2, 10)] + [(20, None), (3, 4)], "qid bigint, k bigint")
    same(counts.key_hits(data, asked), joins.match_keys(data, asked))
    at = points.select(F.col("value").alias("qid"), F.col("x").alias("px"), F.col("y").alias("py"))
    same(counts.point_hits(points, at), joins.match_points(points, at))


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "timestamp_ntz"])
def test_key_ranges(spark, kind):
    rng = random.Random(4)
    make = {
        "bigint": int,
        "double": lambda n: n / 3,
        "string": lambda n: f"k{n:03d}",
        "date": lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n),
        "timestamp_ntz": lambda n: dt.datetime(2024, 3, 31) + dt.timedelta(minutes=17 * n),
    }[kind]
    keys = [make(rng.randint(0, 60)) for _ in range(400)] + [make(5)] * 500
    data = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, -1)], f"key {kind}, value bigint").repartition(4)
    bounds = [(rng.randint(-5, 65), rng.randint(-5, 65)) for _ in range(60)] + [(5, 5), (0, 60), (60, 0)]
    asked = [(i, make(a), make(b)) for i, (a, b) in enumerate(bounds)] + [(900, None, make(3)), (0, make(0), make(9))]
    queries = spark.createDataFrame(asked, f"qid bigint, low {kind}, high {kind}")
    want = {}
    for qid, low, high in asked:
        if low is not None and (n := sum(low <= k <= high for k in keys)):
            want[qid] = want.get(qid, 0) + n
    assert {r["qid"]: r["n_results"] for r in counts.key_range_hits(data, queries).collect()} == want


def test_empty_tables_and_zero_counts(spark, points, boxes):
    assert counts.rect_hits(points.limit(0), boxes).count() == 0
    assert counts.rect_hits(points, boxes.limit(0)).count() == 0
    data = spark.createDataFrame([(1, 1)], "key bigint, value bigint")
    asked = spark.createDataFrame([(1, 5, 9), (2, 0, 3), (None, 1, 1)], "qid bigint, low bigint, high bigint")
    got = counts.hits_per_query(data, asked, counts.key_range_hits)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0), (2, 1), (None, 1)]
    row = w.summary(data, asked, counts.key_range_hits(data, asked), algorithm="a", workload="b").first()
    assert (row["total_results"], row["num_queries"]) == (2, 3)
    assert w.summary(data, asked.limit(0), counts.key_range_hits(data, asked.limit(0)), algorithm="a", workload="b").first()["total_results"] == 0
