"""Batches too large for the driver's memory, and answers compared without moving their pairs."""

from __future__ import annotations

from catalog import views
from rangeframe.operators import joins
from rangeframe.operators.layouts import POINT
from rangeframe.plans import workload as w
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout

SF = "/root/testdata/sf0.001"
PAIR = "qid bigint, value bigint"


def test_few_broadcasts_however_many_queries(spark):
    """Ninety blocks of queries were ninety broadcasts; beyond a few the batch is shuffled."""
    points, queries = views.points(spark, SF), views.qpoints(spark, SF)
    stored = StoredLayout.create(points, scratch_path(spark, "large-batch"), "kd", at=POINT, n_cells=4)
    found = stored.match(queries, tuning=joins.JoinTuning(broadcast_rows=40))
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 8
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joins.match_points(points, queries).collect()))


def test_differing_pairs_are_counted(spark):
    left = [(1, 10), (1, 10), (1, 11), (2, 20), (None, 5), (3, None), (4, 1), (6, 1), (6, 2)]
    right = [(1, 10), (1, 11), (1, 12), (2, 20), (None, 5), (None, 6), (3, None), (5, 1), (6, 0), (6, 3)]
    a, b = (spark.createDataFrame(rows, PAIR) for rows in (left, right))
    # only left: 1-10 once, 4-1, 6-1, 6-2; only right: 1-12, null-6, 5-1, 6-0, 6-3
    assert w.answers_differ(a, b).collect() == [(4, 5)]
    assert w.answers_differ(a, a).collect() == [(0, 0)]
    assert w.answers_differ(a.limit(0), a).collect() == [(0, 9)]
    assert w.answers_differ(a.limit(0), a.limit(0)).collect() == [(0, 0)]


def test_equal_answers_move_no_pairs(spark):
    pairs = spark.range(5000).selectExpr("id % 7 AS qid", "id AS value")
    plan = w.answers_differ(pairs, pairs.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert w.tally(pairs).agg({"n_results": "sum"}).first()[0] == 5000
