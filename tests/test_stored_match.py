"""Batches over stored layouts: the data stay where they are stored."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalog import views
from rangeframe.operators import joins
from rangeframe.operators.layouts import KEY, POINT, RECT
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout, query_blocks

SF = "/root/testdata/sf0.001"
FEW = joins.JoinTuning(broadcast_rows=400)


def test_blocks():
    assert query_blocks([(1, 3), (2, 4), (5, 2), (6, 9), (7, 1)], 6) == [([1], 1), ([2, 5], 1), ([6], 2), ([7], 1)]
    assert query_blocks([], 5) == []
    rng = random.Random(1)
    asked = [(c, rng.randint(1, 30)) for c in range(200)]
    blocks = query_blocks(asked, 20)
    assert [c for cells, _ in blocks for c in cells] == [c for c, _ in asked]
    n = dict(asked)
    assert all(sum(n[c] for c in cells) <= 20 * pieces for cells, pieces in blocks)


CASES = {
    "keys": (views.kv, KEY, "key", views.qkeys, joins.match_keys),
    "key ranges": (views.kv, KEY, "key", views.qranges, joins.match_key_ranges),
    "positions": (views.points, POINT, "kd", views.qpoints, joins.match_points),
    "windows": (views.points, POINT, "quad", views.qrects, joins.match_points_in_rects),
    "rects at points": (views.rects, RECT, "grid", views.qinside, joins.match_rects_at_points),
    "rects": (views.rects, RECT, "grid", views.qrects, joins.match_rects),
}


@pytest.fixture(scope="module", params=list(CASES))
def case(request, spark):
    data, at, by, asked, match = CASES[request.param]
    table = data(spark, SF)
    stored = StoredLayout.create(table, scratch_path(spark, "stored-match"), by, at=at, n_cells=16)
    queries = asked(spark, SF)
    queries = queries.union(queries.limit(3))  # ids that repeat
    return table, stored, queries, match


@pytest.mark.parametrize("tuning", [joins.DEFAULT_TUNING, FEW, joins.JoinTuning(broadcast_rows=10)], ids=["whole", "blocks", "shuffled"])
def test_same_answers(case, tuning):
    data, stored, queries, match = case
    want = sorted(map(tuple, match(data, queries).collect()))
    assert want and sorted(map(tuple, stored.match(queries, tuning=tuning).collect())) == want


def test_blocks_leave_the_data_in_place(spark):
    """More queries than may be broadcast: still no shuffle of stored rows."""
    points, queries = views.points(spark, SF), views.qpoints(spark, SF)
    stored = StoredLayout.create(points, scratch_path(spark, "stored-match"), "kd", at=POINT, n_cells=16)
    assert queries.count() > 2 * FEW.broadcast_rows
    plan = stored.match(queries, tuning=FEW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    every = joins.match_points(stored.data(), queries, tuning=FEW)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in every


def test_one_crowded_cell(spark):
    """All queries ask for one cell: it is read once per piece, and each pair comes out once."""
    points = views.points(spark, SF)
    stored = StoredLayout.create(points, scratch_path(spark, "stored-match"), "quad", at=POINT, n_cells=4)
    one = points.first()
    queries = spark.range(900).select(F.col("id").alias("qid"), F.lit(one["x"]).alias("px"), F.lit(one["y"]).alias("py"))
    got = stored.match(queries, tuning=FEW)
    assert got.count() == got.distinct().count() == 900 * points.filter((F.col("x") == one["x"]) & (F.col("y") == one["y"])).count()
