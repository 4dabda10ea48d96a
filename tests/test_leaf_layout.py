"""Adaptive leaves as a stored layout: interval search, capacity on skewed points, splits on append."""

from __future__ import annotations

import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from rangeframe.operators import joins
from rangeframe.operators.intervals import search_tree, with_interval
from rangeframe.operators.layouts import POINT, RECT, QuadLeaves, fit_layout, layout_from_dict, layout_to_dict
from rangeframe.operators.lookup import PointAt, Window
from rangeframe.operators.quadleaves import quad_leaves
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout

POINTS = "value bigint, x double, y double"


def skewed(rng, n, first=0, at=(700.0, 300.0)):
    """Half of the points in a spot, some of them identical, the others anywhere."""
    out = []
    for i in range(n):
        if i % 2:
            out.append((first + i, at[0] + rng.gauss(0, 0.05), at[1] + rng.gauss(0, 0.05)))
        else:
            out.append((first + i, rng.uniform(0, 1000), rng.uniform(0, 1000)))
    return out


@pytest.mark.parametrize("n", [1, 9, 3000])
def test_interval_search_equals_bisection(spark, n):
    rng = random.Random(n)
    codes = {0} | {rng.getrandbits(32) for _ in range(n // 2)} | {123_456_789 + rng.randint(0, 4 * n) for _ in range(n)}
    starts = [(code, 7 * i % 10_007) for i, code in enumerate(sorted(codes))]
    asked = [0, (1 << 32) - 1] + [rng.getrandbits(32) for _ in range(300)] + [c + d for c, _ in starts[:300] for d in (-1, 0, 1) if c + d >= 0]
    table = spark.createDataFrame([(i, c, "x") for i, c in enumerate(asked)], "id bigint, code bigint, base string")
    got = {r["id"]: r["cell"] for r in with_interval(table, F.col("code"), starts, 32, "cell").collect()}
    first = [c for c, _ in starts]
    assert [got[i] for i in range(len(asked))] == [starts[bisect_right(first, c) - 1][1] for c in asked]
    assert search_tree(starts, 32)[1] <= 8


@pytest.mark.parametrize("at", [POINT, RECT], ids=["points", "rectangles"])
def test_no_leaf_above_capacity(spark, at):
    points = spark.createDataFrame(skewed(random.Random(1), 3000), POINTS)
    data = points if at is POINT else points.selectExpr("value", "x - 1 AS xmin", "y - 2 AS ymin", "x + 1 AS xmax", "y + 2 AS ymax")
    layout = fit_layout(data, "leaves", at=at, n_cells=1, capacity=40, max_depth=20)
    sizes = {r["cell"]: r["count"] for r in layout.assign(data, at).groupBy("cell").count().collect()}
    assert max(sizes.values()) <= 40 and sum(sizes.values()) == 3000 and len(sizes) == layout.n_cells
    if at is POINT:
        leaves = quad_leaves(data, capacity=40, max_depth=20, bounds=layout.bounds)
        assert sorted(r["n_items"] for r in leaves.collect()) == sorted(sizes.values())
        uniform = fit_layout(data, "quad", at=at, n_cells=layout.n_cells).assign(data, at).groupBy("cell").count()
        assert uniform.agg(F.max("count")).first()[0] > 1000
    assert layout_from_dict(layout_to_dict(layout)) == layout


def test_capacity_from_cells_and_empty_data(spark):
    points = spark.createDataFrame(skewed(random.Random(2), 400), POINTS)
    assert 10 <= fit_layout(points, "leaves", at=POINT, n_cells=20).n_cells <= 80
    assert fit_layout(points.limit(0), "leaves", at=POINT, n_cells=20).starts == ((0, 0),)


def test_appends_split_cells_in_place(spark):
    rng = random.Random(3)
    every = skewed(rng, 300)
    path = scratch_path(spark, "leaves")
    stored = StoredLayout.create(spark.createDataFrame(every, POINTS), path, "leaves", at=POINT, n_cells=1, capacity=50, max_depth=18)
    for batch, spot in enumerate([(100.0, 100.0), (700.3, 300.2)]):
        more = skewed(rng, 200, 1000 * (batch + 1), spot) + [(5000 + batch, -50.0, 2000.0)]  # and one outside the bounds
        stored.append(spark.createDataFrame(more, POINTS), f"b{batch}")
        every += more
    sizes = {r["cell"]: r["n_items"] for r in stored.directory().collect()}
    assert max(sizes.values()) <= 50 and sum(sizes.values()) == len(every)
    assert sorted(r["value"] for r in stored.data().collect()) == sorted(p[0] for p in every)
    table = spark.createDataFrame(every, POINTS)
    windows = [(i, p[1] - w, p[2] - w, p[1] + w, p[2] + w) for i, (p, w) in enumerate(zip(every[::30], [0.01, 5, 80] * 20))]
    queries = spark.createDataFrame(windows, "qid bigint, qxmin double, qymin double, qxmax double, qymax double")
    want = sorted(map(tuple, joins.match_points_in_rects(table, queries).collect()))
    reopened = StoredLayout.open(spark, path)
    assert sorted(map(tuple, reopened.match(queries).collect())) == want
    p = every[555]
    assert [r[0] for r in reopened.lookup(PointAt(p[1], p[2])).collect()] == [p[0]]
    compacted = {r["cell"]: r["n_items"] for r in stored.compact("all").directory().collect()}
    assert compacted == sizes
    with pytest.raises(ValueError, match="moved"):
        stored.append(table, "b1")


def test_identical_points_stay_one_cell(spark):
    rows = [(i, 5.0, 5.0) for i in range(200)] + [(1000, 0.0, 0.0), (1001, 9.0, 9.0)]
    stored = StoredLayout.create(spark.createDataFrame(rows, POINTS), scratch_path(spark, "leaves"), "leaves", at=POINT, n_cells=1, capacity=10, max_depth=12)
    stored.append(spark.createDataFrame([(2000, 5.0, 5.0)], POINTS), "more")
    assert stored.split() == 0
    assert stored.lookup(Window(4.9, 4.9, 5.1, 5.1)).count() == 201


def test_split_keeps_pieces_inside_their_cell():
    layout = QuadLeaves(None, 4, 10, ((0, 0), (64, 1), (128, 2)))
    pieces = layout.split([0, 16, 60, 64, 70, 128, 200], {0, 2}, 9)
    assert pieces == [(0, 9), (16, 10), (60, 11), (128, 12), (200, 13)]
    assert layout.with_splits(pieces).starts == ((0, 9), (16, 10), (60, 11), (64, 1), (128, 12), (200, 13))
    assert layout.split([64], {1}, 9) == []
