"""Packed cells: even sizes, tight bounds, answers as with any other layout."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from catalog import views
from rangeframe.operators import joins
from rangeframe.operators.intervals import bounds_below
from rangeframe.operators.layouts import POINT, RECT, fit_layout, layout_from_dict, layout_to_dict
from rangeframe.operators.lookup import PointAt, Window
from rangeframe.plans import workload
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout

SF = "/root/testdata/sf0.001"


def test_binary_search(spark):
    rng = random.Random(5)
    groups = [sorted(rng.uniform(-9, 9) for _ in range(n)) for n in (0, 1, 7, 8, 30)]
    flat, firsts = [b for g in groups for b in g], [0, 0, 1, 8, 16]
    rows = [(g, rng.choice([rng.uniform(-10, 10), *groups[g]])) for g in range(5) for _ in range(60)] + [(2, None), (2, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = df.select("g", "v", bounds_below(F.col("v"), flat, F.col("g"), firsts, [len(g) for g in groups]).alias("n")).collect()
    for r in got:
        want = 0 if r["v"] is None else len(groups[r["g"]]) if r["v"] != r["v"] else bisect.bisect_right(groups[r["g"]], r["v"])
        assert r["n"] == want


def _skewed_rects(spark, n=20_000):
    """Small rectangles, two thirds of them in a corner of a hundredth of the space."""
    corner = "CASE WHEN id % 3 < 2 THEN 0.01 ELSE 1.0 END"
    x, y = (f"pmod(xxhash64(id, {k}), 1000003) / 1000003D * 10000D * {corner}" for k in (1, 2))
    return spark.range(n).selectExpr("id AS value", f"{x} AS xmin", f"{y} AS ymin", f"{x} + 1 + id % 9 AS xmax", f"{y} + 1 + id % 5 AS ymax")


def test_even_cells_on_skewed_data(spark):
    rects = _skewed_rects(spark)
    for n in (1, 2, 10, 100, 400):
        layout = fit_layout(rects, "packed", at=RECT, n_cells=n)
        sizes = [r["count"] for r in layout.assign(rects, RECT).groupBy("cell").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 1.5 * 20_000 / n and n * 0.8 <= layout.n_cells <= n * 1.2 + 1
        assert layout_from_dict(layout_to_dict(layout)) == layout


def test_fewer_rows_than_a_grid(spark):
    rects = _skewed_rects(spark)
    queries = _skewed_rects(spark, 200).selectExpr("value AS qid", "xmin AS qxmin", "ymin AS qymin", "xmax + 20 AS qxmax", "ymax + 20 AS qymax")
    shares = {}
    for by in ("grid", "packed"):
        layout = fit_layout(rects, by, at=RECT, n_cells=100)
        shares[by] = workload.layout_shape(layout.assign(rects, RECT), layout, queries, RECT).first()["row_share"]
    assert shares["packed"] < shares["grid"] / 5


def test_ties(spark):
    """A third of the centers on one line, and a third in one place: the line is cut, the place cannot be."""
    line = spark.range(3_000).selectExpr("id AS value", "5D AS x", "cast(id AS double) AS y")
    place = spark.range(3_000).selectExpr("id + 3000 AS value", "7D AS x", "7D AS y")
    rest = spark.range(3_000).selectExpr("id + 6000 AS value", "cast(id AS double) AS x", "cast(id * 7 % 3000 AS double) AS y")
    data = line.union(place).union(rest)
    placed = fit_layout(data, "packed", at=POINT, n_cells=90).assign(data, POINT)
    assert placed.filter("x = 5").groupBy("cell").count().agg(F.max("count")).first()[0] <= 250
    assert placed.filter("x = 7 AND y = 7").select("cell").distinct().count() == 1
    assert placed.count() == 9_000 and placed.filter("cell IS NULL").count() == 0


def test_odd_values_and_clashing_columns(spark):
    rows = [(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 2.0), (4, float("inf"), 1.0), (5, 1.0, float("-inf")), (5, 1.0, float("-inf"))]
    data = spark.createDataFrame(rows, "value bigint, x double, y double").withColumns({n: F.lit("z") for n in ("slice", "cell", "q")})
    layout = fit_layout(data, "packed", at=POINT, n_cells=4)
    placed = layout.assign(data, POINT)
    assert placed.count() == 6 and placed.filter("cell IS NULL OR slice <> 'z'").count() == 0
    assert layout_from_dict(layout_to_dict(layout)) == layout
    nothing = fit_layout(data.limit(0), "packed", at=POINT, n_cells=4)
    assert nothing.n_cells == 1 and nothing.assign(data, POINT).agg(F.max("cell")).first()[0] == 0
    with pytest.raises(ValueError):
        fit_layout(data, "packed", at=POINT, n_cells=0)


def test_stored_answers(spark):
    rects, asked, inside = views.rects(spark, SF), views.qrects(spark, SF), views.qinside(spark, SF)
    stored = StoredLayout.create(rects, scratch_path(spark, "packed"), "packed", at=RECT, n_cells=30)
    far = spark.createDataFrame([(10**9, -9e9, -9e9, -8e9, -8e9)], rects.schema)
    stored.append(far, "far")  # outside the fitted bounds
    every = rects.union(far)
    stored = StoredLayout.open(spark, stored.path)
    for match, queries in ((joins.match_rects, asked), (joins.match_rects_at_points, inside)):
        want = sorted(map(tuple, match(every, queries).collect()))
        assert want and sorted(map(tuple, stored.match(queries).collect())) == want
    assert [r["value"] for r in stored.lookup(PointAt(-8.5e9, -8.5e9)).collect()] == [10**9]
    window = Window(100_000.0, 500.0, 300_000.0, 1_500.0)
    want = every.filter("xmin <= 300000 AND xmax >= 100000 AND ymin <= 1500 AND ymax >= 500")
    assert stored.lookup(window).count() == want.count() > 0
    assert len(stored.candidate_cells(window)) < stored.directory().count()
