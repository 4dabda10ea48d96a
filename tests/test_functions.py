"""Geometry and cell functions against plain Python."""

from __future__ import annotations

import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rangeframe.functions import cells as c
from rangeframe.functions import geometry as g
from rangeframe.functions.cells import Bounds
from rangeframe.functions.geometry import Box
from rangeframe.schema import drop_unusable, ingest_counts

RECTS = [
    (0.0, 0.0, 2.0, 2.0),
    (2.0, 2.0, 4.0, 4.0),  # touches the first in a corner
    (1.0, 1.0, 1.0, 1.0),  # a point
    (5.0, 0.0, 3.0, 1.0),  # inverted on x
    (-1.0, -1.0, 10.0, 10.0),
]
SIDES = "xmin double, ymin double, xmax double, ymax double"


def pairs(spark):
    rows = [(*a, *b) for a, b in itertools.product(RECTS, RECTS)]
    names = ", ".join(f"{side}{n} double" for n in "ab" for side in ("xmin", "ymin", "xmax", "ymax"))
    df = spark.createDataFrame(rows, names)
    box = lambda n: Box.of(*(f"{s}{n}" for s in ("xmin", "ymin", "xmax", "ymax")))
    return df, box("a"), box("b")


def area(r):
    return max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def test_pair_functions(spark):
    df, a, b = pairs(spark)
    u = g.union(a, b)
    got = df.select(
        "*",
        g.intersects(a, b).alias("meets"),
        g.contains_point(a, b.xmin, b.ymin).alias("inside"),
        F.array(*u).alias("union"),
        g.enlargement(a, b).alias("growth"),
        g.center_distance_sq(a, b).alias("far"),
    ).collect()
    assert len(got) == len(RECTS) ** 2
    for row in got:
        ra, rb = tuple(row)[:4], tuple(row)[4:8]
        apart = ra[2] < rb[0] or ra[0] > rb[2] or ra[3] < rb[1] or ra[1] > rb[3]
        assert row["meets"] == (not apart)
        assert row["inside"] == (ra[0] <= rb[0] <= ra[2] and ra[1] <= rb[1] <= ra[3])
        assert tuple(row["union"]) == union(ra, rb)
        assert row["growth"] == area(union(ra, rb)) - area(ra)
        dx = (ra[0] + ra[2]) / 2 - (rb[0] + rb[2]) / 2
        dy = (ra[1] + ra[3]) / 2 - (rb[1] + rb[3]) / 2
        assert row["far"] == dx * dx + dy * dy


def test_union_with_missing_rectangle_is_missing(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], SIDES)
    missing = Box(*(F.lit(None).cast("double") for _ in range(4)))
    assert df.select(*g.union(Box.of(), missing)).first() == (None, None, None, None)


def test_single_rect_functions(spark):
    df = spark.createDataFrame(RECTS, SIDES)
    cx, cy = g.center(Box.of())
    for row in df.select("*", g.area(Box.of()), cx, cy, g.is_degenerate(Box.of())).collect():
        r = tuple(row)[:4]
        assert tuple(row)[4:] == (area(r), (r[0] + r[2]) / 2, (r[1] + r[3]) / 2, r[0] == r[2] and r[1] == r[3])


def test_quadrant_ties_stay_south_west(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.1, 5.0), (5.0, 5.1), (5.1, 5.1)], "x double, y double")
    got = df.select(g.quadrant("x", "y", Box.literal(0, 0, 10, 10))).collect()
    assert [r[0] for r in got] == [g.SW, g.SE, g.NW, g.NE]


def test_subdivide_covers_the_box(spark):
    df = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0)], SIDES)
    got = {r["quadrant"]: tuple(r)[1:] for r in df.select(F.inline(g.subdivide(Box.of()))).collect()}
    assert got == {0: (0, 0, 2, 1), 1: (2, 0, 4, 1), 2: (0, 1, 2, 2), 3: (2, 1, 4, 2)}


def test_coord(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 2.0, 1)], "x double, y double, axis int")
    p = g.point("x", "y")
    assert [r[0] for r in df.select(g.coord(p, F.col("axis"))).collect()] == [1.0, 2.0]
    with pytest.raises(ValueError):
        g.coord(p, 2)
    with pytest.raises(PySparkException):
        df.select(g.coord(p, F.lit(2))).collect()


def test_negative_zero_equals_zero(spark):
    df = spark.createDataFrame([(-0.0,)], "x double")
    assert df.filter(F.col("x") == F.lit(0.0)).count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 64, 65, 1000])
def test_plan_time_shapes(spark, n):
    rows, cols = c.grid_dimensions(n)
    assert rows * cols >= n and rows >= 1 and cols >= 1 and (rows - 1) * cols < n
    depth = c.quad_depth(n)
    assert 4**depth >= n and (depth == 0 or 4 ** (depth - 1) < n)


@pytest.mark.parametrize("n", [4, 5, 8])
def test_grid_cells_stay_in_range(spark, n):
    rows, cols = c.grid_dimensions(n)
    bounds = Bounds(0.0, 0.0, 100.0, 100.0)
    df = spark.createDataFrame([(74.0, 74.0), (0.0, 0.0), (100.0, 100.0), (-5.0, 1e300)], "x double, y double")
    free = [r[0] for r in df.select(c.grid_cell(F.col("x"), F.col("y"), bounds, rows, cols)).collect()]
    held = [r[0] for r in df.select(c.grid_cell(F.col("x"), F.col("y"), bounds, rows, cols, n)).collect()]
    assert all(0 <= v < rows * cols for v in free) and all(0 <= v < n for v in held)
    assert free[1] == 0 and free[2] == rows * cols - 1


def test_narrow_data_has_unit_cells(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.4, 0.3)], "x double, y double")
    cells = df.select(c.grid_cell(F.col("x"), F.col("y"), Bounds(0.1, 0.2, 0.4, 0.3), 3, 3)).collect()
    assert {r[0] for r in cells} == {0}


def python_path(x, y, b, depth):
    path, box = 0, [b.xmin, b.ymin, b.xmax, b.ymax]
    for _ in range(depth):
        mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        east, north = x > mx, y > my
        path = path * 4 + east + 2 * north
        box = [mx if east else box[0], my if north else box[1], box[2] if east else mx, box[3] if north else my]
    return path


def test_quad_path_is_bit_exact(spark):
    values = [0.0, 0.1, 1 / 3, 0.5, 0.625, 0.75, 0.9999999, 1.0, 3.7, 7.3]
    rows = list(itertools.product(values, values))
    bounds = Bounds(0.0, 0.0, 7.3, 7.3)
    df = spark.createDataFrame(rows, "x double, y double")
    got = c.with_quad_path(df, F.col("x"), F.col("y"), bounds, 12).collect()
    assert all(r["quad_path"] == python_path(r["x"], r["y"], bounds, 12) for r in got)


def test_ingest_check(spark):
    rows = [(1, 1.0, 2.0), (2, float("nan"), 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "value bigint, x double, y double")
    assert [r["value"] for r in drop_unusable(df, ["x", "y"]).collect()] == [1]
    assert ingest_counts(df, ["x", "y"]).first() == (3, 1, 2)
