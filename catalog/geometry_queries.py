"""Geometry column functions, each over a whole table of rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeframe.functions import geometry as g
from rangeframe.functions.geometry import Box

from . import views as v
from .views import sql

A = Box.of
QUERY_SIDES = ("qxmin", "qymin", "qxmax", "qymax")


def _b() -> Box:
    return Box.of(*QUERY_SIDES)


def geo_point(spark, sf):
    p = g.point("x", "y")
    return v.points(spark, sf).select("value", p.alias("p")).select("value", "p.x", "p.y")


def geo_coord(spark, sf):
    points = v.points(spark, sf).select("value", g.point("x", "y").alias("p"))
    axis = (F.col("value") % 2).cast("int")
    return points.select(
        "value", g.coord("p", 0).alias("first"), g.coord("p", 1).alias("second"), g.coord("p", axis).alias("chosen")
    )


def geo_rect(spark, sf):
    r = g.rect("xmin", "ymin", "xmax", "ymax")
    boxed = v.rects(spark, sf).select("value", r.alias("r"))
    box = Box.of_struct("r")
    return boxed.select("value", *(getattr(box, s).alias(s) for s in box._fields))


def geo_union(spark, sf):
    u = g.union(A(), _b())
    return v.pairs(spark, sf).select("value", *(getattr(u, s).alias(s) for s in u._fields))


def geo_center(spark, sf):
    cx, cy = g.center(A())
    return v.rects(spark, sf).select("value", cx.alias("cx"), cy.alias("cy"))


def geo_is_degenerate(spark, sf):
    rects = v.rects(spark, sf)
    shrunk = Box(F.col("xmin"), F.col("ymin"), F.col("xmin"), F.col("ymin"))
    return rects.select("value", g.is_degenerate(A()).alias("whole"), g.is_degenerate(shrunk).alias("corner"))


def geo_subdivide(spark, sf):
    return v.rects(spark, sf).select("value", F.inline(g.subdivide(A())))


def _on_pairs(name, column):
    return lambda spark, sf: v.pairs(spark, sf).select("value", column().alias(name))


QUERIES = {
    "geo_point": geo_point,
    "geo_coord": geo_coord,
    "geo_rect": geo_rect,
    "geo_area": lambda spark, sf: v.rects(spark, sf).select("value", g.area(A()).alias("area")),
    "geo_intersects": _on_pairs("meets", lambda: g.intersects(A(), _b())),
    "geo_contains_point": _on_pairs("inside", lambda: g.contains_point(_b(), "xmin", "ymin")),
    "geo_union": geo_union,
    "geo_enlargement": _on_pairs("enlargement", lambda: g.enlargement(_b(), A())),
    "geo_center": geo_center,
    "geo_center_distance_sq": _on_pairs("distance_sq", lambda: g.center_distance_sq(A(), _b())),
    "geo_is_degenerate": geo_is_degenerate,
    "geo_quadrant": _on_pairs("quadrant", lambda: g.quadrant("xmin", "ymin", _b())),
    "geo_subdivide": geo_subdivide,
}

_MX, _MY = "(xmin + xmax) / 2", "(ymin + ymax) / 2"
_QMX, _QMY = "(qxmin + qxmax) / 2", "(qymin + qymax) / 2"
_BIG = "(greatest(xmax, qxmax) - least(xmin, qxmin)) * (greatest(ymax, qymax) - least(ymin, qymin))"

ORACLES = {
    "geo_point": sql("SELECT value, x, y FROM points"),
    "geo_coord": sql(
        "SELECT value, x AS first, y AS second, CASE WHEN value % 2 = 0 THEN x ELSE y END AS chosen FROM points"
    ),
    "geo_rect": sql("SELECT value, xmin, ymin, xmax, ymax FROM rects"),
    "geo_area": sql("SELECT value, (xmax - xmin) * (ymax - ymin) AS area FROM rects"),
    "geo_intersects": sql(
        "SELECT value, NOT (xmax < qxmin OR xmin > qxmax OR ymax < qymin OR ymin > qymax) AS meets FROM pairs"
    ),
    "geo_contains_point": sql(
        "SELECT value, xmin >= qxmin AND xmin <= qxmax AND ymin >= qymin AND ymin <= qymax AS inside FROM pairs"
    ),
    "geo_union": sql(
        """SELECT value, least(xmin, qxmin) AS xmin, least(ymin, qymin) AS ymin,
                  greatest(xmax, qxmax) AS xmax, greatest(ymax, qymax) AS ymax FROM pairs"""
    ),
    "geo_enlargement": sql(f"SELECT value, {_BIG} - (qxmax - qxmin) * (qymax - qymin) AS enlargement FROM pairs"),
    "geo_center": sql(f"SELECT value, {_MX} AS cx, {_MY} AS cy FROM rects"),
    "geo_center_distance_sq": sql(
        f"""SELECT value, ({_MX} - {_QMX}) * ({_MX} - {_QMX}) + ({_MY} - {_QMY}) * ({_MY} - {_QMY}) AS distance_sq
            FROM pairs"""
    ),
    "geo_is_degenerate": sql(
        "SELECT value, xmin = xmax AND ymin = ymax AS whole, true AS corner FROM rects"
    ),
    "geo_quadrant": sql(
        f"""SELECT value, cast(CASE WHEN xmin > {_QMX} THEN 1 ELSE 0 END
                               + CASE WHEN ymin > {_QMY} THEN 2 ELSE 0 END AS integer) AS quadrant FROM pairs"""
    ),
    "geo_subdivide": sql(
        f"""SELECT value, 0 AS quadrant, xmin, ymin, {_MX} AS xmax, {_MY} AS ymax FROM rects
            UNION ALL SELECT value, 1, {_MX}, ymin, xmax, {_MY} FROM rects
            UNION ALL SELECT value, 2, xmin, {_MY}, {_MX}, ymax FROM rects
            UNION ALL SELECT value, 3, {_MX}, {_MY}, xmax, ymax FROM rects"""
    ),
}
