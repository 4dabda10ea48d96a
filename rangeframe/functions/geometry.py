"""Point and rectangle expressions over plain columns.

All functions build Catalyst expressions: no UDFs, so the predicates reach the
parquet scan and stay inside whole-stage codegen.  Rectangles are closed and
axis-aligned; a rectangle is passed around as a :class:`Box` of four columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quadrant codes, fixed values: south-west 0, south-east 1, north-west 2, north-east 3.
SW, SE, NW, NE = 0, 1, 2, 3


class Box(NamedTuple):
    """Four columns that together describe one rectangle."""

    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax") -> "Box":
        return cls(*(_column(c) for c in (xmin, ymin, xmax, ymax)))

    @classmethod
    def of_struct(cls, column) -> "Box":
        c = _column(column)
        return cls(c["xmin"], c["ymin"], c["xmax"], c["ymax"])

    @classmethod
    def literal(cls, xmin: float, ymin: float, xmax: float, ymax: float) -> "Box":
        return cls(*(F.lit(float(v)) for v in (xmin, ymin, xmax, ymax)))


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    """A point as a struct ``(x, y)``."""
    return F.struct(_column(x).cast("double").alias("x"), _column(y).cast("double").alias("y"))


def coord(p, axis) -> Column:
    """Coordinate 0 (x) or 1 (y) of a point struct; any other axis is an error."""
    p = _column(p)
    if isinstance(axis, int):
        if axis not in (0, 1):
            raise ValueError(f"axis must be 0 or 1, not {axis}")
        return p["x"] if axis == 0 else p["y"]
    axis = _column(axis)
    return (
        F.when(axis == 0, p["x"])
        .when(axis == 1, p["y"])
        .otherwise(F.raise_error(F.lit("axis must be 0 or 1")).cast("double"))
    )


def rect(xmin, ymin, xmax, ymax) -> Column:
    """A rectangle as a struct ``(xmin, ymin, xmax, ymax)``."""
    named = zip((xmin, ymin, xmax, ymax), ("xmin", "ymin", "xmax", "ymax"))
    return F.struct(*(_column(c).cast("double").alias(name) for c, name in named))


def area(a: Box) -> Column:
    """Area, with the sides of an inverted rectangle counting as zero."""
    return F.greatest(F.lit(0.0), a.xmax - a.xmin) * F.greatest(F.lit(0.0), a.ymax - a.ymin)


def intersects(a: Box, b: Box) -> Column:
    """Closed intersection: touching edges and corners count."""
    return (a.xmin <= b.xmax) & (a.xmax >= b.xmin) & (a.ymin <= b.ymax) & (a.ymax >= b.ymin)


def contains_point(a: Box, x, y) -> Column:
    """Closed containment on all four sides."""
    return _column(x).between(a.xmin, a.xmax) & _column(y).between(a.ymin, a.ymax)


def union(a: Box, b: Box) -> Box:
    """Smallest rectangle around both; null where either side is null."""

    def pick(fn, left, right):
        # least/greatest skip nulls, which would turn a missing rectangle into the other one
        return F.when(left.isNotNull() & right.isNotNull(), fn(left, right))

    return Box(
        pick(F.least, a.xmin, b.xmin),
        pick(F.least, a.ymin, b.ymin),
        pick(F.greatest, a.xmax, b.xmax),
        pick(F.greatest, a.ymax, b.ymax),
    )


def enlargement(a: Box, b: Box) -> Column:
    """How much ``a`` must grow in area to cover ``b`` as well."""
    return area(union(a, b)) - area(a)


def center(a: Box) -> tuple[Column, Column]:
    """Center as two columns ``(x, y)``."""
    return (a.xmin + a.xmax) / F.lit(2.0), (a.ymin + a.ymax) / F.lit(2.0)


def center_distance_sq(a: Box, b: Box) -> Column:
    """Squared distance between the centers of two rectangles."""
    (ax, ay), (bx, by) = center(a), center(b)
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def is_degenerate(a: Box) -> Column:
    """True for a rectangle that is a single point."""
    return (a.xmin == a.xmax) & (a.ymin == a.ymax)


def normalized(a: Box) -> Box:
    """The same rectangle with each pair of sides in order."""
    return Box(
        F.least(a.xmin, a.xmax),
        F.least(a.ymin, a.ymax),
        F.greatest(a.xmin, a.xmax),
        F.greatest(a.ymin, a.ymax),
    )


def quadrant(x, y, a: Box) -> Column:
    """Quadrant code of a point in a box; a tie with the midline stays west / south."""
    mid_x, mid_y = center(a)
    return (_column(x) > mid_x).cast("int") + F.lit(2) * (_column(y) > mid_y).cast("int")


def subdivide(a: Box) -> Column:
    """The four child boxes as an array of structs; feed it to ``inline``."""
    mid_x, mid_y = center(a)

    def child(code, xmin, ymin, xmax, ymax):
        return F.struct(
            F.lit(code).alias("quadrant"),
            xmin.alias("xmin"),
            ymin.alias("ymin"),
            xmax.alias("xmax"),
            ymax.alias("ymax"),
        )

    return F.array(
        child(SW, a.xmin, a.ymin, mid_x, mid_y),
        child(SE, mid_x, a.ymin, a.xmax, mid_y),
        child(NW, a.xmin, mid_y, mid_x, a.ymax),
        child(NE, mid_x, mid_y, a.xmax, a.ymax),
    )
