"""Single-query lookups as pushed-down filters.

The predicates are plain comparisons on columns, so they appear in the scan's
``PushedFilters``; :class:`rangeframe.plans.stored.StoredLayout` adds the cell
predicate that prunes whole directories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import Box


@dataclass(frozen=True)
class KeyAt:
    """Records whose key equals ``key``."""

    key: object


@dataclass(frozen=True)
class KeyRange:
    """Records with ``low <= key <= high``; ``ordered`` sorts the answer by key, then value."""

    low: object
    high: object
    ordered: bool = False


@dataclass(frozen=True)
class PointAt:
    """A position: equal points, or rectangles around it."""

    x: float
    y: float


@dataclass(frozen=True)
class Window:
    """A closed rectangle: points inside it, or rectangles that touch it."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def box(self) -> Box:
        return Box.literal(self.xmin, self.ymin, self.xmax, self.ymax)


RECT_SIDES = ("xmin", "ymin", "xmax", "ymax")


def keys_equal(df: DataFrame, k, *, key: str = "key") -> DataFrame:
    return df.filter(F.col(key) == F.lit(k))


def keys_between(df: DataFrame, low, high, *, key: str = "key", value: str = "value", ordered: bool = False) -> DataFrame:
    hits = df.filter(F.col(key).between(F.lit(low), F.lit(high)))
    return hits.orderBy(key, value) if ordered else hits


def points_equal(df: DataFrame, px: float, py: float, *, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter((F.col(x) == F.lit(float(px))) & (F.col(y) == F.lit(float(py))))


def points_within(df: DataFrame, window: Window, *, x: str = "x", y: str = "y") -> DataFrame:
    return df.filter(g.contains_point(window.box, x, y))


def rects_around(df: DataFrame, px: float, py: float, *, sides=RECT_SIDES) -> DataFrame:
    return df.filter(g.contains_point(Box.of(*sides), F.lit(float(px)), F.lit(float(py))))


def rects_touching(df: DataFrame, window: Window, *, sides=RECT_SIDES) -> DataFrame:
    return df.filter(g.intersects(Box.of(*sides), window.box))


def key_query(df: DataFrame, query: KeyAt | KeyRange, *, key: str = "key", value: str = "value") -> DataFrame:
    """Values for a key or a key range."""
    if isinstance(query, KeyAt):
        return keys_equal(df, query.key, key=key).select(value)
    if isinstance(query, KeyRange):
        hits = keys_between(df, query.low, query.high, key=key, value=value, ordered=query.ordered)
        return hits.select(value)
    raise TypeError(f"not a key query: {query!r}")


def point_query(df: DataFrame, query: PointAt | Window, *, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Values of the points at a position or inside a window."""
    if isinstance(query, PointAt):
        return points_equal(df, query.x, query.y, x=x, y=y).select(value)
    if isinstance(query, Window):
        return points_within(df, query, x=x, y=y).select(value)
    raise TypeError(f"not a spatial query: {query!r}")


def rect_query(df: DataFrame, query: PointAt | Window, *, sides=RECT_SIDES, value: str = "value") -> DataFrame:
    """Values of the rectangles around a position or touching a window."""
    if isinstance(query, PointAt):
        return rects_around(df, query.x, query.y, sides=sides).select(value)
    if isinstance(query, Window):
        return rects_touching(df, query, sides=sides).select(value)
    raise TypeError(f"not a spatial query: {query!r}")
