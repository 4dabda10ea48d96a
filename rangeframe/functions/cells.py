"""Cell ids: key chunks, uniform grids and quadtree paths.

One expression serves data and queries alike, with the bounds baked in as
literals, so both sides of a lookup always agree bit for bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_QUAD_DEPTH = 31  # two bits per level must fit a BIGINT


@dataclass(frozen=True)
class Bounds:
    """Plain numbers for a data set's extent."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def is_point(self) -> bool:
        return self.xmin == self.xmax and self.ymin == self.ymax


def integer_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


# -- key chunks ---------------------------------------------------------------


def chunk_width(min_key: int, max_key: int, n_chunks: int) -> int:
    """Width of ``n_chunks`` equal key intervals, at least 1."""
    if n_chunks < 1:
        raise ValueError("n_chunks must be at least 1")
    return max(1, -((min_key - max_key - 1) // n_chunks))


def key_chunk(key: Column, min_key: int, width: int, n_chunks: int) -> Column:
    """Chunk id of a key; keys outside the known bounds go to the edge chunks."""
    first, last = min_key, min(min_key + width * n_chunks - 1, 2**63 - 1)
    # clamped before the subtraction: a far key must not overflow it
    inside = F.least(F.greatest(key.cast("bigint"), F.lit(first).cast("bigint")), F.lit(last).cast("bigint"))
    if last - first < 2**63:
        raw = integer_div(inside - F.lit(first).cast("bigint"), F.lit(width).cast("bigint"))
    else:
        raw = F.floor((inside.cast("decimal(20,0)") - F.lit(first).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
    return F.least(raw.cast("bigint"), F.lit(n_chunks - 1).cast("bigint")).cast("int")


# -- uniform grid -------------------------------------------------------------


def grid_dimensions(n_cells: int) -> tuple[int, int]:
    """``(rows, cols)`` of a near-square grid with at least ``n_cells`` cells."""
    cols = max(1, math.isqrt(n_cells - 1) + 1) if n_cells > 0 else 1
    return max(1, -(-n_cells // cols)), cols


def cell_sides(bounds: Bounds, rows: int, cols: int, min_cell: float = 1.0) -> tuple[float, float]:
    """Cell width and height; neither drops below ``min_cell`` data units."""
    width = max(bounds.xmax - bounds.xmin, min_cell)
    height = max(bounds.ymax - bounds.ymin, min_cell)
    return max(width / cols, min_cell), max(height / rows, min_cell)


def grid_cell(
    x: Column,
    y: Column,
    bounds: Bounds,
    rows: int,
    cols: int,
    clamp_to: int | None = None,
    min_cell: float = 1.0,
) -> Column:
    """Row-major cell id of a position; positions off the grid go to its edge.

    ``clamp_to=n`` folds every id from ``n`` on into ``n - 1``.  It is off by
    default because it makes the last cell several times larger than the others.
    """
    width, height = cell_sides(bounds, rows, cols, min_cell)

    def index(v: Column, start: float, side: float, n: int) -> Column:
        # clamp before the cast: a far-away position must not overflow the integer
        raw = (v - F.lit(start)) / F.lit(side)
        return F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(n - 1)))).cast("int")

    cell = index(y, bounds.ymin, height, rows) * F.lit(cols) + index(x, bounds.xmin, width, cols)
    return cell if clamp_to is None else F.least(cell, F.lit(clamp_to - 1))


# -- quadtree cells -----------------------------------------------------------


def quad_depth(n_cells: int) -> int:
    """Smallest depth whose 4**depth cells are at least ``n_cells``."""
    return ((n_cells - 1).bit_length() + 1) // 2 if n_cells > 1 else 0


def with_quad_path(
    df: DataFrame,
    x: Column,
    y: Column,
    bounds: Bounds,
    depth: int,
    path: str = "quad_path",
    point_level: str | None = None,
) -> DataFrame:
    """Add the base-4 quadrant path of each position down to ``depth``.

    The midpoints are halved exactly as a quadtree does it, one projection per
    level, so ties fall on the same side.  With ``point_level`` the level at which
    the box has shrunk to a single point is added (null if it never does).
    """
    if not 0 <= depth <= MAX_QUAD_DEPTH:
        raise ValueError(f"depth must be in [0, {MAX_QUAD_DEPTH}]")
    keep = [F.col(f"`{c}`") for c in df.columns]
    # an axis on which all data agree never splits, so it needs no midpoints
    axes = [
        _AxisDescent("x", x, bounds.xmin, bounds.xmax, 1),
        _AxisDescent("y", y, bounds.ymin, bounds.ymax, 2),
    ]
    axes = [axis for axis in axes if axis.low < axis.high]
    state = df.select(
        *keep,
        *(c for axis in axes for c in axis.start()),
        F.lit(0).cast("bigint").alias("__path"),
        F.lit(0 if bounds.is_point else None).cast("int").alias("__stop"),
    )
    for level in range(1, depth + 1):
        # two projections per level keep each midpoint a single expression
        state = state.select("*", *(axis.middle() for axis in axes))
        digit = F.lit(0)
        for axis in axes:
            digit = digit + axis.above.cast("int") * axis.weight
        state = state.select(
            *keep,
            *(c for axis in axes for c in axis.halved()),
            (F.col("__path") * 4 + digit).alias("__path"),
            "__stop",
        )
        if point_level is not None and axes:
            shrunk = axes[0].shrunk if len(axes) == 1 else axes[0].shrunk & axes[1].shrunk
            state = state.withColumn("__stop", F.coalesce("__stop", F.when(shrunk, F.lit(level))))
    extra = [] if point_level is None else [F.col("__stop").alias(point_level)]
    return state.select(*keep, F.col("__path").alias(path), *extra)


@dataclass(frozen=True)
class _AxisDescent:
    """Column names and steps of one axis of the quadtree descent."""

    name: str
    position: Column
    low: float
    high: float
    weight: int

    def _c(self, what: str) -> str:
        return f"__{what}_{self.name}"

    def start(self) -> list[Column]:
        return [
            self.position.cast("double").alias(self._c("at")),
            F.lit(self.low).alias(self._c("low")),
            F.lit(self.high).alias(self._c("high")),
        ]

    def middle(self) -> Column:
        return ((F.col(self._c("low")) + F.col(self._c("high"))) / 2.0).alias(self._c("mid"))

    @property
    def above(self) -> Column:
        return F.col(self._c("at")) > F.col(self._c("mid"))

    @property
    def shrunk(self) -> Column:
        return F.col(self._c("low")) == F.col(self._c("high"))

    def halved(self) -> list[Column]:
        low, mid, high = (F.col(self._c(w)) for w in ("low", "mid", "high"))
        return [
            F.col(self._c("at")),
            F.when(self.above, mid).otherwise(low).alias(self._c("low")),
            F.when(self.above, high).otherwise(mid).alias(self._c("high")),
        ]
