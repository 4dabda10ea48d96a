"""Range and spatial selection over large tables, as PySpark DataFrame operators."""

from .functions.cells import Bounds
from .functions.geometry import Box
from .operators.enlargement import least_enlargement
from .operators.joins import (
    JoinTuning,
    match_key_ranges,
    match_keys,
    match_points,
    match_points_in_rects,
    match_rects,
    match_rects_at_points,
)
from .operators.kdsplit import kd_cells
from .operators.layouts import KEY, POINT, RECT, Position, fit_layout, with_cells
from .operators.lookup import KeyAt, KeyRange, PointAt, Window, key_query, point_query, rect_query
from .operators.quadleaves import quad_height, quad_leaves
from .plans.stored import StoredLayout

__all__ = [
    "KEY",
    "POINT",
    "RECT",
    "Bounds",
    "Box",
    "JoinTuning",
    "KeyAt",
    "KeyRange",
    "PointAt",
    "Position",
    "StoredLayout",
    "Window",
    "fit_layout",
    "kd_cells",
    "key_query",
    "least_enlargement",
    "match_key_ranges",
    "match_keys",
    "match_points",
    "match_points_in_rects",
    "match_rects",
    "match_rects_at_points",
    "point_query",
    "quad_height",
    "quad_leaves",
    "rect_query",
    "with_cells",
]
