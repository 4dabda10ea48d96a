"""Adaptive quadtree leaves from counts.

A box splits while it holds more than ``capacity`` points, is above the depth
limit and is not a single point.  Whether a box splits depends on its count
alone, so the leaves follow from counts per quadrant prefix, without building a
tree and in any order of the points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MAX_QUAD_DEPTH, Bounds, with_quad_path
from ..plans.runtime import broadcast_if_small, cut_lineage
from .directory import point_bounds, read_bounds

LEVELS_PER_PASS = 8
BROADCAST_CELLS = 500_000


def _path_counts(df: DataFrame, x: str, y: str, bounds: Bounds, max_depth: int) -> DataFrame:
    """``(path, stop, n_items)`` per deepest path; identical points fold into one row.

    ``stop`` is the level at which the box around the path is a single point.
    """
    coded = with_quad_path(
        df.select(F.col(x).alias("__x"), F.col(y).alias("__y")),
        F.col("__x"),
        F.col("__y"),
        bounds,
        max_depth,
        path="path",
        point_level="stop",
    )
    stop = F.coalesce("stop", F.lit(max_depth)).alias("stop")
    return coded.groupBy("path", stop).agg(F.count(F.lit(1)).alias("n_items"))


def _prefix(level: Column | int, max_depth: int) -> Column:
    shift = F.lit(2) * (F.lit(max_depth) - level)
    return F.call_function("shiftright", F.col("path"), shift.cast("int"))


def _leaves_between(folded: DataFrame, top: int, bottom: int, capacity: int, max_depth: int) -> DataFrame:
    """Leaves on levels ``top + 1 .. bottom``, and on level 0 where ``top`` is 0.

    ``folded`` has one row per occupied box of level ``bottom``.  Two shuffles whatever the number of levels: boxes of all levels are counted
    together, then grouped under their parents, at most four to each.
    """

    def splits(box: str = "") -> Column:
        n, stop, level = (F.col(f"{box}{c}") for c in ("n_items", "stop", "level"))
        return (n > capacity) & (stop > level) & (level < max_depth)

    first = top if top == 0 and bottom == 0 else top + 1
    levels = F.explode(F.sequence(F.lit(first), F.lit(bottom))).alias("level")
    boxes = (
        folded.select("path", "stop", "n_items", levels)
        .select("level", _prefix(F.col("level"), bottom).alias("path"), "stop", "n_items")
        .groupBy("level", "path")
        .agg(F.sum("n_items").alias("n_items"), F.min("stop").alias("stop"))
    )
    if bottom == 0:
        return boxes.select("level", "path", "n_items")
    parents = boxes.groupBy(
        (F.col("level") - 1).alias("parent_level"), F.shiftright(F.col("path"), 2).alias("parent_path")
    ).agg(
        F.sum("n_items").alias("parent_n_items"),
        F.min("stop").alias("parent_stop"),
        F.collect_list(F.struct("level", "path", "n_items", "stop")).alias("children"),
    )
    root = F.array(
        F.struct(
            F.col("parent_level").alias("level"),
            F.col("parent_path").alias("path"),
            F.col("parent_n_items").alias("n_items"),
            F.col("parent_stop").alias("stop"),
        )
    )
    # only the root has no parent of its own to ask; any other box speaks through its parent
    chosen = F.when(splits("parent_"), F.col("children")).when(F.col("parent_level") == 0, root)
    return parents.select(F.inline(chosen)).filter(~splits()).select("level", "path", "n_items")


def quad_leaves(
    df: DataFrame,
    *,
    capacity: int,
    max_depth: int,
    x: str = "x",
    y: str = "y",
    bounds: Bounds | None = None,
) -> DataFrame:
    """``(level, path, n_items)`` of every non-empty leaf.

    Up to ``LEVELS_PER_PASS`` levels are one plan.  Deeper trees take several
    passes, and only points of boxes that are still too full go on to the next.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if not 0 <= max_depth <= MAX_QUAD_DEPTH:
        raise ValueError(f"max_depth must be in [0, {MAX_QUAD_DEPTH}]")
    bounds = bounds or read_bounds(point_bounds(df, x=x, y=y))
    codes = _path_counts(df, x, y, bounds, max_depth)
    if max_depth > LEVELS_PER_PASS:
        codes = cut_lineage(codes)
    leaves: list[DataFrame] = []
    top = 0
    while True:
        bottom = min(max_depth, top + LEVELS_PER_PASS)
        above = _prefix(bottom, max_depth)
        if bottom < max_depth:  # few boxes of this pass stand for many paths: fold before levels are spread out
            folded = codes.groupBy(above.alias("path")).agg(F.sum("n_items").alias("n_items"), F.min("stop").alias("stop"))
            folded = cut_lineage(folded)
        else:
            folded = codes
        leaves.append(_leaves_between(folded, top, bottom, capacity, max_depth))
        if bottom == max_depth:
            break
        full = cut_lineage(
            folded.filter((F.col("n_items") > capacity) & (F.col("stop") > bottom)).select(F.col("path").alias("full_path"))
        )
        if full.isEmpty():
            break
        codes = codes.join(broadcast_if_small(full, BROADCAST_CELLS), above == F.col("full_path"), "left_semi")
        top = bottom
    return reduce(DataFrame.unionByName, leaves)


def quad_height(leaves: DataFrame) -> DataFrame:
    """One row ``(height)``: levels of the tree with these leaves, 0 without points."""
    return leaves.agg(F.coalesce(F.max("level") + 1, F.lit(0)).cast("int").alias("height"))
