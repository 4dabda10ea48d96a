"""Partition directories and routing.

A directory has one row per cell, so it stays small whatever the data size; it is
a plain aggregate with map-side combine.  Routing is a join of a query table with
the directory: by cell id for keys, by bounding rectangle for space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import Bounds
from ..plans.runtime import cut_lineage
from . import joins

RECT_SIDES = ("xmin", "ymin", "xmax", "ymax")


# -- extents ------------------------------------------------------------------


def key_bounds(df: DataFrame, *, key: str = "key") -> DataFrame:
    """One row ``(min_key, max_key, n_items)``; nulls and zero for an empty table."""
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(key).alias("n_items"))


def extreme_keys(df: DataFrame, *, key: str = "key") -> DataFrame:
    """One row with the smallest and the largest key."""
    return df.agg(F.min(key).alias("leftmost_key"), F.max(key).alias("rightmost_key"))


def _mbr_aggregates(sides) -> list[Column]:
    xmin, ymin, xmax, ymax = sides
    return [
        F.count(F.lit(1)).alias("n_items"),
        F.min(xmin).alias("xmin"),
        F.min(ymin).alias("ymin"),
        F.max(xmax).alias("xmax"),
        F.max(ymax).alias("ymax"),
    ]


def point_bounds(df: DataFrame, *, x: str = "x", y: str = "y") -> DataFrame:
    """One row ``(n_items, xmin, ymin, xmax, ymax)`` around all points."""
    return df.agg(*_mbr_aggregates((x, y, x, y)))


def rect_bounds(df: DataFrame, *, sides=RECT_SIDES) -> DataFrame:
    """One row ``(n_items, xmin, ymin, xmax, ymax)`` around all rectangles."""
    return df.agg(*_mbr_aggregates(sides))


def read_bounds(bounds: DataFrame) -> Bounds:
    """A one-row extent as numbers; an empty table counts as the origin."""
    row = bounds.first()
    return Bounds(*(float(row[s]) if row[s] is not None else 0.0 for s in RECT_SIDES))


# -- directories --------------------------------------------------------------


def _with_empty_cells(directory: DataFrame, n_cells: int | None) -> DataFrame:
    if n_cells is None:
        return directory
    every = directory.sparkSession.range(n_cells).select(
        F.col("id").cast("int").alias("cell"), F.lit(0).cast("bigint").alias("n_items")
    )
    return merge_directories(directory.unionByName(every, allowMissingColumns=True))


def key_directory(df: DataFrame, *, key: str = "key", cell: str = "cell", n_cells: int | None = None) -> DataFrame:
    """``(cell, n_items, min_key, max_key)``; with ``n_cells`` the empty cells are listed too."""
    grouped = df.groupBy(F.col(cell).alias("cell")).agg(
        F.count(F.lit(1)).alias("n_items"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    )
    return _with_empty_cells(grouped, n_cells)


def mbr_directory(
    df: DataFrame, *, sides=RECT_SIDES, cell: str = "cell", n_cells: int | None = None
) -> DataFrame:
    """``(cell, n_items, xmin, ymin, xmax, ymax)``; for points pass ``("x", "y", "x", "y")``.

    The rectangle bounds the data, not the cell: a record may stick out of its cell.
    """
    grouped = df.groupBy(F.col(cell).alias("cell")).agg(*_mbr_aggregates(sides))
    return _with_empty_cells(grouped, n_cells)


def merge_directories(parts: DataFrame) -> DataFrame:
    """Combine partial directories (one row per cell and part) into one."""
    if "min_key" in parts.columns:
        return parts.groupBy("cell").agg(
            F.sum("n_items").alias("n_items"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")
        )
    return parts.groupBy("cell").agg(
        F.sum("n_items").alias("n_items"),
        F.min("xmin").alias("xmin"),
        F.min("ymin").alias("ymin"),
        F.max("xmax").alias("xmax"),
        F.max("ymax").alias("ymax"),
    )


def separators(directory: DataFrame) -> DataFrame:
    """``(cell, separator)``: first key of every non-empty chunk but chunk 0.

    The cell stays next to its key, so an empty chunk in between shifts nothing.
    """
    kept = directory.filter((F.col("n_items") > 0) & (F.col("cell") > 0))
    return kept.select("cell", F.col("min_key").alias("separator"))


# -- routing ------------------------------------------------------------------


def route_keys(queries: DataFrame, chunk: Column, *, qid: str = "qid") -> DataFrame:
    """``(qid, cell)``: the one chunk that can hold each key; a projection, no join."""
    return queries.select(F.col(qid).alias("qid"), chunk.alias("cell"))


def _occupied(directory: DataFrame) -> DataFrame:
    return directory.filter(F.col("n_items") > 0)


def _as_asked(directory: DataFrame, sides) -> DataFrame:
    """The occupied cells as the small side of a batch join, computed once.

    The directory is measured, expanded and broadcast; the queries stream past
    it, so their number does not matter.
    """
    picked = _occupied(directory).select(F.col("cell").alias("qid"), *(F.col(s).alias(f"q{n}") for s, n in zip(sides, RECT_SIDES)))
    return cut_lineage(picked)


def route_key_ranges(
    queries: DataFrame, directory: DataFrame, *, qid: str = "qid", low: str = "low", high: str = "high"
) -> DataFrame:
    """``(qid, cell)``: the chunks whose key interval meets each range.

    Key intervals and ranges are boxes of height zero, so this is the overlap join.
    """
    flat = directory.withColumn("__flat", F.lit(0))
    chunks = _as_asked(flat, ("min_key", "__flat", "max_key", "__flat"))
    ranges = queries.filter(F.col(low) <= F.col(high)).select(
        F.col(qid).alias("value"), F.col(low).alias("xmin"), F.lit(0).alias("ymin"),
        F.col(high).alias("xmax"), F.lit(0).alias("ymax"),
    )
    return joins.match_rects(ranges, chunks).select(F.col("value").alias("qid"), F.col("qid").alias("cell"))


def route_points(
    queries: DataFrame, directory: DataFrame, *, qid: str = "qid", px: str = "px", py: str = "py"
) -> DataFrame:
    """``(qid, cell)``: the cells whose bounding rectangle contains each point."""
    met = joins.match_points_in_rects(queries, _as_asked(directory, RECT_SIDES), x=px, y=py, value=qid)
    return met.select(F.col("value").alias("qid"), F.col("qid").alias("cell"))


def route_rects(
    queries: DataFrame,
    directory: DataFrame,
    *,
    qid: str = "qid",
    sides=("qxmin", "qymin", "qxmax", "qymax"),
) -> DataFrame:
    """``(qid, cell)``: the cells whose bounding rectangle meets each rectangle."""
    met = joins.match_rects(queries, _as_asked(directory, RECT_SIDES), value=qid, sides=sides)
    return met.select(F.col("value").alias("qid"), F.col("qid").alias("cell"))


# -- shape --------------------------------------------------------------------


def item_count(directory: DataFrame) -> DataFrame:
    """One row ``(n_items)`` without touching the data."""
    return directory.agg(F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("n_items"))


def pruning(directory: DataFrame, routed: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: cell skew, and how much of the layout a workload has to touch.

    ``avg_cells`` and ``avg_rows`` are per query, queries without a candidate
    counting as zero; the shares relate them to all occupied cells and all rows.
    """
    shape = _occupied(directory).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n_items").alias("n_rows"), F.max("n_items").alias("largest_cell")
    )
    # queries are counted per cell first, so the join is between two cell-sized tables
    per_cell = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    touched = per_cell.join(directory.select("cell", "n_items"), "cell").agg(
        F.struct(
            F.coalesce(F.sum("asks"), F.lit(0)).alias("cells"),
            F.coalesce(F.sum(F.col("asks") * F.col("n_items")), F.lit(0)).alias("rows"),
        ).alias("touched")
    )
    asked = queries.agg(F.count(F.lit(1)).alias("num_queries"))
    row = shape.select("*", touched.scalar().alias("touched"), asked.scalar().alias("num_queries"))
    n_queries = F.col("num_queries").cast("double")
    per_query = F.when(n_queries > 0, F.col("touched.cells") / n_queries).otherwise(F.lit(0.0))
    rows_per_query = F.when(n_queries > 0, F.col("touched.rows") / n_queries).otherwise(F.lit(0.0))
    return row.select(
        "n_cells",
        "n_rows",
        "largest_cell",
        (F.col("largest_cell") * F.col("n_cells") / F.col("n_rows")).alias("skew"),
        "num_queries",
        per_query.alias("avg_cells"),
        rows_per_query.alias("avg_rows"),
        (per_query / F.col("n_cells")).alias("cell_share"),
        (rows_per_query / F.col("n_rows")).alias("row_share"),
    )
