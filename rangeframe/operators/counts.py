"""Hits per query without pairs.

A workload summary needs how many records answer each query, not which.  Pairs of a query and a
record are then wasted work: a range that covers a tenth of the data would make a tenth of the data's
rows.  Here the data are counted once, and queries read the counts.

* **Keys and points**: rows are counted per key or position, and queries look the count up.
* **Key ranges**: the answer is the difference of two ranks.  Counts per key and the ends of the ranges are
  sorted together; the running sum in front of an end is its rank.
* **Rectangles over points**: a summed-area table over grid cells holds, for each cell, how many
  points lie in it and in all cells to the left and below.  Four of its entries give
  the count of any block of cells, so a query's fully covered cells cost four lookups
  however many there are, and only the cells on its border compare rows.  A border cell that
  holds very many points is a grid of its own with its own table, and so on.

All steps are equi-joins, groupings and windows over bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.geometry import Box
from ..plans.runtime import cut_lineage, row_count_up_to
from .joins import DEFAULT_TUNING, JoinTuning, _QUERY_BOX, _query_boxes, _usable, join_on


@dataclass(frozen=True)
class CountTuning:
    """Sizes of the summed-area tables; none of them changes a count."""

    cell_rows: int = 16  # points per cell of the first grid, on average
    hot_rows: int = 4096  # distinct positions in a cell from which it is a grid of its own
    side: int = 32  # cells per axis of such a grid
    levels: int = 8  # grids inside each other; below the last one rows are compared
    joins: JoinTuning = DEFAULT_TUNING


DEFAULT_COUNTS = CountTuning()


def _zero_for_others(queries: DataFrame, hits: DataFrame, qid: str) -> DataFrame:
    """``(qid, n_results)`` of every query row; a query without a hit counts 0."""
    asked = queries.select(F.col(qid).alias("qid"))
    named = hits.select(F.col("qid").alias("__qid"), "n_results")
    met = asked.join(named, F.col("qid").eqNullSafe(F.col("__qid")), "left")
    return met.select("qid", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"))


# -- keys and positions -------------------------------------------------------


def _count_equal(data: DataFrame, queries: DataFrame, names: Sequence[str], asked: Sequence[str], qid: str, tuning: CountTuning) -> DataFrame:
    keys = [f"__k{i}" for i in range(len(names))]
    right = _usable(queries.select(F.col(qid).alias("qid"), *(F.col(a).alias(k) for a, k in zip(asked, keys))), keys)
    per_key = data.groupBy(*(F.col(n).alias(k) for n, k in zip(names, keys))).agg(F.count(F.lit(1)).alias("n"))
    small = row_count_up_to(right, tuning.joins.broadcast_rows) <= tuning.joins.broadcast_rows
    met = join_on(per_key, right, keys, small=small, tuning=tuning.joins, counts=None if small else per_key.withColumn("__n", F.lit(1)))
    return met.groupBy("qid").agg(F.sum("n").alias("n_results"))


def key_hits(data: DataFrame, queries: DataFrame, *, key: str = "key", qid: str = "qid", k: str = "k", tuning: CountTuning = DEFAULT_COUNTS) -> DataFrame:
    """``(qid, n_results)`` of queries for a key that have a hit."""
    return _count_equal(data, queries, [key], [k], qid, tuning)


def point_hits(
    data: DataFrame, queries: DataFrame, *, x: str = "x", y: str = "y", qid: str = "qid", px: str = "px", py: str = "py",
    tuning: CountTuning = DEFAULT_COUNTS,
) -> DataFrame:
    """``(qid, n_results)`` of queries for a position that have a hit."""
    return _count_equal(data, queries, [x, y], [px, py], qid, tuning)


# -- key ranges ---------------------------------------------------------------


def key_range_hits(
    data: DataFrame, queries: DataFrame, *, key: str = "key", qid: str = "qid", low: str = "low", high: str = "high"
) -> DataFrame:
    """``(qid, n_results)`` of key ranges that have a hit; keys of any type that has an order.

    Sorted by key, each key's rows stand between the lower ends equal to it and the upper ones.  Sorting
    is a range shuffle; sums of whole partitions and running sums inside them give the ranks.
    """
    bounds = _usable(queries.select(F.col(qid).alias("qid"), F.col(low).alias("lo"), F.col(high).alias("hi")), ["lo", "hi"])
    ends = bounds.filter("lo <= hi").select(
        "qid", F.explode(F.array(F.struct(F.col("lo").alias("key"), F.lit(0).alias("place")), F.struct(F.col("hi").alias("key"), F.lit(2).alias("place")))).alias("end")
    )
    none = F.lit(None).cast(ends.schema["qid"].dataType)
    per_key = _usable(data.select(F.col(key).alias("key")), ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = per_key.select("key", F.lit(1).alias("place"), none.alias("qid"), "n").union(
        ends.select("end.key", "end.place", "qid", F.lit(0).cast("bigint").alias("n"))
    )
    # equal ends are many where queries repeat: the qid spreads them, and their order does not matter
    sorted_ = cut_lineage(rows.repartitionByRange("key", "place", "qid").withColumn("part", F.spark_partition_id()))
    sizes = sorted_.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("key", "place").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sorted_.withColumn("inside", inside).filter("place <> 1").join(F.broadcast(offsets), "part")
    signed = F.when(F.col("place") == 2, F.col("before") + F.col("inside")).otherwise(-(F.col("before") + F.col("inside")))
    return ranked.groupBy("qid").agg(F.sum(signed).alias("n_results")).filter("n_results > 0")


# -- rectangles over points ---------------------------------------------------


def _index(v: Column, low: Column, high: Column, side: Column) -> Column:
    """Cell of a position on an axis of ``side`` cells; it never falls as the position rises."""
    width = F.when((high - low) / side > 0, (high - low) / side).otherwise(F.lit(1.0))
    raw = (v.cast("double") - low) / width
    return F.floor(F.least(F.greatest(raw, F.lit(0.0)), side.cast("double") - 1.0)).cast("int")


_GRID = ("node", "__x0", "__y0", "__x1", "__y1", "__gx", "__gy")


def _placed(points: DataFrame) -> DataFrame:
    """Points of nodes with their cell ``(i, j)``."""
    i = _index(F.col("__x"), F.col("__x0"), F.col("__x1"), F.col("__gx"))
    j = _index(F.col("__y"), F.col("__y0"), F.col("__y1"), F.col("__gy"))
    return points.select("node", "__x", "__y", "n", i.alias("i"), j.alias("j"))


def _summed_area(cells: DataFrame, dense: DataFrame) -> DataFrame:
    """``(node, i, j, upto)``: points in cells ``(0..i, 0..j)`` of a node, for all its cells."""
    keys = ["node", "i", "j"]
    filled = dense.join(cells.select(*keys, "n"), keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    upto = Window.rowsBetween(Window.unboundedPreceding, 0)
    across = filled.withColumn("n", F.sum("n").over(upto.partitionBy("node", "i").orderBy("j")))
    return across.select(*keys, F.sum("n").over(upto.partitionBy("node", "j").orderBy("i")).alias("upto"))


def _block_sums(frontier: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``(qid, n)``: points in the fully covered cells of queries, by four entries of the table."""
    wide = frontier.filter("i1 - i0 > 1 AND j1 - j0 > 1")
    corners = [("i1 - 1", "j1 - 1", 1), ("i0", "j1 - 1", -1), ("i1 - 1", "j0", -1), ("i0", "j0", 1)]
    listed = F.array(*(F.struct(F.expr(i).alias("i"), F.expr(j).alias("j"), F.lit(s).alias("sign")) for i, j, s in corners))
    asked = wide.select("qid", "node", F.explode(listed).alias("c")).select("qid", "node", "c.i", "c.j", "c.sign")
    met = asked.join(F.broadcast(table) if small else table, ["node", "i", "j"])
    return met.groupBy("qid").agg(F.sum(F.col("sign") * F.col("upto")).alias("n"))


def _border(frontier: DataFrame) -> DataFrame:
    """One row for each cell on a query's border."""
    rows = frontier.select("*", F.explode(F.sequence("i0", "i1")).alias("i"))
    ends = F.array_distinct(F.array("j0", "j1"))
    inner = (F.col("i") > F.col("i0")) & (F.col("i") < F.col("i1"))
    return rows.select("qid", *_QUERY_BOX, "node", "i", F.explode(F.when(inner, ends).otherwise(F.sequence("j0", "j1"))).alias("j"))


def rect_hits(
    data: DataFrame,
    queries: DataFrame,
    *,
    x: str = "x",
    y: str = "y",
    qid: str = "qid",
    sides: Sequence[str] = ("qxmin", "qymin", "qxmax", "qymax"),
    tuning: CountTuning = DEFAULT_COUNTS,
) -> DataFrame:
    """``(qid, n_results)`` of rectangles that hold points; inverted rectangles hold none.

    Cells compare by their number alone: numbers never fall as positions rise, so a cell whose
    number lies strictly between those of a query's ends is covered in full.
    """
    points = _usable(data.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.lit(1).cast("bigint").alias("n")), ["__x", "__y"])
    box = Box.of(*_QUERY_BOX)
    asked = _usable(_query_boxes(queries, qid, sides), _QUERY_BOX).filter((box.xmin <= box.xmax) & (box.ymin <= box.ymax))
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    ends = [f(finite(c)).alias(n) for c, f, n in (("__x", F.min, "x0"), ("__y", F.min, "y0"), ("__x", F.max, "x1"), ("__y", F.max, "y1"))]
    size = points.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    side = max(1, round((size["n"] / tuning.cell_rows) ** 0.5))
    first = [F.lit(""), *(F.lit(float(size[n] or 0.0)) for n in ("x0", "y0", "x1", "y1")), F.lit(side), F.lit(side)]
    grid = [c.alias(n) for c, n in zip(first, _GRID)]
    nodes, frontier = None, asked.select("qid", *_QUERY_BOX, *grid)
    points = points.select("*", *grid)
    found = []
    for level in range(tuning.levels):
        placed = _placed(points)
        per_cell = placed.groupBy("node", "i", "j").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        cells = cut_lineage(per_cell)
        if nodes is None:
            whole = data.sparkSession.range(side * side)
            dense = whole.select(F.lit("").alias("node"), F.floor(F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
            few = side * side <= tuning.joins.broadcast_rows
        else:
            spread = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(tuning.side - 1))).alias("i"))
            dense = spread.select("node", "i", F.explode(F.sequence(F.lit(0), F.lit(tuning.side - 1))).alias("j"))
            few = row_count_up_to(nodes, tuning.joins.broadcast_rows // tuning.side**2) <= tuning.joins.broadcast_rows // tuning.side**2
        spans = [
            _index(F.col(q), F.col(a), F.col(b), F.col(s)).alias(n)
            for q, a, b, s, n in (
                ("__qxmin", "__x0", "__x1", "__gx", "i0"), ("__qxmax", "__x0", "__x1", "__gx", "i1"),
                ("__qymin", "__y0", "__y1", "__gy", "j0"), ("__qymax", "__y0", "__y1", "__gy", "j1"),
            )
        ]
        frontier = frontier.select("qid", *_QUERY_BOX, "node", *spans)
        found.append(_block_sums(frontier, _summed_area(cells, dense), few))
        border = _border(frontier)
        hot = cells.filter(F.col("rows") > tuning.hot_rows)
        last = level == tuning.levels - 1 or hot.isEmpty()
        if not last:
            # a hot cell is the next grid; its own bounds come from its points, so each level narrows
            hot = hot.select("node", "i", "j", F.concat_ws("/", "node", "i", "j").alias("next"))
            met = placed.join(hot, ["node", "i", "j"]).groupBy(F.col("next").alias("node"), "__x", "__y").agg(F.sum("n").alias("n"))
            inside = cut_lineage(met)
            ends = [f(finite(c)).alias(n) for c, f, n in (("__x", F.min, "__x0"), ("__y", F.min, "__y0"), ("__x", F.max, "__x1"), ("__y", F.max, "__y1"))]
            g_ = [F.lit(tuning.side).alias("__gx"), F.lit(tuning.side).alias("__gy")]
            bounds = inside.groupBy("node").agg(*ends).select("node", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in _GRID[1:5]), *g_)
            nodes = cut_lineage(bounds)
            entered = border.join(hot, ["node", "i", "j"]).select("qid", *_QUERY_BOX, F.col("next").alias("node"))
            following = cut_lineage(entered.join(nodes, "node"))
            border = border.join(hot, ["node", "i", "j"], "left_anti")
            placed = placed.join(hot, ["node", "i", "j"], "left_anti")
        small = row_count_up_to(border, tuning.joins.broadcast_rows) <= tuning.joins.broadcast_rows
        counts = None if small else cells.select("node", "i", "j", F.col("rows").alias("__n"))
        compared = join_on(placed, border, ["node", "i", "j"], small=small, tuning=tuning.joins, counts=counts)
        found.append(compared.filter(g.contains_point(box, "__x", "__y")).groupBy("qid").agg(F.sum("n").alias("n")))
        if last:
            break
        points, frontier = inside.join(nodes, "node"), following
    every = reduce(DataFrame.union, found)
    return every.groupBy("qid").agg(F.sum("n").alias("n_results")).filter("n_results > 0")


def hits_per_query(data: DataFrame, queries: DataFrame, hits=rect_hits, *, qid: str = "qid", **options) -> DataFrame:
    """``(qid, n_results)`` of every query row, counted by one of the functions above."""
    return _zero_for_others(queries, hits(data, queries, qid=qid, **options), qid)
