"""Median-split (KD) cells.

A node with ``n`` records splits at rank ``n div 2`` of its records, ordered by x
on even levels and by y on odd ones, ties broken by the record's value.  Node
sizes follow from ``n`` alone; only the pivots have to be found.

Small nodes are ranked by a window per node.  A node too large for that is never
sorted: its pivot is found by repeated narrowing.  Two approximate quantiles
around the wanted rank cut the open interval in five, exact counts tell in which
part the rank lies, and each round leaves a small fraction of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.runtime import cut_lineage

WINDOW_ROWS = 1_000_000
MAX_KD_DEPTH = 40  # heap numbers stay far inside BIGINT
LEVELS_PER_CUT = 4
QUANTILE_ACCURACY = 10_000
MARKS_PER_UNIT = 100_000
MOST_MARKS = 256
ROOT = 1  # heap numbering: the children of node i are 2i and 2i + 1


def _split(n: int, keep_pivot: bool) -> tuple[int, int]:
    left = n // 2
    return left, n - left - 1 if keep_pivot else n - left


def node_sizes(n_items: int, depth: int, capacity: int, keep_pivot: bool) -> list[dict[int, int]]:
    """Per level, the records of each node that splits there."""
    splitting: list[dict[int, int]] = []
    current = {ROOT: n_items}
    for _ in range(depth):
        level = {node: n for node, n in current.items() if n > capacity}
        splitting.append(level)
        current = {}
        for node, n in level.items():
            current[2 * node], current[2 * node + 1] = _split(n, keep_pivot)
    return splitting


# -- exact selection ----------------------------------------------------------


@dataclass
class _Search:
    """Where a node's wanted element still may be: an open interval and its rank inside."""

    rank: int
    n: int
    low: object = None
    high: object = None
    found: object = None
    rank_in_ties: int = 0


def _typed(spark, rows: list[tuple], schema: T.StructType) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _inside(v: Column) -> Column:
    return (F.col("__low").isNull() | (v > F.col("__low"))) & (F.col("__high").isNull() | (v < F.col("__high")))


def select_ranks(
    df: DataFrame, node: str, column: str, wanted: dict[int, tuple[int, int]], window_rows: int
) -> dict[int, tuple[object, int]]:
    """For each node, the element of a rank and that rank's place among equal elements.

    ``wanted`` maps a node to ``(rank, rows of the node)``.  Only one small row per
    node ever reaches the driver.
    """
    spark = df.sparkSession
    dtype = df.schema[column].dataType
    state_schema = T.StructType(
        [
            T.StructField(node, T.LongType()),
            T.StructField("__low", dtype),
            T.StructField("__high", dtype),
            T.StructField("__rank", T.LongType()),
        ]
    )
    searches = {key: _Search(rank, n) for key, (rank, n) in wanted.items()}
    v = F.col(column)

    def open_rows(keys) -> DataFrame:
        rows = [(k, searches[k].low, searches[k].high, searches[k].rank) for k in keys]
        return df.join(_typed(spark, rows, state_schema), node).filter(_inside(v))

    while True:
        large = [k for k, s in searches.items() if s.found is None and s.n > window_rows]
        if not large:
            break
        probes = {}
        active = open_rows(large)
        at = {k: (searches[k].rank + 0.5) / searches[k].n for k in large}
        step = 2.0 / QUANTILE_ACCURACY
        # rounded outwards, the marks of nodes split in the middle fall together
        lower = {k: max(0.0, math.floor((p - step) * MARKS_PER_UNIT) / MARKS_PER_UNIT) for k, p in at.items()}
        upper = {k: min(1.0, math.ceil((p + step) * MARKS_PER_UNIT) / MARKS_PER_UNIT) for k, p in at.items()}
        marks = sorted({*lower.values(), *upper.values()})
        if len(marks) > MOST_MARKS:
            marks = [i / MOST_MARKS for i in range(MOST_MARKS + 1)]
        quantiles = active.groupBy(node).agg(F.percentile_approx(v, marks, QUANTILE_ACCURACY).alias("q"))
        for row in quantiles.collect():
            key = row[node]
            below = [q for m, q in zip(marks, row["q"]) if m <= lower[key]]
            above = [q for m, q in zip(marks, row["q"]) if m >= upper[key]]
            probes[row[node]] = (below[-1] if below else row["q"][0], above[0] if above else row["q"][-1])
        probe_schema = T.StructType(
            [T.StructField(node, T.LongType()), T.StructField("__a", dtype), T.StructField("__b", dtype)]
        )
        probe_rows = _typed(spark, [(k, *p) for k, p in probes.items()], probe_schema)
        a, b = F.col("__a"), F.col("__b")

        def counted(condition: Column, name: str) -> Column:
            return F.count(F.when(condition, F.lit(1))).alias(name)

        counts = (
            active.join(probe_rows, node)
            .groupBy(node)
            .agg(
                counted(v < a, "under"),
                counted(v == a, "at_a"),
                counted((v > a) & (v < b), "between"),
                counted((v == b) & (b > a), "at_b"),
                counted(v > b, "over"),
            )
        )
        for row in counts.collect():
            s = searches[row[node]]
            low_probe, high_probe = probes[row[node]]
            rank = s.rank
            if rank < row["under"]:
                s.high, s.n = low_probe, row["under"]
                continue
            rank -= row["under"]
            if rank < row["at_a"]:
                s.found, s.rank_in_ties = low_probe, rank
                continue
            rank -= row["at_a"]
            if rank < row["between"]:
                s.low, s.high, s.rank, s.n = low_probe, high_probe, rank, row["between"]
                continue
            rank -= row["between"]
            if rank < row["at_b"]:
                s.found, s.rank_in_ties = high_probe, rank
                continue
            s.low, s.rank, s.n = high_probe, rank - row["at_b"], row["over"]

    small = [k for k, s in searches.items() if s.found is None]
    if small:
        ordered = Window.partitionBy(node).orderBy(v)
        ranked = open_rows(small).select(
            node,
            v.alias("found"),
            "__rank",
            (F.row_number().over(ordered) - 1).alias("place"),
            (F.rank().over(ordered) - 1).alias("first_place"),
        )
        for row in ranked.filter(F.col("place") == F.col("__rank")).collect():
            s = searches[row[node]]
            s.found, s.rank_in_ties = row["found"], row["place"] - row["first_place"]
    return {k: (s.found, s.rank_in_ties) for k, s in searches.items()}


def _pivots_by_selection(
    df: DataFrame, axis: str, value: str, sizes: dict[int, int], window_rows: int
) -> list[tuple[int, float, object]]:
    """``(node, pivot coordinate, pivot value)`` of each node: first by coordinate, then among its ties."""
    by_coordinate = select_ranks(df, "node", axis, {k: (n // 2, n) for k, n in sizes.items()}, window_rows)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("__at", df.schema[axis].dataType)])
    at = _typed(df.sparkSession, [(k, c) for k, (c, _) in by_coordinate.items()], schema)
    ties = df.join(at, "node").filter(F.col(axis) == F.col("__at"))
    counted = ties.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("only")).collect()
    # distinct coordinates are the usual case: the one record there is the pivot
    pivots = {r["node"]: r["only"] for r in counted if r["n"] == 1}
    wanted = {r["node"]: (by_coordinate[r["node"]][1], r["n"]) for r in counted if r["n"] > 1}
    if wanted:
        found = select_ranks(ties, "node", value, wanted, window_rows)
        pivots.update({k: v for k, (v, _) in found.items()})
    return [(k, c, pivots[k]) for k, (c, _) in by_coordinate.items()]


# -- splitting ----------------------------------------------------------------


def _descend(df: DataFrame, before: Column, same: Column, splits: Column, keep_pivot: bool) -> DataFrame:
    """Move the rows of splitting nodes to a child; a kept pivot stays in its node for good."""
    node = F.col("node")
    step = F.when(before, node * 2).otherwise(node * 2 + 1)
    moves = splits & ~F.col("settled")
    if keep_pivot:
        settled = F.col("settled") | (moves & same)
        moves = moves & ~same
    else:
        settled = F.col("settled")
    return df.withColumns({"node": F.when(moves, step).otherwise(node), "settled": settled})


def kd_cells(
    df: DataFrame,
    *,
    depth: int,
    capacity: int = 1,
    keep_pivot: bool = True,
    x: str = "x",
    y: str = "y",
    value: str = "value",
    node: str = "node",
    n_items: int | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``df`` with the heap number of each record's node after ``depth`` median splits.

    With ``keep_pivot`` the record at the split rank stays in the splitting node;
    without, it goes to the right child, so that only the lowest nodes hold
    records.  ``value`` should be unique: it is the tie-breaker.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if not 0 <= depth <= MAX_KD_DEPTH:
        raise ValueError(f"depth must be in [0, {MAX_KD_DEPTH}]")
    state = df.withColumns({"node": F.lit(ROOT).cast("bigint"), "settled": F.lit(False)})
    if depth:  # the source is computed once, however many passes its levels take
        state = cut_lineage(state)
    n_items = state.count() if n_items is None else n_items
    for level, sizes in enumerate(node_sizes(n_items, depth, capacity, keep_pivot)):
        if not sizes:
            break
        axis = x if level % 2 == 0 else y
        if max(sizes.values()) > window_rows:
            state = cut_lineage(_split_by_pivots(state, axis, value, sizes, keep_pivot, window_rows))
        else:
            state = _split_by_window(state, axis, value, capacity, keep_pivot, level)
            if level % LEVELS_PER_CUT == LEVELS_PER_CUT - 1:
                state = cut_lineage(state)
    return state.select(*df.columns, F.col("node").alias(node))


def _split_by_pivots(
    state: DataFrame, axis: str, value: str, sizes: dict[int, int], keep_pivot: bool, window_rows: int
) -> DataFrame:
    active = state.filter(~F.col("settled")).select("node", axis, value)
    pivots = _pivots_by_selection(active, axis, value, sizes, window_rows)
    schema = T.StructType(
        [
            T.StructField("node", T.LongType()),
            T.StructField("__coord", state.schema[axis].dataType),
            T.StructField("__value", state.schema[value].dataType),
        ]
    )
    met = state.join(_typed(state.sparkSession, pivots, schema), "node", "left")
    c, v = F.col(axis), F.col(value)
    before = (c < F.col("__coord")) | ((c == F.col("__coord")) & (v < F.col("__value")))
    same = (c == F.col("__coord")) & (v == F.col("__value"))
    splits = F.col("__coord").isNotNull()
    return _descend(met, before, same, splits, keep_pivot).drop("__coord", "__value")


def _split_by_window(
    state: DataFrame, axis: str, value: str, capacity: int, keep_pivot: bool, level: int
) -> DataFrame:
    # settled pivots sit in nodes of upper levels and never share a window with open rows of this level
    whole = Window.partitionBy("node")
    place = (F.row_number().over(whole.orderBy(axis, value)) - 1).alias("__place")
    size = F.count(F.lit(1)).over(whole).alias("__size")
    ranked = state.select("*", place, size)
    middle = F.floor(F.col("__size") / 2)
    splits = (F.col("__size") > capacity) & (F.col("node") >= 2**level)
    before, same = F.col("__place") < middle, F.col("__place") == middle
    return _descend(ranked, before, same, splits, keep_pivot).drop("__place", "__size")
