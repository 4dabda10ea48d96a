"""Interval search: from a code to the interval that holds it, by arithmetic in the row.

Intervals are given by their first codes.  Codes are read four bits at a time, as in a radix tree whose nodes have
sixteen children.  A child in whose range no interval begins lies in one interval, which settles the search; any
other child is a node of the next step.  The tree travels with the plan as one array of numbers, so there is no
join, and dense regions of codes get more steps than sparse ones.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 4  # bits of a step
WAYS = 1 << DIGIT


def constant_array(numbers: Sequence[float], kind: str) -> Column:
    """A constant array of numbers, as one literal of the plan."""
    if not numbers:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


def bounds_below(
    v: Column,
    bounds: Sequence[float],
    group: Column | None = None,
    firsts: Sequence[int] = (0,),
    counts: Sequence[int] | None = None,
) -> Column:
    """How many of the sorted ``bounds`` do not exceed ``v``: a binary search in the row; 0 for null.

    With ``group``, only the ``counts[group]`` bounds from place ``firsts[group]`` on are searched.
    """
    counts = [len(bounds)] if counts is None else counts
    most = max(counts, default=0)
    if not most:
        return F.lit(0)
    group = F.lit(0) if group is None else group
    steps = constant_array([1 << i for i in reversed(range(most.bit_length()))], "int")
    table = constant_array(list(bounds), "double")
    first, n = F.get(constant_array(list(firsts), "int"), group), F.get(constant_array(list(counts), "int"), group)

    def go(place: Column, step: Column) -> Column:
        fits = (place + step <= n) & (F.get(table, first + place + step - 1) <= v)
        return F.when(fits, place + step).otherwise(place)

    return F.aggregate(steps, F.lit(0), go)


def search_tree(starts: list[tuple[int, int]], bits: int) -> tuple[list[int], int]:
    """The tree over sorted ``(first code, cell)``, the first code being 0, and its number of steps.

    Entry ``16 * node + digit`` is the node to go on with, or ``-1 - cell`` once the search is settled.
    """
    codes, cells = [s for s, _ in starts], [c for _, c in starts]
    entries: list[int] = []
    steps, open_ = 0, [0]
    n_nodes = 1
    while open_:
        steps += 1
        width = 1 << (bits - DIGIT * steps)
        deeper = []
        for prefix in open_:
            for digit in range(WAYS):
                low = ((prefix << DIGIT) + digit) * width
                first = bisect_right(codes, low)
                if bisect_left(codes, low + width) > first:  # intervals begin inside
                    entries.append(n_nodes)
                    deeper.append((prefix << DIGIT) + digit)
                    n_nodes += 1
                else:
                    entries.append(-1 - cells[first - 1])
        open_ = deeper
    return entries, steps


def with_interval(df: DataFrame, code: Column, starts: list[tuple[int, int]], bits: int, cell: str) -> DataFrame:
    """``df`` with the cell of the interval that holds ``code``, a number of ``bits`` bits, a multiple of four."""
    entries, steps = search_tree(starts, bits)
    tree = F.split(F.lit(",".join(map(str, entries))), ",").cast("array<int>")  # folded into a constant
    kept = [F.col(f"`{c}`") for c in df.columns]
    state = df.select(*kept, code.alias("__code"), F.lit(0).alias("__node"))
    for step in range(1, steps + 1):
        digit = F.call_function("shiftright", F.col("__code"), F.lit(bits - DIGIT * step)).bitwiseAND(F.lit(WAYS - 1)).cast("int")
        node = F.when(F.col("__node") < 0, F.col("__node")).otherwise(F.get(tree, F.col("__node") * WAYS + digit))
        state = state.select(*kept, "__code", node.alias("__node"))
    # never null, and says so: a join on the cell then pushes no null test down through all the steps
    return state.select(*kept, F.coalesce((-1 - F.col("__node")).cast("int"), F.lit(-1)).alias(cell))
