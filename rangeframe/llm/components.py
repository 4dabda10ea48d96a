"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: each node of ``(a, b)`` with the smallest node that it is linked to.

    Every round a node takes its smallest neighbour, that neighbour's own, and so on down to one that has no smaller.
    Links are drawn between what their ends have taken; those within one group and repeated ones go.  So a link is
    met until its ends are one, and a crowd's many links are met about once, not in every round.  No round
    raises a label, so the smallest node of a group keeps its own and is what remains.
    A node with very many links is split by the skew handling of the joins, and minima are formed before the shuffle.
    """
    links = _links(edges)
    roots = None
    while True:
        ends = links.union(links.select("b", "a"))
        lower = _lowest(written(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels"))
        roots = lower if roots is None else written(_lifted(roots, "root", lower), "labels")
        links = _links(_lifted(_lifted(links, "a", lower), "b", lower))
        if links.isEmpty():
            return roots


def more_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``(node, root)`` of the links that gave ``roots`` and of ``edges``; only the latter are met."""
    added = connected_components(_lifted(_lifted(edges.select("a", "b"), "a", roots), "b", roots))
    known = roots.select(F.col("node").alias("known"))
    alone = added.join(known, added["node"] == known["known"], "left_anti")  # had no link before
    return written(_lifted(roots, "root", added).union(alone), "labels")


def _lowest(taken: DataFrame) -> DataFrame:
    """``(node, root)`` followed from node to root until nothing changes; each time doubles the steps."""
    while True:
        above = taken.select(F.col("node").alias("up"), F.col("root").alias("upper"))
        met = taken.join(above, taken["root"] == above["up"])
        lower = written(met.select("node", F.col("upper").alias("root"), (F.col("upper") < F.col("root")).alias("moved")), "labels")
        taken = lower.select("node", "root")
        if lower.filter("moved").isEmpty():
            return taken


def _links(edges: DataFrame) -> DataFrame:
    """Each link once, smaller end first, and none of a node with itself."""
    return written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def _lifted(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """The rows with the column's nodes replaced by their roots, where they have one."""
    named = roots.select(F.col("node").alias("from"), F.col("root").alias("to"))
    met = rows.join(named, rows[column] == named["from"], "left")
    return met.select([F.coalesce("to", column).alias(c) if c == column else c for c in rows.columns])
