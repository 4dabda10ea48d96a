"""Distributed row ranks: order by columns, number the rows from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut_lineage

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in its low 33 bits


def with_rank(df: DataFrame, order_by: list[str], rank: str = "rank") -> DataFrame:
    """Add each row's position in the order of ``order_by``.

    A window over the whole table would sort it in one task.  Here a range
    shuffle sorts it in many, and only one row per partition (its size) passes
    through a window, to turn positions inside a partition into global ones.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    # the sorted rows are written once: both uses below see the same partitions
    placed = cut_lineage(
        ordered.select(
            "*",
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("__index"),
        )
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__offset") + F.col("__index")).alias(rank)
    )
