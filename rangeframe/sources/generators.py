"""Synthetic records and query sets.

Each generator takes either a row count or any DataFrame with an ``id`` column;
rows are a function of ``(id, seed)``, so partitioning never changes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mixing import MODULUS, mixed_int, mixed_unit, permutation_step


def _ids(source: DataFrame, name: str = "id") -> Column:
    if name not in source.columns:
        raise ValueError(f"id column {name!r} is missing")
    return F.col(name).cast("bigint")


def id_range(spark: SparkSession, n: int) -> DataFrame:
    """Ids ``0 .. n-1``, made inside the tasks."""
    return spark.range(n)


def key_values(
    ids: DataFrame,
    *,
    key_min: int = 0,
    key_max: int = 1_000_000,
    allow_duplicates: bool = True,
    seed: int = 0,
) -> DataFrame:
    """``(key, value)`` with uniform integer keys; the value is the id.

    Without duplicates the ids must be distinct and lie in a window no longer
    than the key range (``0 .. n-1`` does); a window that does not fit is an error.
    """
    value = _ids(ids)
    if allow_duplicates:
        return ids.select(mixed_int(value, key_min, key_max, seed, 1).alias("key"), value.alias("value"))
    span = key_max - key_min + 1
    first, last = ids.agg(F.min(value), F.max(value)).first()
    if first is not None and last - first + 1 > span:
        raise ValueError("key range too small for unique keys")
    # a product of two 64-bit numbers needs 38 digits; small ranges stay in BIGINT
    kind = "bigint" if span <= MODULUS else "decimal(19,0)"
    size, step = F.lit(span).cast(kind), F.lit(permutation_step(span)).cast(kind)
    place = F.pmod(value.cast(kind), size) * step + F.lit(seed * 7919 % span).cast(kind)
    key = F.pmod(place, F.lit(span).cast(kind)).cast("bigint") + F.lit(key_min).cast("bigint")
    return ids.select(key.cast("bigint").alias("key"), value.alias("value"))


def points(
    ids: DataFrame, *, space_width: float = 10_000.0, space_height: float = 10_000.0, seed: int = 0
) -> DataFrame:
    """``(value, x, y)`` uniform in the space."""
    value = _ids(ids)
    return ids.select(
        value.alias("value"),
        (mixed_unit(value, seed, 1) * space_width).alias("x"),
        (mixed_unit(value, seed, 2) * space_height).alias("y"),
    )


def _corner_and_sides(
    value: Column, width: float, height: float, max_width: float, max_height: float, seed: int
) -> tuple[Column, Column, Column, Column]:
    if max_width < 1 or max_height < 1:
        raise ValueError("maximum sides must be at least 1")
    xmin = mixed_unit(value, seed, 1) * width
    ymin = mixed_unit(value, seed, 2) * height
    side_x = mixed_unit(value, seed, 3) * (max_width - 1.0) + 1.0
    side_y = mixed_unit(value, seed, 4) * (max_height - 1.0) + 1.0
    return (
        xmin,
        ymin,
        F.least(F.lit(float(width)), xmin + side_x),
        F.least(F.lit(float(height)), ymin + side_y),
    )


def rects(
    ids: DataFrame,
    *,
    space_width: float = 10_000.0,
    space_height: float = 10_000.0,
    max_rect_width: float = 100.0,
    max_rect_height: float = 100.0,
    seed: int = 0,
) -> DataFrame:
    """``(value, xmin, ymin, xmax, ymax)``: uniform corner, sides in ``[1, max]``, clipped to the space."""
    value = _ids(ids)
    sides = _corner_and_sides(value, space_width, space_height, max_rect_width, max_rect_height, seed)
    names = ("xmin", "ymin", "xmax", "ymax")
    return ids.select(value.alias("value"), *(c.alias(n) for c, n in zip(sides, names)))


def range_queries(
    ids: DataFrame, *, low_min: int = 0, low_max: int = 900_000, max_width: int = 50_000, seed: int = 0
) -> DataFrame:
    """``(qid, low, high)``: uniform low, width in ``[1, max_width]``."""
    qid = _ids(ids)
    low = mixed_int(qid, low_min, low_max, seed, 1)
    return ids.select(
        qid.alias("qid"), low.alias("low"), (low + mixed_int(qid, 1, max_width, seed, 2)).alias("high")
    )


def rect_queries(
    ids: DataFrame,
    *,
    space_width: float = 10_000.0,
    space_height: float = 10_000.0,
    max_query_width: float = 500.0,
    max_query_height: float = 500.0,
    seed: int = 0,
) -> DataFrame:
    """``(qid, qxmin, qymin, qxmax, qymax)``, for point and rectangle data alike."""
    qid = _ids(ids)
    sides = _corner_and_sides(qid, space_width, space_height, max_query_width, max_query_height, seed)
    names = ("qxmin", "qymin", "qxmax", "qymax")
    return ids.select(qid.alias("qid"), *(c.alias(n) for c, n in zip(sides, names)))
