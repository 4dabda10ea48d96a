"""All values of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import broadcast_if_small, cut_lineage
from .ranks import with_rank

BUCKET_ROWS = 10_000
BROADCAST_KEYS = 100_000


def key_counts(df: DataFrame, *, key: str = "key") -> DataFrame:
    """``(key, n_values)``."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_values"))


def key_buckets(
    df: DataFrame, *, key: str = "key", value: str = "value", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``(key, chunk, n_values, values)``: every value of a key in order, duplicates kept.

    Chunk ``i`` holds the values of rank ``i * bucket_rows`` to ``(i + 1) * bucket_rows - 1``, so
    no array and no task has to hold all values of a key.  Ranks come from a range
    sort of the rows of those keys that have more than one chunk.
    """
    if bucket_rows < 1:
        raise ValueError("bucket_rows must be at least 1")
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    large = cut_lineage(key_counts(rows).filter(F.col("n_values") > bucket_rows).select("key"))
    if large.isEmpty():
        return _collected(rows.withColumn("chunk", F.lit(0).cast("bigint")))
    large = broadcast_if_small(large, BROADCAST_KEYS)
    ranked = with_rank(rows.join(large, "key", "left_semi"), ["key", "value"])
    first = ranked.groupBy(F.col("key").alias("k")).agg(F.min("rank").alias("first"))
    place = ranked.join(broadcast_if_small(first, BROADCAST_KEYS), F.col("key") == F.col("k"))
    chunk = F.call_function("div", F.col("rank") - F.col("first"), F.lit(bucket_rows).cast("bigint"))
    single = rows.join(large, "key", "left_anti").withColumn("chunk", F.lit(0).cast("bigint"))
    return _collected(place.select("key", "value", chunk.alias("chunk")).unionByName(single))


def _collected(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("key", "chunk").agg(
        F.count(F.lit(1)).alias("n_values"), F.sort_array(F.collect_list("value")).alias("values")
    )
