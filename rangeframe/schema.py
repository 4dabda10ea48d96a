"""Fixed row shapes, and the ingest check that enforces them.

Every operator takes column names as arguments, so these schemas are the
canonical forms that sources produce, not a requirement on user tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KV = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType())])

POINTS = T.StructType(
    [
        T.StructField("value", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)

RECTS = T.StructType(
    [T.StructField("value", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]
)

KEY_QUERIES = T.StructType([T.StructField("qid", T.LongType()), T.StructField("k", T.LongType())])

RANGE_QUERIES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("qid", "low", "high")]
)

POINT_QUERIES = T.StructType(
    [T.StructField("qid", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("px", "py")]
)

RECT_QUERIES = T.StructType(
    [T.StructField("qid", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("qxmin", "qymin", "qxmax", "qymax")]
)

KEY_DIRECTORY = T.StructType(
    [
        T.StructField("cell", T.IntegerType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("min_key", T.LongType()),
        T.StructField("max_key", T.LongType()),
    ]
)

MBR_DIRECTORY = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("n_items", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]
)

RESULTS = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("workload", T.StringType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("num_queries", T.LongType()),
        T.StructField("total_results", T.LongType()),
        T.StructField("avg_results", T.DoubleType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _usable(df: DataFrame, columns: list[str]):
    """True where every named column is present and, for floats, not NaN."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    checks = []
    for name in columns:
        ok = F.col(name).isNotNull()
        checks.append(ok & ~F.isnan(name) if name in floats else ok)
    return reduce(lambda a, b: a & b, checks)


def drop_unusable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key columns are all set.

    Spark orders NaN above every number and calls NaN equal to itself, so a NaN
    coordinate would answer queries it has no place in; such rows stop here.
    """
    return df.filter(_usable(df, columns))


def ingest_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(n_rows, n_kept, n_dropped)`` for the check above."""
    kept = F.count(F.when(_usable(df, columns), F.lit(1)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), kept.alias("n_kept")).withColumn(
        "n_dropped", F.col("n_rows") - F.col("n_kept")
    )
