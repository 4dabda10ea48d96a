"""Loading user tables into the canonical shapes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import drop_unusable

Expression = str | Column


def _mapped(df: DataFrame, schema: T.StructType, columns: Mapping[str, Expression] | None) -> DataFrame:
    columns = dict(columns or {})
    unknown = set(columns) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"not columns of the target shape: {sorted(unknown)}")
    picked = []
    for field in schema.fields:
        source = columns.get(field.name, field.name)
        source = F.expr(source) if isinstance(source, str) else source
        picked.append(source.cast(field.dataType).alias(field.name))
    return df.select(*picked)


def as_shape(
    df: DataFrame,
    schema: T.StructType,
    columns: Mapping[str, Expression] | None = None,
    *,
    identity: str = "value",
) -> DataFrame:
    """Project ``df`` onto one of the shapes in ``schema`` and drop unusable rows.

    ``columns`` maps target names to SQL expressions or columns of ``df``; names
    left out are taken as they are.
    """
    shaped = _mapped(df, schema, columns)
    keys = [f.name for f in schema.fields if f.name != identity]
    return drop_unusable(shaped, keys)


def load(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Mapping[str, Expression] | None = None,
    *,
    identity: str = "value",
) -> DataFrame:
    """Read parquet straight into one of the shapes; Spark splits the files into partitions."""
    return as_shape(spark.read.parquet(path), schema, columns, identity=identity)
