"""Report sinks for result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("algorithm", "workload", "n_items", "num_queries", "total_results", "avg_results", "extra")


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object per result row."""
    results.write.mode("overwrite").json(path)


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        digits = 8 if name.startswith("query_avg") else 6 if name.endswith("seconds") else 3
        return F.format_string(f"%.{digits}f", c.cast("double"))
    if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)):
        return F.coalesce(F.to_json(c), F.lit("{}"))
    return F.coalesce(c.cast("string"), F.lit(""))


def text_lines(results: DataFrame, title: str, *, columns=TEXT_COLUMNS, order_by=("algorithm", "workload")) -> DataFrame:
    """``(part, __order, line)``: title, header, rule and one padded line per result row.

    Column widths are one aggregate over the rows, handed to every line as a scalar subquery.
    """
    columns = [c for c in columns if c in results.columns]
    cells = results.select(
        *(_as_text(results, c).alias(c) for c in columns),
        F.struct(*(F.col(c) for c in order_by)).alias("__order"),
    )
    widest = cells.agg(
        F.struct(
            *(F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(c) for c in columns)
        ).alias("width")
    )

    def padded(cell: Column, name: str) -> Column:
        return F.call_function("rpad", cell, F.col(f"__width.{name}"), F.lit(" "))

    body = cells.select("*", widest.scalar().alias("__width")).select(
        F.lit(3).alias("part"), "__order", F.concat_ws(" | ", *(padded(F.col(c), c) for c in columns)).alias("line")
    )
    heads = [
        F.lit(title),
        F.concat_ws(" | ", *(padded(F.lit(c), c) for c in columns)),
        F.concat_ws("-+-", *(F.repeat(F.lit("-"), F.col(f"__width.{c}")) for c in columns)),
    ]
    listed = F.array(*(F.struct(F.lit(i).alias("part"), h.alias("line")) for i, h in enumerate(heads)))
    head = widest.select(F.col("width").alias("__width")).select(F.inline(listed))
    no_order = F.lit(None).cast(body.schema["__order"].dataType).alias("__order")
    return head.select("part", no_order, "line").unionByName(body)


def write_text(results: DataFrame, path: str, title: str, **options) -> None:
    """A titled table with columns padded to their widest cell, in report order."""
    lines = text_lines(results, title, **options)
    lines.orderBy("part", "__order").select("line").write.mode("overwrite").text(path)
