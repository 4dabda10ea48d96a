"""What several operators share: the word and blank definitions, lower-casing, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.runtime import scratch_path

BLANKS = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where a text is all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_digest(text: Column) -> Column:
    """64-bit digest that tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unit_from_hex(digest: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hex digest; the same in any engine."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    It cuts the lineage, outlives lost executors, and its file size is known to
    the planner, which decides on a broadcast by that size.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    with shuffles_dropped(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """The rows with the hint that a join of them sorts and merges.

    The planner takes exploded rows for as many as there were before, and what is written of them for as small as its
    dictionaries make it.  By that size it would send very many rows through the driver to all tasks.
    """
    return df.hint("merge")


SLICE_BYTES = 4 << 20


def map_frames(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like ``mapInPandas``, on slices of a few megabytes: long texts do not fill a worker's memory."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step).to_pandas(integer_object_nulls=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(slices(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
