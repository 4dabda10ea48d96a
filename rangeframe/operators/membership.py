"""Membership filters: which cells can hold a record with a given key or at a given position.

A cell's filter is a Bloom filter in buckets, so that no row grows with its cell: the hash of a key names the bucket, and
one slot in each of three bitmaps of that bucket.  A cell gets as many buckets as its records need, hence a key that is not
there passes in about one case of a hundred, whatever the size of the cell.  Filters are plain aggregates: Spark's
bitmap aggregate is combined in the map tasks, and a hot cell is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT_BITS = 15  # Spark's bitmaps have 32,768 bits
BITMAPS = 3
PER_BUCKET = 8_192  # records of a bucket, on average: a fifth of the bits is set
NAMES = tuple(f"bits{i}" for i in range(BITMAPS))


def hash_of(values: list[Column], kinds: list[T.DataType]) -> Column:
    """Hash of a key; both zeros of floating numbers are one."""
    floats = (T.DoubleType, T.FloatType)
    return F.xxhash64(*(v + F.lit(0.0) if isinstance(kind, floats) else v for v, kind in zip(values, kinds)))


def _slots(code: Column) -> list[Column]:
    return [F.shiftrightunsigned(code, SLOT_BITS * i).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("bigint") for i in range(BITMAPS)]


def _bucket(code: Column, n_buckets: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(code, SLOT_BITS * BITMAPS), n_buckets).cast("int")


def membership_filters(placed: DataFrame, columns: list[str], *, cell: str = "cell") -> DataFrame:
    """``(cell, n_buckets, bucket, bits0, bits1, bits2)`` of records that have a cell.

    Records are counted per cell first.  Null cells and null keys take part like any other; an empty table has no filter.
    """
    sizes = placed.groupBy(F.col(cell).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / PER_BUCKET).cast("int").alias("n_buckets"))
    code = hash_of([F.col(c) for c in columns], [placed.schema[c].dataType for c in columns])
    coded = placed.select(F.col(cell).alias("__cell"), code.alias("__code"))
    met = coded.join(sizes, F.col("__cell").eqNullSafe(F.col("cell")))
    bits = [F.bitmap_construct_agg(slot).alias(name) for slot, name in zip(_slots(F.col("__code")), NAMES)]
    return met.groupBy("cell", "n_buckets", _bucket(F.col("__code"), F.col("n_buckets")).alias("bucket")).agg(*bits)


def _is_set(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def may_hold(filters: DataFrame, code: Column) -> DataFrame:
    """The filter rows whose cell can hold a key of that hash: never too few."""
    found = [_is_set(F.col(name), slot) for name, slot in zip(NAMES, _slots(code))]
    return filters.filter(reduce(and_, found, F.col("bucket") == _bucket(code, F.col("n_buckets"))))


def comparable(literal: T.DataType, column: T.DataType) -> bool:
    """Whether equal values of the two types have equal hashes once the literal has the column's type.

    Other pairs are compared in a third type, in which different keys may be equal.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return literal == column or (isinstance(literal, whole) and isinstance(column, whole))
