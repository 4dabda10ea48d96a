"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table, made from two digests of its name.  The shards take turns; at each turn a
shard claims the first free slot of its order.  Adding or removing a shard moves
few slots, and every shard gets the same number of slots, give or take one.

The table has ``slots`` rows whatever the data, so broadcasting it is bounded;
a row finds its shard by one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

SLOTS = 8191  # prime; at least a hundred times the number of shards keeps shares within one per cent


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_slots(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot.

    ``slots`` must be prime (each step then visits all slots) and not below the
    number of shards; shard names must differ.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if slots < len(shards) or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least 3 and the number of shards")
    at = [_number(f"start/{name}") % slots for name in shards]
    step = [_number(f"step/{name}") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    free = slots
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                return owner


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)`` with one row per slot."""
    filled = ",".join(map(str, fill_slots(shards, slots)))
    one = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "owner"))
    return one.select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by 60 bits of its digest; null counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str, shards: Sequence[str], *, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` columns (columns of these names are replaced).

    Rows of equal key, repeated ones included, go to the same shard; a null key
    goes where the empty string goes; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in (slot, shard)]
    rows = docs.select(slot_of(quoted(key), slots).alias("s"), F.struct(*map(quoted, kept)).alias("row"))
    lookup = F.broadcast(slot_table(docs.sparkSession, shards, slots))
    return rows.join(lookup, rows["s"] == lookup["slot"], "left").select("row.*", rows["s"].alias(slot), lookup["shard"].alias(shard))


def write_shards(placed: DataFrame, path: str, *, shard: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; Spark splits large shards over tasks and files."""
    placed.hint("rebalance", quoted(shard)).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard).parquet(path)
