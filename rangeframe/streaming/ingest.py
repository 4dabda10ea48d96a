"""Streaming forms: route and append, match against a query table, running directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import directory as d
from ..operators.layouts import KeyChunks, Layout, Position
from ..plans.runtime import remove_folder, written_folders
from ..plans.stored import StoredLayout

SNAPSHOT_EVERY = 50  # micro-batches from one snapshot of a running directory to the next


def append_stream(stream: DataFrame, stored: StoredLayout, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append arriving records to a stored layout under its fixed cells.

    Each micro-batch is written under its own name, so a batch that is retried
    after a failure replaces itself: the layout holds every record once.  A batch that
    was merged with others before it is retried is in the layout already and is left alone.
    """

    def save(batch: DataFrame, n: int) -> None:
        name = f"stream-{n:09d}"
        if not stored.was_merged(name):
            stored.append(batch, name)

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_cells_stream(stream: DataFrame, layout: Layout, at: Position) -> DataFrame:
    """Arriving records with their cell: stateless, any sink can follow."""
    return layout.assign(stream, at)


def match_stream(stream: DataFrame, queries: DataFrame, match: Callable[..., DataFrame], **columns) -> DataFrame:
    """Stream-static join: any function of :mod:`rangeframe.operators.joins` with the stream as data.

    Those functions measure the static query table only, so they take a stream as it is.
    """
    return match(stream, queries, **columns)


def directory_stream(stream: DataFrame, layout: Layout, at: Position) -> DataFrame:
    """Running directory; use it with update or complete output. State is one row per cell."""
    placed = layout.assign(stream, at)
    if isinstance(layout, KeyChunks):
        return d.key_directory(placed, key=at.columns[0])
    return d.mbr_directory(placed, sides=at.sides)


def write_directory_updates(
    updates: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, snapshot_every: int = SNAPSHOT_EVERY
) -> StreamingQuery:
    """Write each micro-batch's changed directory rows under its own name, and their state every so often.

    After ``snapshot_every`` micro-batches the latest row of each cell is written as a snapshot.  It is built from the snapshot
    before it and the micro-batches since, so its cost does not grow with the age of the stream.  Micro-batches
    and snapshots that the last two snapshots make superfluous are removed.  A retried micro-batch
    writes the same rows again.  One stream, with one checkpoint, may write to a path.
    """

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if (n + 1) % snapshot_every == 0:
            _snapshot(batch.sparkSession, path, n)

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n) for n in written_folders(spark, path, prefix))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Snapshots that were written whole: their marker is a file of its own, written last."""
    return _numbers(spark, f"{path}/_complete", "upto=")


def _snapshot(spark: SparkSession, path: str, n: int) -> None:
    whole = _snapshots(spark, path)
    if n not in whole:
        _state(spark, path, n).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={n}")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/_complete/upto={n}")
    before = [m for m in whole if m < n]
    if not before:
        return
    for m in before[:-1]:
        remove_folder(spark, f"{path}/_complete/upto={m}")
        remove_folder(spark, f"{path}/_snapshots/upto={m}")
    for m in _numbers(spark, path, "batch="):
        if m <= before[-1]:
            remove_folder(spark, f"{path}/batch={m}")


def _state(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Latest row of each cell with its micro-batch: the last snapshot and what was written since."""
    whole = [m for m in _snapshots(spark, path) if upto is None or m <= upto]
    since = [m for m in _numbers(spark, path, "batch=") if not whole or m > whole[-1]]
    parts = []
    if since:
        tail = spark.read.option("basePath", path).parquet(*(f"{path}/batch={m}" for m in since))
        parts.append(tail.withColumn("batch", F.col("batch").cast("bigint")))
    if whole:
        parts.append(spark.read.parquet(f"{path}/_snapshots/upto={whole[-1]}"))
    if not parts:
        raise ValueError(f"no directory has been written to {path}")
    rows = reduce(DataFrame.unionByName, parts)
    latest = F.max_by(F.struct(*(c for c in rows.columns if c != "cell")), "batch").alias("now")
    return rows.groupBy("cell").agg(latest).select("cell", "now.*")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory as of the last micro-batch.

    At most one snapshot and ``2 * snapshot_every`` micro-batches are read, however many there were.  A reader that
    takes longer than ``snapshot_every`` micro-batches may find its files removed and has to begin again.
    """
    return _state(spark, path).drop("batch")
