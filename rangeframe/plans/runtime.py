"""Helpers that depend on the running session: lineage cuts, scratch paths, size checks."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would lose data with the machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rangeframe-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows dealt by content to as many tasks as the session's shuffles have, however few files they come from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def row_count_up_to(df: DataFrame, cap: int) -> int:
    """Row count, or ``cap + 1`` as soon as there are more."""
    return df.select(F.lit(1).alias("one")).limit(cap + 1).count()


def broadcast_if_small(df: DataFrame, cap: int) -> DataFrame:
    """Broadcast hint behind a row count; a larger side is left to the join planner."""
    return F.broadcast(df) if row_count_up_to(df, cap) <= cap else df


# -- folders; the file system is the one the path names ------------------------


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    place, files = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def seconds_since_change(spark: SparkSession, path: str) -> float:
    place, files = _place(spark, path)
    return time.time() - files.getFileStatus(place).getModificationTime() / 1000


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def written_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the folders whose write was committed."""
    names = [n for n in child_names(spark, path) if n.startswith(prefix)]
    return [n[len(prefix) :] for n in names if any(c.startswith("part-") for c in child_names(spark, f"{path}/{n}"))]
