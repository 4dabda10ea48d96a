"""Line deduplication with levelled sorted runs of line hashes.

A *run* is a bucketed, sorted table ``(line_key, n_docs)``: line keys of one or more batches
with the number of documents that hold them.  A new batch is met with the runs by merge
anti-joins on the key, and what they leave becomes a run of level 0 itself.  A key that some run
already holds in as many documents as it takes is settled: later batches do not add it again.
When a level holds ``fan_in`` runs they are merged into one run of the next level,
so after ``n`` batches there are about ``fan_in * log(n)`` runs, and each key is
rewritten once per level.  All runs share one bucketing by key, so joins and
merges of runs shuffle the new batch only.

A line's key is the digest of the line with blanks stripped at both ends and A-Z
lower-cased.  Line texts never leave their document: only keys are counted, and
the positions to drop come back to the document.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import shared_folder
from .common import BLANKS, ascii_lower, quoted, text_digest, written

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FAN_IN = 2


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """Hex digest of the normalised line, or null if it has fewer than ``min_chars`` code points."""
    bare = ascii_lower(F.btrim(line, F.lit(BLANKS)))
    return F.when(F.char_length(bare) >= min_chars, F.md5(bare))


class LineRuns:
    """The levelled runs of one collection of batches.

    Runs have as many buckets as the session has shuffle partitions when the
    collection is begun, so a batch meets them without a second shuffle.
    Run tables live in the shared folder; the session's catalog knows their
    bucketing, and ``drop`` removes them from it.
    """

    def __init__(self, spark: SparkSession, *, fan_in: int = FAN_IN, buckets: int | None = None):
        if fan_in < 2:
            raise ValueError("fan_in must be at least 2")
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._folder = shared_folder(spark).rstrip("/")

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            counts.select("line_key", "n_docs")
            .repartition(self.buckets, "line_key")
            .write.format("parquet")
            .bucketBy(self.buckets, "line_key")
            .sortBy("line_key")
            .option("path", f"{self._folder}/{name}")
            .saveAsTable(name)
        )
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by merge joins on their common bucketing.

        Not a union that is grouped: Spark 4.1 takes the buckets of all tables for co-located there, then reads
        them unbucketed, and a key would keep one row per run.
        """

        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            other = right.select(F.col("line_key").alias("other_key"), F.col("n_docs").alias("more"))
            met = left.join(other.hint("merge"), F.col("line_key") == F.col("other_key"), "full_outer")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return met.select(F.coalesce("line_key", "other_key").alias("line_key"), total.cast("bigint").alias("n_docs"))

        empty = self.spark.createDataFrame([], "line_key string, n_docs bigint")
        return reduce(both, [self.spark.table(n) for n in names]) if names else empty

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, keys: DataFrame, min_docs: int = 1) -> DataFrame:
        """Rows of ``keys`` whose ``line_key`` no run holds in ``min_docs`` documents: one merge anti-join per run."""

        def without(rows: DataFrame, name: str) -> DataFrame:
            held = self.spark.table(name).filter(F.col("n_docs") >= min_docs).select("line_key")
            return rows.join(held.hint("merge"), "line_key", "left_anti")

        return reduce(without, self.names, keys)

    def add(self, counts: DataFrame) -> None:
        """Add a batch's ``(line_key, n_docs)``, one row per key, and compact full levels."""
        self._put(0, self._write(counts))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(full))
            self._forget(full)
            self._put(level + 1, merged)

    def counts(self) -> DataFrame:
        """``(line_key, n_docs)`` over all batches; of keys that a caller left out as settled, what was added."""
        return self._merged(self.names)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self._forget(self.names)
        self.levels = []


def _keyed(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """Narrow rows: the identity of a document and the keys of its lines."""
    keys = F.transform(lines_of(quoted(text)), lambda line: line_key(line, min_chars))
    mark = text_digest(quoted(text))
    return docs.select(
        quoted(doc_id).alias("doc_id"), mark.alias("mark"), keys.alias("keys"), F.pmod(mark, F.lit(batches)).cast("int").alias("batch")
    )


def new_keys(batch: DataFrame) -> DataFrame:
    """``(line_key, n_docs)`` of a batch of narrow rows; a key counts once per document."""
    own = batch.select(F.explode(F.array_distinct("keys")).alias("line_key")).filter("line_key IS NOT NULL")
    return own.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_docs"))


def drop_common_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
    buckets: int | None = None,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)`` for every row of ``docs``.

    All lines whose key occurs in at least ``min_docs`` rows go, in every row.
    The rows arrive in ``batches`` batches.  Each merge-anti-joins the runs of those before it, which
    takes out the keys that already have ``min_docs`` rows in a run, and adds the counts of the
    others.  No line goes before all batches are in.  A null or empty text is one empty line, which is never dropped.
    Every row is a document, repeated rows too.  An empty table stays empty.
    """
    narrow = written(_keyed(docs, doc_id, text, min_chars, batches), "line-keys", partition_by="batch")
    runs = LineRuns(docs.sparkSession, fan_in=fan_in, buckets=buckets)
    for number in range(batches):
        runs.add(runs.unseen(new_keys(narrow.filter(F.col("batch") == number)), min_docs))
    common = written(runs.counts().filter(F.col("n_docs") >= min_docs).select("line_key"), "line-common")
    runs.drop()
    return without_lines(docs, narrow, common, doc_id=doc_id, text=text)


def first_seen_lines(runs: LineRuns, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The incremental form: ``docs`` is a new batch; lines that an earlier batch held go.

    Columns as in ``drop_common_lines``.  The batch is added to ``runs``; lines
    repeated inside the batch stay, as none of them came before it.
    """
    narrow = written(_keyed(docs, doc_id, text, min_chars, 1).drop("batch"), "line-keys")
    batch = written(new_keys(narrow), "line-batch")
    fresh = runs.unseen(batch).select("line_key")
    known = written(batch.join(fresh, "line_key", "left_anti").select("line_key"), "line-known")
    runs.add(batch)
    return without_lines(docs, narrow, known, doc_id=doc_id, text=text)


def without_lines(docs: DataFrame, narrow: DataFrame, unwanted: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Drop the lines whose key is in ``unwanted``; ``narrow`` holds the keys of each row's lines."""
    placed = narrow.select("doc_id", "mark", F.posexplode("keys").alias("at", "line_key")).filter("line_key IS NOT NULL")
    dropped = (
        placed.join(unwanted, "line_key", "left_semi")
        .groupBy(F.col("doc_id").alias("d_id"), F.col("mark").alias("d_mark"))
        .agg(F.collect_set("at").alias("gone"))
    )
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), text_digest(quoted(text)).alias("mark"))
    met = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")), "left")
    lines = lines_of(F.col("text"))
    # array_except and transform are linear in the number of lines
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(lines, i)), "\n")
    return met.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )
