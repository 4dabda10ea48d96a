"""Workload summaries, layout comparison and timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import directory as d
from ..operators.layouts import KeyChunks, Layout, Position
from .runtime import cut_lineage
from .stored import StoredLayout


def hits_of(pairs: DataFrame) -> DataFrame:
    """``(qid, n_results)`` of queries with a hit, from pairs; ``operators.counts`` has the same without pairs."""
    return pairs.groupBy("qid").agg(F.count("value").alias("n_results"))


def per_query(hits: DataFrame, queries: DataFrame, *, qid: str = "qid") -> DataFrame:
    """``(qid, n_results)`` for every query; one without a hit counts 0.

    ``hits`` are counts of queries with a hit, or pairs ``(qid, value)``, which are counted per task before the shuffle.
    """
    hits = hits if "n_results" in hits.columns else hits_of(hits)
    asked = queries.select(F.col(qid).alias("qid"))
    return asked.join(hits, "qid", "left").select("qid", F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"))


def _counted(df: DataFrame, name: str, names: tuple[str, ...]) -> DataFrame:
    counts = [(F.count(F.lit(1)) if n == name else F.lit(0)).cast("bigint").alias(n) for n in names]
    return df.agg(*counts)


def summary(
    data: DataFrame,
    queries: DataFrame,
    found: DataFrame,
    *,
    algorithm: str,
    workload: str,
    extra: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """One row: sizes, total hits and hits per query (0.0 without queries).

    ``found`` holds counts ``(qid, n_results)`` or pairs ``(qid, value)``.
    """
    names = ("n_items", "num_queries", "total_results")
    parts = [_counted(df, n, names) for df, n in zip((data, queries), names)]
    if "n_results" in found.columns:
        total = F.coalesce(F.sum("n_results"), F.lit(0)).cast("bigint").alias("total_results")
        parts.append(found.agg(*(F.lit(0).cast("bigint").alias(n) for n in names[:2]), total))
    else:
        parts.append(_counted(found, "total_results", names))
    totals = reduce(DataFrame.unionByName, parts).agg(*(F.sum(n).alias(n) for n in names))
    average = F.when(F.col("num_queries") > 0, F.col("total_results") / F.col("num_queries")).otherwise(F.lit(0.0))
    entries = []
    for key, value in (extra or {}).items():
        entries += [F.lit(key), (value if isinstance(value, Column) else F.lit(str(value))).cast("string")]
    extras = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return totals.select(
        F.lit(algorithm).alias("algorithm"),
        F.lit(workload).alias("workload"),
        *names,
        average.alias("avg_results"),
        extras.alias("extra"),
    )


def family(rows: list[DataFrame]) -> DataFrame:
    """Summaries of several workloads as one table."""
    return reduce(DataFrame.unionByName, rows)


def layout_shape(laid_out: DataFrame, layout: Layout, queries: DataFrame, at: Position) -> DataFrame:
    """One row: pruning figures of a layout for a query table."""
    if isinstance(layout, KeyChunks):
        directory = d.key_directory(laid_out, key=at.columns[0], n_cells=layout.n_cells)
    else:
        directory = d.mbr_directory(laid_out, sides=at.sides)
    names = set(queries.columns)
    if "k" in names:
        routed = d.route_keys(queries, layout.cell_of(F.col("k")))
    elif "low" in names:
        routed = d.route_key_ranges(queries, directory)
    elif "px" in names:
        routed = d.route_points(queries, directory)
    else:
        routed = d.route_rects(queries, directory)
    return d.pruning(directory, routed, queries)


def compare(settings: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """One table over several settings; each function returns a row set, tagged with its setting."""
    rows = [build().select(F.lit(name).alias("setting"), "*") for name, build in settings.items()]
    return reduce(DataFrame.unionByName, rows)


def tally(pairs: DataFrame) -> DataFrame:
    """``(qid, n_results, digest)``, stored: hits of each query and a 128-bit digest of their values, copies counted.

    Sums of hashes do not depend on the order, so they are formed before the shuffle, which moves no pairs.
    """
    low = F.lit((1 << 32) - 1)
    lanes = []
    for seed in (0, 1):
        code = F.xxhash64("value", F.lit(seed))
        lanes += [F.try_sum(code.bitwiseAND(low)), F.try_sum(F.shiftrightunsigned(code, 32))]
    return cut_lineage(pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_results"), F.array(*lanes).alias("digest")))


def answers_differ(left: DataFrame, right: DataFrame, *, tallies: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row ``(missing, surplus)``: pairs only in one of two answers, copies counted.

    Queries whose ``tally`` is the same on both sides have the same answers; the pairs of all others are compared one by one.
    """
    mine, other = tallies or (tally(left), tally(right))
    named = other.select(F.col("qid").alias("__qid"), F.col("n_results").alias("__n"), F.col("digest").alias("__digest"))
    lanes = [F.col("digest")[i] == F.col("__digest")[i] for i in range(4)]
    same = reduce(lambda a, b: a & b, lanes, F.col("n_results") == F.col("__n"))  # null on one side, or after an overflow: not the same
    met = mine.join(named, F.col("qid").eqNullSafe(F.col("__qid")), "full").filter(~F.coalesce(same, F.lit(False)))
    asked = cut_lineage(met.select(F.when(F.col("__n").isNull(), F.col("qid")).otherwise(F.col("__qid")).alias("__asked")))
    zero = F.lit(0).cast("bigint")
    if asked.isEmpty():
        return asked.sparkSession.range(1).select(zero.alias("missing"), zero.alias("surplus"))
    tagged = left.select("qid", "value", F.lit(1).alias("side")).unionByName(
        right.select("qid", "value", F.lit(-1).alias("side"))
    )
    tagged = tagged.join(asked, F.col("qid").eqNullSafe(F.col("__asked")), "left_semi")
    balance = tagged.groupBy("qid", "value").agg(F.sum("side").alias("balance"))
    over = F.sum(F.greatest("balance", F.lit(0)))
    under = F.sum(F.greatest(-F.col("balance"), F.lit(0)))
    return balance.agg(F.coalesce(over, zero).alias("missing"), F.coalesce(under, zero).alias("surplus"))


def seconds(df: DataFrame) -> float:
    """Wall-clock seconds to compute ``df`` in full, keeping nothing."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed(
    build: Callable[[], StoredLayout], queries: DataFrame, *, algorithm: str, workload: str
) -> DataFrame:
    """A summary row with ``build_seconds``, ``query_total_seconds``, ``query_avg_seconds``.

    What ``build`` stores is what the batch of ``queries`` is then answered from.
    """
    start = time.perf_counter()
    stored = build()
    build_seconds = time.perf_counter() - start
    pairs = stored.match(queries)
    query_seconds = seconds(pairs)
    row = summary(stored.data(), queries, pairs, algorithm=algorithm, workload=workload)
    per = F.when(F.col("num_queries") > 0, F.lit(query_seconds) / F.col("num_queries")).otherwise(F.lit(0.0))
    return row.select(
        "*",
        F.lit(build_seconds).alias("build_seconds"),
        F.lit(query_seconds).alias("query_total_seconds"),
        per.alias("query_avg_seconds"),
    )
