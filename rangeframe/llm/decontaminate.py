"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of thirty shingles inside a document of thirty thousand has a Jaccard
similarity near zero with it, so MinHash of whole documents does not see it.
Here sizes are made alike instead.  Items are partitioned by size, in powers of
two; for each partition that has items, documents are cut into windows of that
many shingles.  An item and a window that holds it, or a large part of it, then
have comparable sizes, and one of ``functions`` minima agrees almost surely.  An item
that is cut by a window's edge, or scattered over the document, has as many
agreeing minima in expectation, spread over several windows.

For an item of ``n`` shingles with four fifths of them in a document, a single
minimum agrees with chance 0.15 or more in each of two windows in the worst case
(the item half the window, cut in the middle); with 48 functions all fail with a
chance below one in a million.

Candidates are verified by exact containment: the item's distinct shingles that
the document has, by their words.

What is sent to the tasks is two bit filters, over the items' minima and over their shingles, sized by the
number of these up to a fixed bound; what passes them meets the items in equi-joins.  Texts are read once and never shuffled.

Items are told apart by their set of shingles, not by their id, which may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import row_count_up_to
from .common import by_merge, map_frames, quoted, text_digest, written
from .shingles import hashes, remixed, shingles, words

WORDS = 5
LEAST_CONTAINMENT = 0.8
FUNCTIONS = 48
BITS_PER_VALUE = 16  # of a filter; its length is the next power of two
MOST_FILTER_BITS = 26  # two to this power, 8 MB; with more values more pass, and the joins sort them out
LEAST_WINDOW = 3  # windows have at least two to this power shingles
BROADCAST_ROWS = 100_000  # of the items' minima or shingles; with more of them the documents' ones are merged with them
_PROBES = 4

_RANDOM = np.random.Generator(np.random.PCG64(20))
_SALT = _RANDOM.integers(0, 1 << 63, size=1024, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 63, size=1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _permuted(values: np.ndarray, function: int) -> np.ndarray:
    return (values ^ _SALT[function]) * _ODD[function]


def window_power(n: int) -> int:
    """Power of two of the windows in which an item of ``n`` shingles is sought."""
    return max(LEAST_WINDOW, int(n - 1).bit_length())


def _positions(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The filter positions of each value, one array per probe."""
    return [(remixed(values, probe + 1) >> np.uint64(64 - bits)).astype(np.int64) for probe in range(_PROBES)]


def _passing(values: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the values that may be in the filter."""
    at = np.arange(len(values))
    for probe in range(_PROBES):
        place = (remixed(values[at], probe + 1) >> np.uint64(64 - bits)).astype(np.int64)
        at = at[(held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
    return at


def prepared_items(items: DataFrame, *, item_id: str = "item_id", text: str = "text", size: int = WORDS, functions: int = FUNCTIONS):
    """Items by their set of shingles: ``(content, item_id, n_copies, n_shingles, power, shingles, minima)``.

    Items with the same set are one class, ``content``; it shows the smallest id of its items, null if none has
    one.  Items without a word hold nothing that could leak and are left out.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame["item_id"], frame["text"]):
                own = sorted(set(shingles(words(content), size)))
                if own:
                    h = hashes(own)
                    minima = [int(_permuted(h, i).min().astype(np.int64)) for i in range(functions)]
                    rows.append((key, [s.decode("utf-8", "replace") for s in own], h.astype(np.int64).tolist(), minima, window_power(len(own))))
            yield pd.DataFrame(rows, columns=["item_id", "shingles", "marks", "minima", "power"])

    picked = items.select(quoted(item_id).alias("item_id"), quoted(text).cast("string").alias("text"))
    kind = picked.schema["item_id"].dataType.simpleString()
    made = map_frames(picked, batches, f"item_id {kind}, shingles array<string>, marks array<bigint>, minima array<bigint>, power int"
    )
    same = made.groupBy(F.sha2(F.array_join("shingles", "\n"), 256).alias("content")).agg(
        F.min("item_id").alias("item_id"),
        F.count(F.lit(1)).alias("n_copies"),
        *(F.first(c).alias(c) for c in ("shingles", "marks", "minima", "power")),
    )
    return written(same.select("*", F.size("shingles").cast("bigint").alias("n_shingles")), "leak-items")


def _filter_bits(n_values: int) -> int:
    return min(MOST_FILTER_BITS, max(10, (BITS_PER_VALUE * n_values).bit_length()))


def _bit_filter(values: DataFrame, bits: int) -> np.ndarray:
    """The filter over a column ``value``, built in Spark; at most ``2**bits`` bits reach the driver."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = np.concatenate(_positions(frame["value"].to_numpy(np.int64).view(np.uint64), bits))
            yield pd.DataFrame({"slot": place >> 5, "mask": np.left_shift(1, place & 31)})

    rows = map_frames(values, batches, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    held = np.zeros(1 << (bits - 5), dtype="<u4")
    held[rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return held.view(np.uint8)


def _beside(of_items: DataFrame) -> DataFrame:
    """A table of items, to be joined with exploded rows of documents, which the planner sizes too low to choose."""
    return F.broadcast(of_items) if row_count_up_to(of_items, BROADCAST_ROWS) <= BROADCAST_ROWS else by_merge(of_items)


def _window_minima(h: np.ndarray, lengths: np.ndarray, powers: list[int], functions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Minima of all windows of all texts of a chunk, as ``(text number, minimum)`` arrays.

    ``h`` holds the texts' shingle hashes one after the other.  Windows of each
    power come from those of the power below, two by two.
    """
    n_windows = -(-lengths // (1 << powers[0]))
    owner = np.repeat(np.arange(len(lengths)), n_windows)
    first = np.repeat(np.cumsum(lengths) - lengths, n_windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = first + (number << powers[0])
    steps = []
    for _ in range(powers[0], powers[-1]):
        upper = -(-n_windows // 2)
        up_owner = np.repeat(np.arange(len(lengths)), upper)
        up_number = np.arange(len(up_owner)) - np.repeat(np.cumsum(upper) - upper, upper)
        steps.append((up_owner, np.repeat(np.cumsum(n_windows) - n_windows, upper) + 2 * up_number))
        n_windows = upper
    for function in range(functions):
        minima = np.minimum.reduceat(_permuted(h, function), starts)
        at_owner = owner
        yield at_owner, minima
        for power, (up_owner, up_starts) in enumerate(steps, powers[0] + 1):
            minima, at_owner = np.minimum.reduceat(minima, up_starts), up_owner
            if power in powers:
                yield at_owner, minima


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WORDS,
    least: float = LEAST_CONTAINMENT,
    functions: int = FUNCTIONS,
    filter_bits: int | None = None,
) -> DataFrame:
    """``(doc_id, mark, item_id, n_copies, n_shared, n_shingles, containment)`` per document and leaked class of items.

    A pair is returned when at least ``least`` of the item's distinct shingles are
    in the document.  ``mark`` tells documents of one id apart; rows alike in id and
    text give one row.  ``item_id`` stands for its ``n_copies`` items of the same
    shingles; items of one id, or without one, that differ in shingles are judged and shown one by one.  A text of fewer than ``size`` words has one shingle, all its words; null and
    blank texts have none and match nothing.  Empty tables give an empty result.
    """
    prepared = prepared_items(items, item_id=item_id, text=item_text, size=size, functions=functions)
    powers = sorted(r["power"] for r in prepared.select("power").distinct().collect())  # at most 32
    minima = prepared.select("content", F.explode("minima").alias("value"))
    if filter_bits is None:
        filter_bits = _filter_bits(prepared.agg(F.sum(F.greatest("n_shingles", F.size("minima"))).alias("n")).first()["n"] or 0)
    context = docs.sparkSession.sparkContext
    of_minima = context.broadcast(_bit_filter(minima.select("value"), filter_bits))
    of_shingles = context.broadcast(_bit_filter(prepared.select(F.explode("marks").alias("value")), filter_bits))

    def searched(ids, marks, texts) -> pd.DataFrame:
        """Hits of some texts: agreeing minima, and the shingles that items may have."""
        own = [shingles(words(t), size) for t in texts]
        lengths = np.array([len(s) for s in own], dtype=np.int64)
        h = hashes([s for part in own for s in part])
        hits: dict[int, set[int]] = {}
        if len(h) and powers:
            for owner, values in _window_minima(h, lengths, powers, functions):
                for at in _passing(values, of_minima.value, filter_bits).tolist():
                    hits.setdefault(int(owner[at]), set()).add(int(values[at].astype(np.int64)))
        ends = np.cumsum(lengths)
        rows = []
        for number in sorted(hits):
            mine = h[ends[number] - lengths[number] : ends[number]]
            seen = {own[number][at].decode("utf-8", "replace") for at in _passing(mine, of_shingles.value, filter_bits).tolist()}
            rows.append((ids[number], marks[number], sorted(hits[number]), sorted(seen)))
        return pd.DataFrame(rows, columns=["doc_id", "mark", "hits", "shared"])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield searched(list(frame["doc_id"]), list(frame["mark"]), list(frame["text"]))

    rows = docs.select(
        quoted(doc_id).alias("doc_id"), text_digest(quoted(text)).alias("mark"), quoted(text).cast("string").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = map_frames(rows, batches, f"doc_id {kind}, mark bigint, hits array<bigint>, shared array<string>")
    found = written(found, "leak-hits")
    found = found.dropDuplicates(["doc_id", "mark"])

    candidates = (
        found.select("doc_id", "mark", F.explode("hits").alias("value")).join(_beside(written(minima, "leak-minima")), "value")
        .select(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark"), F.col("content").alias("c_content")).distinct()
    )
    by_shingle = written(prepared.select("content", F.explode("shingles").alias("shingle")), "leak-shingles")
    shared = (
        found.select("doc_id", "mark", F.explode("shared").alias("shingle"))
        .join(_beside(by_shingle), "shingle")
        .groupBy("doc_id", "mark", "content")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")) & (F.col("content") == F.col("c_content"))
    verified = shared.join(candidates, same, "left_semi")
    sizes = written(prepared.select("content", "item_id", "n_copies", "n_shingles"), "leak-sizes")
    counted = verified.join(sizes, "content")
    share = F.col("n_shared").cast("double") / F.col("n_shingles").cast("double")
    return counted.select("doc_id", "mark", "item_id", "n_copies", "n_shared", "n_shingles", share.alias("containment")).filter(
        F.col("containment") >= least
    )


def without_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay."""
    leaks = find_leaks(docs, items, doc_id=doc_id, text=text, **options)
    bad = written(leaks.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "leak-docs")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text_digest(quoted(text)).alias("row_mark"), quoted(doc_id).alias("row_id"))
    same = F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_mark") == F.col("bad_mark"))
    return rows.join(bad, same, "left_anti").select("row.*")
