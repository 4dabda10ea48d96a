"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of ``n`` bits is cut into few, long segments, so few that two near
fingerprints differ by at most one bit in one of them.  For each bit of each
segment the variant *without* that bit is indexed: two segments that differ by at
most one bit share a variant.  Rows that share a variant meet in an equi-join and
are verified by the bits in which their whole fingerprints differ.

With ``s`` segments and at most ``2s - 1`` differing bits no pair is missed.

Copies are folded first: the index holds each fingerprint once, and a class of
equal fingerprints is one node.  A variant shared by more than ``pair_limit``
fingerprints is not expanded into pairs.  There, with two segments and two
differing bits, fingerprints are grouped by two-bit-deletion keys instead: any two
of one group differ by at most two bits, and any two that do are in one group, so
linking each to the smallest of its group gives the same components exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_merge, map_frames, quoted, text_digest, written
from .components import connected_components
from .shingles import hashes, remixed, shingles, words

PAIR_LIMIT = 64


@dataclass(frozen=True)
class Spec:
    """What is fingerprinted and when two fingerprints link; 64 bits in two segments, so no linked pair escapes the index."""

    words: int = 3  # words per shingle
    lanes: int = 1  # 64-bit words of the fingerprint
    most_bits: int = 2  # differing bits at which fingerprints still link
    segment_bits: int = 32
    segments: int = 2


#: Three-word shingles, 64 bits, two segments: links at two or fewer bits, none missed.
EXACT = Spec()


def majority_bits(features: np.ndarray, lanes: int) -> np.ndarray:
    """Bits set in over half of the features, ``64 * lanes`` of them, low bit first; none for no features."""
    if not len(features):
        return np.zeros(64 * lanes, dtype=np.uint8)
    counts = np.zeros(64 * lanes, dtype=np.int64)
    for start in range(0, len(features), 65_536):  # bounds the memory of a very long text
        block = features[start : start + 65_536]
        for lane in range(lanes):
            raw = remixed(block, lane).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[64 * lane : 64 * lane + 64] += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * counts > len(features)).astype(np.uint8)


def _packed(bits: np.ndarray, width: int) -> list[int]:
    """Numbers of ``width`` bits, as signed 64-bit ones."""
    rows = np.zeros((len(bits) // width, 64), dtype=np.uint8)
    rows[:, :width] = bits[: len(rows) * width].reshape(len(rows), width)
    return np.packbits(rows, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64).tolist()


def fingerprint(text: str | None, spec: Spec = EXACT) -> tuple[list[int], list[int]]:
    """The fingerprint in 64-bit words, and its segments."""
    bits = majority_bits(hashes(shingles(words(text), spec.words)), spec.lanes)
    return _packed(bits, 64), _packed(bits, spec.segment_bits)


def fingerprints(docs: DataFrame, spec: Spec = EXACT, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, lanes, parts, node)``; ``node`` stands for the class of equal fingerprints.

    ``mark`` tells rows of one id apart by their text.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [fingerprint(t, spec) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "mark": frame["mark"], "lanes": [b[0] for b in both], "parts": [b[1] for b in both]})

    rows = docs.select(
        quoted(doc_id).alias("doc_id"), text_digest(quoted(text)).alias("mark"), quoted(text).cast("string").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = map_frames(rows, batches, f"doc_id {kind}, mark bigint, lanes array<bigint>, parts array<bigint>")
    return written(made.select("doc_id", "mark", "lanes", "parts", F.element_at("lanes", 1).alias("node")), "simhash")


def _variants(nodes: DataFrame, spec: Spec) -> DataFrame:
    """``(node, key)``: for each bit of each segment the segment without it, and where that was."""
    places = spec.segments * spec.segment_bits
    spread = nodes.select("node", "parts", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"))
    segment = F.element_at("parts", F.floor(F.col("place") / spec.segment_bits).cast("int") + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(spec.segment_bits)).cast("int"))
    kept = segment.bitwiseAND(F.bitwise_not(bit))
    return spread.select("node", F.call_function("shiftleft", F.col("place").cast("bigint"), F.lit(spec.segment_bits)).bitwiseOR(kept).alias("key"))


def _pairs(members: DataFrame, spec: Spec) -> DataFrame:
    """Verified links ``(a, b)`` among nodes that share a variant."""
    left = members.select("key", F.col("node").alias("a"))
    right = members.select("key", F.col("node").alias("b"))
    met = by_merge(left).join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")))
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= spec.most_bits).select("a", "b").distinct()


def _without(value: Column, *places: Column) -> Column:
    for place in places:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))
        value = value.bitwiseAND(F.bitwise_not(bit))
    return value


def _stars(crowd: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of crowded variants of the 64-bit, two-segment form.

    A crowded key says which segment and which bit of it were cut.  One more bit
    of the other segment covers the pairs that differ once in each; two bits of
    the other segment cover the pairs that are equal in this one.
    """
    place = F.floor(F.col("key") / (1 << 32)).cast("int")
    other = F.when(place < 32, F.lit(32)).otherwise(F.lit(0))
    once = crowd.select("node", place.alias("i"), F.explode(F.sequence(other, other + 31)).alias("j"))
    sides = crowd.select("node", other.alias("low")).distinct()
    twice = sides.select("node", "low", F.explode(F.sequence(F.col("low"), F.col("low") + 30)).alias("i")).select(
        "node", "i", F.explode(F.sequence(F.col("i") + 1, F.col("low") + 31)).alias("j")
    )
    cut = once.union(twice).select("node", "i", "j", _without(F.col("node"), F.col("i"), F.col("j")).alias("rest"))
    keys = [F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "rest"]
    keyed = cut.select("node", *keys)
    smallest = keyed.groupBy("p", "q", "rest").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most")
    return by_merge(keyed).join(smallest, ["p", "q", "rest"]).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def node_links(nodes: DataFrame, spec: Spec = EXACT, *, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links ``(a, b)`` among classes ``(node, parts)`` of equal fingerprints that join all near ones."""
    variants = _variants(nodes, spec)
    # counted map-side first and joined back: a variant that many nodes share is dealt to several tasks
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(by_merge(variants).join(shared, "key").select("node", "key", "n"), "simhash-members")
    links = _pairs(members.filter(F.col("n") <= pair_limit), spec)
    return links.union(_stars(members.filter(F.col("n") > pair_limit)))


def node_roots(marked: DataFrame, spec: Spec = EXACT, *, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``(node, root)``: each class of equal fingerprints with the first row linked to it.

    ``root`` is a struct (missing, doc_id, mark): rows without an id come last.
    """
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    nodes = written(
        marked.groupBy("node").agg(F.min(row).alias("least"), F.first("lanes").alias("lanes"), F.first("parts").alias("parts")),
        "simhash-nodes",
    )
    roots = connected_components(node_links(nodes, spec, pair_limit=pair_limit))
    joined = nodes.select("node", "least").join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    labelled = written(joined.select("node", "least", F.coalesce("root", "node").alias("label")), "simhash-labels")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("root"))
    return written(labelled.join(smallest, "label").select("node", "root"), "simhash-roots")


def simhash_groups(
    docs: DataFrame, spec: Spec = EXACT, *, doc_id: str = "doc_id", text: str = "text", pair_limit: int = PAIR_LIMIT
) -> DataFrame:
    """``(doc_id, lanes, component_id)`` for every row; ``component_id`` is the smallest id of its group.

    A null or blank text has fingerprint zero, which links like any other; so does
    an id that repeats.  Null ids count as the largest.  A group of null ids only
    has a null ``component_id``.  An empty table gives an empty result.
    """
    marked = fingerprints(docs, spec, doc_id=doc_id, text=text)
    roots = node_roots(marked, spec, pair_limit=pair_limit)
    named = roots.select(F.col("node").alias("m"), F.col("root.doc_id").alias("component_id"))
    return marked.join(named, F.col("node") == F.col("m"), "left").select("doc_id", "lanes", "component_id")
