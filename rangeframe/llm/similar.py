"""Near copies: all pairs of texts whose sets of five-word shingles are alike by 0.8 or more (Jaccard).

Shingles get one order for all texts, rare ones first.  In any such order two sets
that are alike by 0.8 share one of the first fifth of their shingles, for if they
shared none there, too few would be left.  So each text is indexed by all of these, pairs that
share one are candidates, and the shingles of both texts decide.  Nothing is
estimated, so neither the kind of the edits nor their place matters.

How rare a shingle is comes from a count sketch: a fixed number of slots, each with the number of
texts' shingles that fall into it.  Rare shingles that share a slot with a common one pass for common.
That is the same for every text and changes the order, not the result.  The
index grows as the texts do: a fifth of their shingles, of which those that one text alone has
go once they are counted.

Before that the texts are searched by SimHash: fingerprints of three-word shingles, indexed by
their one-bit-deletion variants, and the shingles of both texts decide here as well.  SimHash alone would lose pairs
(two of 64 bits is stricter than a similarity of 0.8), so the index of shingles looks for what it leaves apart.

Texts with the same set of shingles are one node.  Where a shingle is shared by many
nodes, a few links per node come first.  What they join need not be
compared any more; all members of different groups are then compared, whatever the
size of the crowd, which is dealt out in pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import by_merge, map_frames, quoted, text_digest, written
from .components import connected_components, more_components
from .shingles import hashes, shingles, words

WORDS = 5
ALIKE = (4, 5)  # the least Jaccard similarity, as a fraction
SKETCH_BITS = 20  # the sketch has two to this power slots, four bytes each
_CHUNK = 1 << 14  # slots that are summed together
CROWD = 8  # members of a shingle from which a few links come first
PIECE = 64  # members of a crowd that are ordered together
BLOCK = 1024  # members of a crowd that are compared together


def _marks(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(hashes(shingles(words(text), WORDS)))


def alike(a: frozenset, b: frozenset) -> bool:
    """Whether the Jaccard similarity is at least ``ALIKE``, in whole numbers."""
    part, whole = ALIKE
    return (part + whole) * len(a & b) >= part * (len(a) + len(b))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, mark, node)``; ``node`` stands for the class of equal sets of shingles."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes = [xxhash.xxh64_intdigest(_marks(t).astype("<u8").tobytes()) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "mark": frame["mark"], "node": np.array(nodes, dtype=np.uint64).view(np.int64)})

    rows = docs.select(
        quoted(doc_id).alias("doc_id"), text_digest(quoted(text)).alias("mark"), quoted(text).cast("string").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(map_frames(rows, batches, f"doc_id {kind}, mark bigint, node bigint"), "similar")


def _node_texts(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(node, text)``: one text of each class."""
    rows = docs.select(quoted(doc_id).alias("row_id"), text_digest(quoted(text)).alias("row_mark"), quoted(text).cast("string").alias("text"))
    least = nodes.select("node", F.col("least.doc_id").alias("f_id"), F.col("least.mark").alias("f_mark"))
    met = rows.join(least, F.col("row_id").eqNullSafe(F.col("f_id")) & (F.col("row_mark") == F.col("f_mark")))
    texts = written(met.select("node", "text"), "similar-texts")
    if texts.count() > nodes.count():  # rows alike in id and text
        texts = written(texts.dropDuplicates(["node"]), "similar-texts")
    return texts


def _sketch(texts: DataFrame) -> np.ndarray:
    """Shingles of all texts in each slot of the sketch.

    A task counts what it reads and sends one sketch; these are summed in Spark, by parts of the sketch, in
    two steps.  The sum, whose size is fixed, reaches the driver.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for frame in frames:
            every = np.concatenate([_marks(t) for t in frame["text"]])
            total += np.bincount(_slot(every), minlength=len(total)).astype(np.uint32)
        parts = [part.tobytes() for part in total.reshape(-1, _CHUNK)]
        yield pd.DataFrame({"part": range(len(parts)), "salt": zlib.crc32(parts[0]) % 64, "n": parts})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, n in zip(frame["part"], frame["n"]):
                total[part] = total.get(part, 0) + np.frombuffer(n, dtype=np.uint32)
        yield pd.DataFrame({"part": list(total), "salt": 0, "n": [n.tobytes() for n in total.values()]})

    schema = "part int, salt int, n binary"
    sums = map_frames(texts.select("text"), count, schema)
    for keys in (["part", "salt"], ["part"]):
        sums = map_frames(sums.repartition(*keys), add, schema)
    held = np.zeros((1 << SKETCH_BITS) // _CHUNK * _CHUNK, dtype=np.uint32)
    for row in sums.collect():  # one row per part
        held[row["part"] * _CHUNK : (row["part"] + 1) * _CHUNK] = np.frombuffer(row["n"], dtype=np.uint32)
    return held


def _slot(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _members(texts: DataFrame) -> DataFrame:
    """``(node, size, at, key, n)``: the indexed shingles of each node, their place in its order and how many nodes share them."""
    rarity = texts.sparkSession.sparkContext.broadcast(_sketch(texts))
    part, whole = ALIKE

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for node, text in zip(frame["node"], frame["text"]):
                h = _marks(text)
                n = len(h)
                first = np.lexsort((h, rarity.value[_slot(h)]))[: n - -(-part * n // whole) + 1]
                made.append(pd.DataFrame({"node": node, "size": n, "at": np.arange(len(first)), "key": h[first].view(np.int64)}))
            yield pd.concat(made)

    keys = written(map_frames(texts, batches, "node bigint, size int, at int, key bigint"), "similar-keys")
    # written, so that the planner knows how few keys are shared before it joins them
    counted = written(keys.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "similar-shared")
    return written(by_merge(keys).join(counted, F.col("key") == F.col("k")).drop("k"), "similar-members")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose shingles are alike."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = lru_cache(maxsize=64)(lambda text: frozenset(shingles(words(text), WORDS)))
        for frame in frames:
            yield frame.loc[[alike(sets(a), sets(b)) for a, b in zip(frame["a_text"], frame["b_text"])], ["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    met = pairs.join(first, "a").join(second, "b").select("a", "b", "a_text", "b_text")
    return written(map_frames(met, batches, "a bigint, b bigint"), "similar-links")


def _possible(x: DataFrame, y: DataFrame, on) -> DataFrame:
    """Distinct pairs ``(a, b)`` of members of a key that may be alike.

    Behind the first shingle that two sets share, both must have enough left.  The pair's
    first one passes, so no pair is lost.
    """
    part, whole = ALIKE
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    enough = (part + whole) * left >= part * (F.col("x_size") + F.col("y_size"))
    met = by_merge(x).join(y, on & enough & (F.col("x") != F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _side(members: DataFrame, name: str) -> DataFrame:
    return members.select([F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in members.columns])


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of texts whose SimHash fingerprints are near and whose shingles are alike.

    Texts of one fingerprint meet its smallest node, which also meets those of the fingerprints near it.
    """
    marked = simhash.fingerprints(texts, doc_id="node")
    # the class's number is its fingerprint, so the parts of all its rows are the same
    classes = marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("parts").alias("parts"))
    classes = written(classes, "similar-prints")
    named = [classes.select(F.col("node").alias(side), F.col("first").alias(f"first_{side}")) for side in "ab"]
    near = simhash.node_links(classes).join(named[0], "a").join(named[1], "b").select("first_a", "first_b")
    equal = marked.join(classes.select("node", "first"), "node").filter("doc_id <> first").select("first", "doc_id")
    pairs = near.union(equal).toDF("a", "b")
    return _confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts)


def _neighbours(members: DataFrame, texts: DataFrame, crowd_from: int) -> DataFrame:
    """Links of each member of a crowd with the next one, in an order of each key's own."""
    crowd = members.filter(F.col("n") > crowd_from)
    order = F.xxhash64("node", "key")
    piece = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("n") / PIECE))
    window = Window.partitionBy("key", "piece").orderBy("order", "node")
    met = crowd.select("key", "node", order.alias("order"), piece.alias("piece")).select(F.col("node").alias("x"), F.lead("node").over(window).alias("y"))
    pairs = met.filter("y IS NOT NULL").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _confirmed(pairs, texts)


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the keys that still hold several groups, with their group: ``label``, and the key's largest ``top``."""
    joined = roots.withColumnRenamed("node", "m")
    with_label = members.join(joined, F.col("node") == F.col("m"), "left").select(*members.columns, F.coalesce("root", "node").alias("label"))
    with_label = written(with_label, "similar-labels")
    per_group = with_label.groupBy(F.col("key").alias("k"), "label").agg(F.count(F.lit(1)).alias("members"))
    mixed = per_group.groupBy("k").agg(F.max(F.struct("members", "label")).getField("label").alias("top"), F.count(F.lit(1)).alias("groups"))
    return written(by_merge(with_label).join(mixed.filter("groups > 1"), F.col("key") == F.col("k")).drop("k", "groups"), "similar-mixed")


def _spokes(members: DataFrame, links: DataFrame, roots: DataFrame, texts: DataFrame, crowd_from: int) -> DataFrame:
    """Links of a crowd's members with its most linked one, which is near the crowd's original."""
    crowd = _labelled(members, roots).filter(F.col("n") > crowd_from)
    ends = links.select(F.col("a").alias("end")).union(links.select(F.col("b").alias("end")))
    degrees = ends.groupBy("end").agg(F.count(F.lit(1)).alias("links"))
    ranked = crowd.join(degrees, F.col("node") == F.col("end"))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("links", "node", "size", "at", "label")).alias("hub")).select("key", "hub.*")
    apart = (F.col("x_key") == F.col("y_key")) & (F.col("x_label") != F.col("y_label"))
    return _confirmed(_possible(_side(crowd, "x"), _side(hubs, "y"), apart), texts)


def _rest(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among all members of a key that are in different groups.

    Those outside the key's largest group meet all others.  The others are cut into
    blocks, to each of which the former are copied.
    """
    mixed = _labelled(members, roots)
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    copied = mixed.filter("label <> top").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    once = (F.col("y_label") == F.col("y_top")) | (F.col("x") < F.col("y"))
    apart = (F.col("x_key") == F.col("y_key")) & (F.col("x_block") == F.col("y_block")) & (F.col("x_label") != F.col("y_label")) & once
    return _confirmed(_possible(_side(copied, "x"), _side(dealt, "y"), apart), texts)


def similar_roots(texts: DataFrame, crowd_from: int = CROWD) -> DataFrame:
    """``(node, root)``: the groups that all pairs give that are alike, of the nodes that have such a pair.

    Groups are kept from step to step, so each step's links are met once.
    """
    links = fingerprint_links(texts)
    members = _members(texts)
    links = links.union(_neighbours(members, texts, crowd_from))
    roots = connected_components(links)
    roots = more_components(roots, _spokes(members, links, roots, texts, crowd_from))
    return more_components(roots, _rest(members, roots, texts))


def first_of_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", pair_limit: int = CROWD) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns: the one of the smallest id.

    Shingles shared by more than ``pair_limit`` texts get a few links first, which
    does not change the groups.  Rows of one id are told apart by their text; of rows alike in
    both, one stays.  Null ids come last.  Null and blank texts are one group.
    """
    marked = _marked(docs, doc_id, text)
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark")
    nodes = written(marked.groupBy("node").agg(F.min(row).alias("least")), "similar-nodes")
    roots = similar_roots(_node_texts(docs, nodes, doc_id, text), pair_limit)
    joined = nodes.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    groups = joined.groupBy(F.coalesce("root", "node").alias("label")).agg(F.min("least").alias("first"))
    firsts = written(groups.select(F.col("first.doc_id").alias("g_id"), F.col("first.mark").alias("g_mark")), "similar-firsts")
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark"))
    kept = marked.join(firsts, same).groupBy(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark")).agg(F.count(F.lit(1)).alias("f_n"))
    kept = written(kept, "similar-firsts")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(doc_id).alias("row_id"), text_digest(quoted(text)).alias("row_mark"))
    met = rows.join(kept, F.col("row_id").eqNullSafe(F.col("f_id")) & (F.col("row_mark") == F.col("f_mark")))
    single = met.filter("f_n = 1").select("row.*")
    if kept.filter("f_n > 1").isEmpty():
        return single
    return single.union(met.filter("f_n > 1").dropDuplicates(["row_id", "row_mark"]).select("row.*"))
