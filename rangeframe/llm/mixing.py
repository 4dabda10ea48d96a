"""Mixing sources to target weights by Pareto order sampling.

1. Sources in code point order (null last) get repeating weights and share all
   words; a target stops at ``max_copies`` times the source's size and the excess
   goes to the other sources by weight, until none is above.
2. Inside a source a document's expected copies are ``min(max_copies, c * preference)``
   with the one ``c`` that meets the target.  Whole copies are certain; the rest is
   an inclusion probability, unequal between documents of unequal preference.
3. Documents are ranked by random odds divided by inclusion odds (Pareto order
   sampling), and the first ones are taken as long as the words left over hold
   them.  The words then missing, less than the next document has, are filled in
   falling size by the first-ranked documents of each order of magnitude that fit
   (16 lots for each number of binary digits, so a bounded list per source).

Random numbers are digests of the document, so reruns agree, and all sums are
integers, so they do not depend on the order of rows.

A source of any size is ranked without being gathered: words are summed per
source and wide slice of the ranking, a window over those finds the one where the
target is reached, that one is cut into fine slices likewise, and only the rows
of the one fine slice are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, unit_from_hex, word_count, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FINE_BITS = 10
SLICES = 1 << 20  # of the ranking: a thousand wide ones, each of a thousand fine ones


def length_preference(size: Column) -> Column:
    """Binary digits of the size: a document a thousand times longer counts ten more."""
    return F.length(F.bin(size)).cast("bigint")


def document_facts(text: Column, doc_id: Column, source: Column) -> dict[str, Column]:
    """Size, preference and random digest of a document."""
    size = word_count(text)
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit(""))))
    return {"source": source.cast("string"), "size": size, "preference": length_preference(size), "digest": digest}


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    The windows run over the sources, which are few against the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1).cast("bigint")
    weighed = sizes.select("source", "source_size", weight.alias("weight"))
    # sources in the order in which they reach their cap as the level rises
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum(F.col("source_size") * max_copies).over(before), F.lit(0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped).cast("double") / left
    stepped = weighed.select("*", level.alias("level"), (F.col("source_size") * max_copies).cast("double").alias("cap"))
    # the first source whose cap is not below its level sets the level of all that follow
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    final = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return stepped.select("source", "source_size", target.alias("target"))


def _allotments(classes: DataFrame, max_copies: int) -> DataFrame:
    """Certain copies and inclusion probability of each (source, preference).

    ``classes`` has source, preference, size (its words), source_size and target.
    Classes reach ``max_copies`` in falling order of preference.
    """
    order = Window.partitionBy("source").orderBy(F.col("preference").desc())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    product = F.col("preference") * F.col("size")
    full = F.coalesce(F.sum("size").over(above), F.lit(0)) * max_copies
    rest = F.sum(product).over(whole) - F.coalesce(F.sum(product).over(above), F.lit(0))
    factor = F.when(rest > 0, (F.col("target") - full.cast("double")) / rest.cast("double"))
    stepped = classes.select("*", factor.alias("factor"))
    fits = F.col("factor") * F.col("preference") <= float(max_copies)
    final = F.first(F.when(fits, F.col("factor")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    copies = F.when(final.isNull(), F.lit(float(max_copies))).otherwise(final * F.col("preference"))
    expected = stepped.select("*", F.least(F.lit(float(max_copies)), copies).alias("expected"))
    certain = F.floor("expected").cast("bigint")
    return expected.select(
        "source", "preference", "size", "source_size", "target", certain.alias("certain"), (F.col("expected") - certain).alias("chance")
    )


def _rank(digest: Column, chance: Column) -> Column:
    """Random odds over inclusion odds, brought into (0, 1); null without a chance."""
    u = unit_from_hex(digest)
    q = (u / (1.0 - u)) * ((1.0 - chance) / chance)
    return F.when(chance > 0, q / (1.0 + q))


def mixing_plan(
    facts: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """One small row per (source, preference): what decides on each document of that class.

    ``facts`` has source, size, preference (positive, few distinct values), digest.
    """
    classes = written(facts.groupBy("source", "preference").agg(F.sum("size").alias("size")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, max_copies), "mix-targets")
    both = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    allotted = written(_allotments(both, max_copies), "mix-allotments")

    certain_words = F.sum(F.col("size") * F.col("certain"))
    open_words = allotted.groupBy(F.col("source").alias("s")).agg(
        (F.first("target") - certain_words.cast("double")).alias("open")
    )
    ranked = _ranked(facts, allotted).filter("rank IS NOT NULL")
    wide = _crossing(ranked.withColumn("slice", F.shiftright("slice", FINE_BITS)), open_words)
    near = ranked.join(wide, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("slice", FINE_BITS) == F.col("last_slice")))
    crossing = _crossing(near.drop("s", "last_slice", "room"), wide.select("s", F.col("room").alias("open")))
    inside = ranked.join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("last_slice")))
    upto = Window.partitionBy("source").orderBy("rank", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        inside.select("source", "room", "rank", "digest", F.sum("size").over(upto).alias("filled"))
        .filter("filled <= room")
        .groupBy(F.col("source").alias("c"))
        .agg(F.max(F.struct("rank", "digest")).alias("cut"), F.max("filled").alias("filled"))
    )
    ends = crossing.join(cuts, F.col("s").eqNullSafe(F.col("c")), "left").select(
        "s", "last_slice", "cut", (F.col("room") - F.coalesce("filled", F.lit(0))).alias("gap")
    )
    ends = written(ends, "mix-ends")
    left_over = ranked.join(ends, F.col("source").eqNullSafe(F.col("s"))).filter(~_before_cut() & (F.col("size") > 0))
    fillers = (
        left_over.groupBy("source", "gap", F.length(F.bin("size")).alias("digits"), F.substring("digest", 14, 1).alias("lot"))
        .agg(F.min(F.struct("rank", "digest", "size")).alias("first"))
        .groupBy(F.col("source").alias("c"), "gap")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("first.size")).alias("minus"), "first.digest"))).alias("fillers"))
    )
    fillers = fillers.select("c", _filled(F.col("gap"), F.col("fillers")).alias("closing"))
    # sources whose whole ranking falls short of the open words (rounding) have no end: all are taken
    return written(
        allotted.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        .join(fillers, F.col("source").eqNullSafe(F.col("c")), "left")
        .select("source", "preference", "source_size", "target", "certain", "chance", "last_slice", "cut", "closing"),
        "mix-plan",
    )


def _crossing(ranked: DataFrame, open_words: DataFrame) -> DataFrame:
    """``(s, last_slice, room)``: per source the slice in which the open words are reached, and the words left there.

    Words are summed per slice first, so the window sees a thousand rows of a source.
    """
    per_slice = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
    reached = per_slice.select("source", "slice", (running - F.col("words")).alias("before"), running.alias("until"))
    return written(
        reached.join(open_words, F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") < F.col("open")) & (F.col("until") >= F.col("open")))
        .select("s", F.col("slice").alias("last_slice"), (F.col("open") - F.col("before")).alias("room")),
        "mix-crossing",
    )


def _filled(gap: Column, fillers: Column) -> Column:
    """Digests of the documents that fill ``gap``: in falling size, each that still fits."""
    start = F.struct(gap.alias("gap"), F.array().cast("array<string>").alias("picked"))

    def step(state: Column, one: Column) -> Column:
        size = -one["minus"]
        taken = F.struct((state["gap"] - size).alias("gap"), F.array_append(state["picked"], one["digest"]).alias("picked"))
        return F.when(size <= state["gap"], taken).otherwise(state)

    return F.aggregate(fillers, start, step)["picked"]


def _before_cut() -> Column:
    """Whether a ranked document is among those that surely fit."""
    inside = (F.col("slice") == F.col("last_slice")) & (F.struct("rank", "digest") <= F.col("cut"))
    return (F.col("slice") < F.col("last_slice")) | F.coalesce(inside, F.lit(False))


def _ranked(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts with what their class says, their rank and slice of the ranking."""
    renamed = classes.withColumnsRenamed({"source": "k_source", "preference": "k_preference", "size": "k_size"})
    keys = F.col("source").eqNullSafe(F.col("k_source")) & (F.col("preference") == F.col("k_preference"))
    met = facts.join(renamed, keys).drop("k_source", "k_preference", "k_size")
    with_rank = met.select("*", _rank(F.col("digest"), F.col("chance")).alias("rank"))
    return with_rank.select("*", F.floor(F.col("rank") * SLICES).cast("int").alias("slice"))


def _decided(facts: DataFrame, plan: DataFrame) -> DataFrame:
    """Facts with their number of copies."""
    ranked = _ranked(facts, plan)
    closes = F.coalesce(F.array_contains("closing", F.col("digest")), F.lit(False))
    chosen = F.col("rank").isNotNull() & (F.col("last_slice").isNull() | _before_cut() | closes)
    return ranked.select("*", (F.col("certain") + chosen.cast("bigint")).alias("copies"))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` for every row of ``docs``.

    A null text has size 0.  Rows alike in id and text get the same number of
    copies, even where the ranking is cut, so their repeats may exceed the target.  Null sources are one source.  An empty
    table gives an empty result; a source without words gets target 0.
    """
    parts = document_facts(quoted(text), quoted(doc_id), quoted(source))
    facts = written(docs.select(quoted(doc_id).alias("doc_id"), *(c.alias(n) for n, c in parts.items())), "mix-facts")
    plan = mixing_plan(facts, weights=weights, max_copies=max_copies)
    return _decided(facts, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    The plan comes from narrow rows; the texts pass once, next to the small plan.
    """
    parts = document_facts(quoted(text), quoted(doc_id), quoted(source))
    facts = written(docs.select(*(c.alias(n) for n, c in parts.items())), "mix-facts")
    plan = mixing_plan(facts, weights=weights, max_copies=max_copies)
    rows = docs.select(*(c.alias(n) for n, c in parts.items()), F.struct(*map(quoted, docs.columns)).alias("row"))
    decided = _decided(rows, plan).filter("copies > 0")
    return decided.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
