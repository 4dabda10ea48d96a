"""Decontamination where item ids repeat or are missing: items are judged by their text."""

from __future__ import annotations

from collections import Counter

from brute import shingles
from rangeframe.llm import decontaminate


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


ITEMS = [
    (7, words("a", 30)), (7, words("b", 35)), (7, words("b", 35)), (None, words("c", 20)), (None, words("d", 40)),
    (8, words("d", 40).upper()), (None, None), (None, ""), (9, words("e", 4)),
]
DOCS = [
    (1, f"{words('b', 10)} and more of other text"),  # 6 of 31 shingles of the second item
    (2, f"before {words('a', 30)} between {words('b', 34)} after"),
    (3, words("c", 20)),
    (4, f"x {words('d', 38)} y"),
    (5, words("e", 4)),
    (None, words("c", 19)),
    (None, f"{words('a', 12)} {words('c', 8)} {words('d', 9)}"),
    (2, words("x", 50)),
]


def truth():
    classes = {}
    for key, text in ITEMS:
        if own := frozenset(shingles(text, 5)):
            classes.setdefault(own, []).append(key)
    out = Counter()
    for key, text in DOCS:
        have = set(shingles(text, 5))
        for own, ids in classes.items():
            share = len(have & own) / len(own)
            if share >= 0.8:
                out[key, min((i for i in ids if i is not None), default=None), len(ids), len(have & own), len(own), share] += 1
    return out


def test_each_class_of_items_is_judged_alone(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").repartition(2)
    got = decontaminate.find_leaks(docs, items).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_copies"], r["n_shared"], r["n_shingles"], r["containment"]) for r in got) == truth()
    assert all(r["containment"] <= 1 for r in got)
    kept = decontaminate.without_leaks(docs, items).collect()
    leaky = {(r["doc_id"]) for r in got if r["doc_id"] is not None}
    assert 1 in {r["doc_id"] for r in kept} and {r["doc_id"] for r in kept if r["doc_id"] is not None} == {1, 2} and leaky == {2, 3, 4, 5}
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == [DOCS[6][1]]


def test_filters_of_any_size_give_the_same(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [sorted(map(tuple, decontaminate.find_leaks(docs, items, filter_bits=bits).collect()), key=str) for bits in (5, 10, 20)]
    assert rows[0] == rows[1] == rows[2]
