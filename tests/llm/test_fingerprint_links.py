"""The near-duplicate stage finds links by SimHash fingerprints, each confirmed by its shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from brute import shingles
from rangeframe.llm import similar, simhash


def _bits(text: str) -> int:
    return simhash.fingerprint(text)[0][0]


def _jaccard(a: str, b: str) -> float:
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y)


def _texts(n: int = 30) -> list[str]:
    rng = random.Random(6)
    texts = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base, "more"])]
    return texts


def test_links_are_near_and_alike(spark):
    texts = _texts() + ["a b c", "a b d", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(4)
    got = {(r["a"], r["b"]) for r in similar.fingerprint_links(table).collect()}
    assert all(_jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)
    near = [
        (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))
        if (_bits(texts[a]) ^ _bits(texts[b])).bit_count() <= 2 and _jaccard(texts[a], texts[b]) >= 0.8
    ]
    assert len(near) > 30
    groups = {}
    for a, b in got:
        one = groups.get(a, {a}) | groups.get(b, {b})
        groups.update(dict.fromkeys(one, one))
    assert all(b in groups.get(a, ()) for a, b in near)


def test_the_stage_asks_simhash(spark, monkeypatch):
    asked = []
    plain = simhash.node_links
    monkeypatch.setattr(simhash, "node_links", lambda *a, **k: asked.append(1) or plain(*a, **k))
    docs = spark.createDataFrame(list(enumerate(_texts(5))), "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 3, 6, 9, 12]
    assert asked
