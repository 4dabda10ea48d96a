"""Importance resampling against a plain version; the feature table against a dictionary, with colliding keys."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from rangeframe.llm import resample

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 997}" for i in range(120_000))
TEXTS = [None, "", " .,", "one", "One TWO_three 4!", "x" * 5000 + " " + "x" * 5000 + " y " + "x" * 5000, LONG, "ÀÉ ß K K ü1z-9", "a " * 40, "a b " * 40]


def grams(text):
    w = WORD.findall((text or "").translate(UP))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, items, percent=5):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(), Counter()
    for held, table in ((s, docs), (t, items)):
        for _, text in table:
            held.update(map(bucket, grams(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for key, text in docs:
        n, own = grams(text)
        weight = sum(gain[bucket(g)] for g in own)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = Counter({r: 0 for r in rows})
    ranks = {}
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r, []).append(rank)
    out = []
    for r in rows:
        left = ranks.get(r, [])
        out.append((r[0], r[2], r[3], r[4], left.pop(0) if left else None))
    assert drawn
    return out


def listed(rows):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows), key=str)


@pytest.mark.parametrize("batch", [1 << 16, 50])
def test_equals_plain_version(spark, monkeypatch, batch):
    monkeypatch.setattr(resample, "BATCH_WORDS", batch)
    rng = random.Random(5)
    words = [f"v{n}" for n in range(300)] + ["été", "DON'T", "x_y"]
    docs = list(enumerate(TEXTS)) + [(20 + n, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))) for n in range(300)]
    docs += [(77, "same words here " * 9)] * 40 + [(None, "no id " * 30), (None, None)]
    items = [(n, " ".join(rng.choice(words[:60]) for _ in range(40))) for n in range(30)] + [(31, None), (32, "")]
    table = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, rank int, bucket int").repartition(5)
    target = spark.createDataFrame(items, "item_id bigint, text string")
    for percent in (5, 60):
        got = resample.resample(table, target, percent=percent).collect()
        assert listed(got) == sorted(plain(docs, items, percent), key=str)
        ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
        assert ranks == list(range(1, len(ranks) + 1))
    drawn = resample.drawn_documents(table, target, percent=60)
    assert drawn.columns == table.columns
    assert Counter((r["doc_id"], r["text"]) for r in drawn.collect()) == Counter(
        (docs[i][0], docs[i][1]) for i, r in enumerate(plain(docs, items, 60)) if r[4] is not None
    )


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name, key: list(zip(*(pq.read_table(f"{sf}/{name}.parquet")[c].to_pylist() for c in (key, "text"))))
    got = resample.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert listed(got) == sorted(plain(read("documents", "doc_id"), read("benchmark", "item_id")), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)], "doc_id bigint, text string")
    none = docs.filter("doc_id < 0")
    assert resample.resample(none, docs).count() == 0
    (row,) = resample.resample(docs, none, percent=100).collect()
    assert row["rank"] == 1 and row["n_features"] == 177


def test_words_equal_the_pattern():
    got = resample.words_of(TEXTS)
    for number, text in enumerate(TEXTS):
        at = np.flatnonzero(got.owner == number)
        assert [got.buffer[a:b].decode() for a, b in zip(got.start[at], got.end[at])] == WORD.findall((text or "").translate(UP))


def test_hashes_equal_the_libraries():
    rng = np.random.default_rng(3)
    buffer = rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes()
    start = np.concatenate([np.arange(300), rng.integers(0, 45_000, 3000), [0]])
    end = start + np.concatenate([np.arange(300), rng.integers(0, 90, 3000), [50_000]])
    spans = [buffer[a:b] for a, b in zip(start, end)]
    got = resample.xxhash64(buffer, resample.eights_of(buffer), start, end)
    assert got.tolist() == [xxhash.xxh64_intdigest(s) for s in spans]
    assert resample.crc32(buffer, start, end).tolist() == [zlib.crc32(s) for s in spans]
    assert len(resample.crc32(b"", start[:0], end[:0])) == 0


@pytest.mark.parametrize("keyed", ["own", "all alike", "few"])
def test_table_keeps_features_apart(keyed):
    """Bytes decide: the table is right even if every key collides."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "ab", "abcdefgh", "abcdefgi", "x" * 300, "x" * 299 + "y"]) for _ in range(60)) for _ in range(5)]
    words = resample.words_of(texts)
    start, end, owner = resample.features(words, 0, len(words.start), 3)
    keys = {"own": None, "all alike": np.zeros(len(start), np.uint64), "few": (np.arange(len(start)) * 0 + (end - start) % 3).astype(np.uint64)}[keyed]
    table = resample.Table(words.buffer, start, end, 10_000, keys=keys)
    seen = [words.buffer[a:b] for a, b in zip(start, end)]
    by_slot = {}
    for slot, gram in zip(table.slot.tolist(), seen):
        assert by_slot.setdefault(slot, gram) == gram
    assert len(by_slot) == len(set(seen)) == len(table.used)
    count = Counter(seen)
    for slot, gram in by_slot.items():
        assert table.count[slot] == count[gram] and table.bucket[slot] == zlib.crc32(gram) % 10_000
    assert Counter(owner.tolist()) == {n: len(grams(t)[1]) for n, t in enumerate(texts)}
