"""Packing: pieces against the tokenizer itself, bins against exhaustive search, sequences against the texts."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rangeframe.llm import packing

PATH = packing.tokenizer_path()
SCHEMA = "doc_id bigint, text string"
LONG = " ".join(f"word{i * i % 7919}" for i in range(9000))
TEXTS = [
    None, "", " ", "one two three", "\n\n a\tb \x0b", "<|endoftext|> inside <|endoftext|>", "Ünï çödé \U0001f600 é 漢字 don't I'll",
    LONG, "x" * 20_000, "a" * 9000 + " " + "b" * 9000, " " * 5000, "12345 67 8 9  z", "\u0000\x1f|", LONG[:5000], LONG[:5000],
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 1000)  # long texts are encoded in parts
    given = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in TEXTS + given:
        assert packing.token_ids(text, PATH).tolist() == ids_of(tokenizer, text)


def checked(rows, tokenizer, texts, capacity):
    """Every piece once, in its place; returns the number of sequences."""
    want = []
    for key, text in texts:
        ids = np.array(ids_of(tokenizer, text) + [0], dtype="<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(key, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=order) == sorted(want, key=order)
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(spark, tokenizer, capacity):
    texts = list(enumerate(TEXTS)) + [(3, "one two three"), (3, "one two three"), (None, "no id"), (None, None)]
    table = spark.createDataFrame(texts, SCHEMA).repartition(3)
    used = checked(packing.pack_documents(table, capacity=capacity).collect(), tokenizer, texts, capacity)
    total = sum(len(ids_of(tokenizer, t)) + 1 for _, t in texts)
    assert used <= -(-total // capacity) + 1


def test_rounds_gather_what_groups_leave(spark, tokenizer):
    """Small groups leave many bins that are not full; later rounds fill them, and nothing is lost."""
    rng = random.Random(3)
    texts = [(n, " ".join("word" for _ in range(rng.randint(1, 90)))) for n in range(3000)]
    pieces = packing.tokenized(spark.createDataFrame(texts, SCHEMA).repartition(40), capacity=100)
    lengths = [r["length"] for r in pieces.collect()]
    best = len(packing.pack_lengths(lengths, 100))
    whole, alone, together = (
        checked(packing.pack(pieces, capacity=100, **options).collect(), tokenizer, texts, 100)
        for options in ({}, {"group": 150, "rounds": 1}, {"group": 150})
    )
    assert whole <= best + 1 and whole <= together < alone


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = list(enumerate(TEXTS))
    pieces = packing.tokenized(spark.createDataFrame(texts, SCHEMA), with_ids=True)
    places = packing.pack(pieces)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces, places).collect()}
    found = defaultdict(dict)
    for r in places.collect():
        found[r["doc_id"]][r["piece"]] = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
    for key, text in texts:
        assert [i for _, part in sorted(found[key].items()) for i in part] == ids_of(tokenizer, text) + [0]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty).count() == 0
    table = spark.createDataFrame([(1, "a b", 3, 4, 5)], SCHEMA + ", row int, length int, full int")
    assert packing.pack_documents(table).select("doc_id", "length", "offset").collect() == [(1, 3, 0)]


def fewest(lengths, capacity):
    """Bins of the best packing, by trying all ways with identical bins folded."""
    best = len(lengths)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[at]}:
            rest = list(rooms)
            rest.remove(room)
            place(at + 1, [*rest, room - lengths[at]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def test_search_against_all_packings():
    """Best fit alone misses the fewest bins at times; exchanges never do worse and often find them."""
    rng = random.Random(11)
    missed = found = 0
    for _ in range(300):
        lengths = sorted((rng.randint(8, 52) for _ in range(10)), reverse=True)
        before = packing.best_fit(lengths, 100)
        after = packing.improve(before, lengths, 100, effort=100_000)
        assert sorted(itertools.chain(*after)) == list(range(10))
        assert all(sum(lengths[i] for i in b) <= 100 for b in after)
        assert squares(after, lengths) >= squares(before, lengths)
        best = fewest(lengths, 100)
        if len(before) > best:
            missed += 1
            found += len(after) == best
    assert missed >= 10 and found >= missed / 3


@pytest.mark.parametrize(
    ("bins", "lengths", "want"),
    [
        ([[0, 1], [2]], [40, 30, 25], [{0, 1, 2}]),  # a move
        ([[0, 1], [2, 3]], [60, 31, 40, 9], [{0, 2}, {1, 3}]),  # one for one: 31 and 40 change places
        ([[0, 1], [2, 3, 4]], [50, 30, 20, 30, 33], None),  # two for one or one for two
    ],
)
def test_exchanges(bins, lengths, want):
    after = packing.improve(bins, lengths, 100, effort=100_000, least=0)
    if want is None:
        assert max(sum(lengths[i] for i in b) for b in after) == 100
    else:
        assert sorted(map(sorted, after)) == sorted(map(sorted, want))


def test_a_group_of_one_length_ends_soon():
    bins = packing.pack_lengths([1100] * 20_000, 2048)
    assert len(bins) == 20_000
