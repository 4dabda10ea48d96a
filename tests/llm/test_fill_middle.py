"""Fill-in-the-middle against a plain version, and cut sets against sorted lists."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeframe.llm import fill_middle
from rangeframe.llm.fill_middle import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, Spec, boundaries, container

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "".join(random.Random(1).choice(["a", "bc ", "\n", " d", "éé ", "\U0001f600"]) for _ in range(150_000))
TEXTS = [
    None, "", " ", "a", " a", "a ", " \t a\n\nb  ", "one two three four", LONG, "z" * 200_000, " " * 200_000, "a b " * 60_000, "has <P> inside",
    "has <M>", "<S>", "near <P <S <M > markers <", "ü x y", "\u0000 \x1f", "<" * 50, "> <P", "P> S> M>",
]


def plain(key, text, units):
    text = text or ""
    parts = units(text)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    head, body, tail = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h4 % 100 < 80:
        return key, n, "spm", len(head), len(body), f"<S>{tail}<P>{head}<M>{body}"
    return key, n, "psm", len(head), len(body), f"<P>{head}<S>{tail}<M>{body}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_equals_plain_version(spark, unit):
    rows = [(i + 100 * k, t) for k in range(6) for i, t in enumerate(TEXTS)] + [(7, "a b c d"), (7, "a b c d"), (None, "no id here"), (None, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, output string, n int").repartition(4)
    spec = Spec(unit=unit)
    made = fill_middle.fill_in_middle(table, spec)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), spec)).collect()
    units = UNIT.findall if unit == "word" else list
    want = [plain(key, text, units) for key, text in rows]
    order = lambda r: (r[0] is None, r[0], r[5])
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    texts = sorted((r["doc_id"] or -1, r["back"]) for r in got)
    assert texts == sorted((key or -1, text or "") for key, text in rows)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_containers_take_the_smallest_form():
    few, many, runs = np.arange(0, 60_000, 61), np.flatnonzero(np.random.default_rng(1).random(65_536) < 0.4), np.arange(300, 65_000)
    for low, form in ((few, ArrayContainer), (many, BitmapContainer), (runs, RunContainer), (np.array([65_535]), ArrayContainer)):
        held = container(low)
        assert type(held) is form
        assert [held.select(k) for k in range(len(low))] == low.tolist()


def test_select_equals_sorted_list():
    rng = np.random.default_rng(2)
    for share in (0.0001, 0.01, 0.5, 0.99):
        offsets = np.flatnonzero(rng.random(400_000) < share)
        held = BoundarySet(offsets)
        assert len(held) == len(offsets)
        for k in [0, len(offsets) - 1, *rng.integers(0, len(offsets), 200).tolist()]:
            assert held.select(k) == offsets[k]
        for k in (-1, len(offsets)):
            with pytest.raises(IndexError):
                held.select(k)
    gaps = BoundarySet(np.array([0, 5, 70_000, 70_001, 1 << 30]))  # empty stretches have no container
    assert [gaps.select(k) for k in range(5)] == [0, 5, 70_000, 70_001, 1 << 30] and len(gaps.containers) == 3


def test_boundaries_equal_the_pattern():
    for text in TEXTS:
        held = boundaries(text or "")
        ends = np.cumsum([0, *map(len, UNIT.findall(text or ""))])
        assert len(held) == len(ends)
        for k in {0, len(ends) - 1, len(ends) // 2, len(ends) // 3}:
            assert held.select(k) == ends[k]
