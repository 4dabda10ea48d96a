"""Components meet a link until its ends are one group, not in every round nor again in every step."""

from __future__ import annotations

import random

import pytest

from brute import components as plain_components
from brute import shingles
from rangeframe.llm import components, similar


@pytest.fixture
def joined(spark, monkeypatch):
    """Rows that each join makes."""
    made, frame = [], type(spark.range(1))
    plain = frame.join

    def counted(self, *args, **kwargs):
        met = plain(self, *args, **kwargs)
        made.append(met.count())
        return met

    monkeypatch.setattr(frame, "join", counted)
    return made


def _roots(links) -> dict:
    found = {}
    for a, b in links:
        if a != b and None not in (a, b):
            one = found.get(a, {a}) | found.get(b, {b})
            found.update(dict.fromkeys(one, one))
    return {node: min(group) for node, group in found.items()}


def _table(spark, links):
    return spark.createDataFrame(links, "a bigint, b bigint")


def test_a_crowds_links_are_joined_about_once(spark, joined):
    rng = random.Random(3)
    links = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(4000)]
    distinct = len({(min(x), max(x)) for x in links if x[0] != x[1]})
    got = dict(components.connected_components(_table(spark, links)).collect())
    assert got == _roots(links)
    assert sum(joined) < 4 * distinct  # by both ends, and some rows per node


@pytest.mark.parametrize("kind", ["path", "shuffled path", "star", "loops", "none", "many"])
def test_components_equal_plain_ones(spark, kind):
    rng = random.Random(5)
    names = rng.sample(range(-500, 500), 60) if kind != "path" else list(range(60))
    links = {
        "star": [(names[0], n) for n in names[1:]],
        "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (None, 5), (5, None)],
        "none": [],
        "many": [(rng.randrange(400), rng.randrange(400)) for _ in range(190)],
    }.get(kind, list(zip(names, names[1:])))
    rows = components.connected_components(_table(spark, links)).collect()
    assert len(rows) == len(_roots(links)) and dict(rows) == _roots(links)
    cut = len(links) // 2
    first = components.connected_components(_table(spark, links[:cut]))
    rows = components.more_components(first, _table(spark, links[cut:])).collect()
    assert len(rows) == len(_roots(links)) and dict(rows) == _roots(links)


def test_steps_of_the_stage_do_not_repeat_links(spark, monkeypatch):
    """Edited copies of one text: the groups are those of all pairs, and found links are not given again."""
    rng = random.Random(4)
    base = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
    rows = []
    for number in range(120):
        other = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 4])):
            other[at] = f"edit{rng.randint(0, 10**6)}"
        rows.append((number, " ".join(other)))
    given, plain = [], components.connected_components

    def counted(edges):
        given.append(edges.filter("a <> b").distinct().count())
        return plain(edges)

    monkeypatch.setattr(components, "connected_components", counted)
    monkeypatch.setattr(similar, "connected_components", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in similar.first_of_groups(docs, pair_limit=1).collect())
    sets = [set(shingles(t, 5)) for _, t in rows]
    assert kept == sorted(set(plain_components(list(range(len(rows))), lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)))
    assert given[0] > 200 and sum(given) < 2 * given[0]
