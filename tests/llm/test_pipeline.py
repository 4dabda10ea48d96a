"""The pipeline as a whole against plain versions of its five stages, each judged on what it was given."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import components, leaks, shingles, slots, targets, words
from rangeframe.llm import mixing, quality, sharding
from rangeframe.plans.runtime import scratch_path

RNG = random.Random(21)
VOCAB = [f"term{i}" for i in range(900)]
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, row string, label string"
STAGE_NAMES = ["quality classifier", "near-duplicates", "decontamination", "mixing", "sharding"]


def _prose(n: int) -> list[str]:
    return [RNG.choice(VOCAB) for _ in range(n)]


def _lines(tokens: list[str]) -> str:
    return "\n".join(" ".join(tokens[i : i + 12]) for i in range(0, len(tokens), 12))


def _made():
    """Documents, labels and test items: plain ones, spam, copies of three degrees, leaks, odd rows."""
    texts, good = [], []
    for i in range(70):
        texts.append(_lines(_prose(RNG.randint(40, 160))))
        good.append(1)
    for i in range(30):
        texts.append(" ".join(w.upper() + " !!" for w in _prose(12) * 6))
        good.append(0)
    for i in range(8):  # exact copies, near copies, and edits beyond the bound
        base = _prose(200)
        near, far = list(base), list(base)
        near[60] = "edited"
        for at in range(0, 200, 9):
            far[at] = f"other{at}"
        texts += [_lines(base), _lines(base), _lines(near), _lines(far)]
        good += [1] * 4
    items = [" ".join(_prose(n)) for n in (6, 14, 30, 60)]
    for item in items:
        tokens, others = _prose(90), _prose(90)  # else the two would be near copies
        texts += [_lines(tokens[:40] + item.split() + tokens[40:]), _lines(others[:40] + item.split()[: len(item.split()) // 2] + others[40:])]
        good += [1] * 2
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "en", len(t), "r", "l") for i, t in zip(ids, texts)]
    labels = [(i, g) for i, g in zip(ids, good) if i % 2]
    rows += [(900, None, None, None, None, None, None), (901, "", "s1", "en", 0, "r", "l"), (None, _lines(_prose(70)), "s1", "en", None, "r", "l")]
    rows += [rows[0], rows[0]]
    listed = [(n, t) for n, t in enumerate(items)] + [(None, None), (7, "")]
    return rows, labels, listed


ROWS, LABELS, ITEMS = _made()


@pytest.fixture(scope="module")
def ran(spark):
    """What each stage was given, and the rows of the run."""
    folder = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    given = {}

    def watched(name, stage):
        def run(session, docs, sf_dir):
            given[name] = [tuple(r) for r in docs.collect()]
            return stage(session, docs, sf_dir)

        return name, run

    stages = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [watched(*s) for s in stages]
    try:
        last = corpus_pipeline.run(spark, folder)
        given["end"] = [tuple(r) for r in last.collect()]
    finally:
        corpus_pipeline.STAGES = stages
    held = {r["doc_id"] for r in spark.createDataFrame(ROWS, SCHEMA).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    return given, last.columns, held


def _logistic(x, y, w, beta, steps):
    """Newton's method with a ridge, all rows at once."""
    ridge = np.diag([1e-6] + [1.0] * (len(beta) - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = np.round(beta + move * min(1.0, 5 / max(np.abs(move).max(), 1e-9)), 9)
    return beta


def _accepted(rows, labels, held):
    """Rows that co-training of both views accepts, on whole arrays."""
    known = dict(labels)
    views = [
        np.array([[1.0, *quality.text_features(r[1])] for r in rows], dtype=np.float32).astype(float),
        np.array([[1.0, *quality.meta_features(*r[1:5])] for r in rows], dtype=np.float32).astype(float),
    ]
    y = np.array([float(known[r[0]]) if r[0] in known else math.nan for r in rows])
    labelled = ~np.isnan(y)
    kept_out = np.array([r[0] in held for r in rows]) & labelled
    first = (labelled & ~kept_out).astype(float)
    target = np.where(labelled, y, 0.0)
    betas = [_logistic(x, target, first, np.zeros(x.shape[1]), 7) for x in views]
    bound = math.log(0.98 / 0.02)
    for _ in range(3):
        said = [x @ b for x, b in zip(views, betas)]
        fitted = []
        for view in (0, 1):
            sure = ~labelled & (np.abs(said[1 - view]) >= bound)
            taught = np.where(sure, said[1 - view] > 0, target).astype(float)
            fitted.append((taught, np.maximum(first, sure)))
        for _ in range(3):
            betas = [_logistic(x, t, w, b, 1) for x, (t, w), b in zip(views, fitted, betas)]
    good = (np.sum(y == 1) + 1) / (labelled.sum() + 2)
    odds = np.zeros(len(rows)) - math.log(good / (1 - good))
    for x, beta in zip(views, betas):
        slope, shift = quality._platt((x @ beta)[kept_out], y[kept_out])
        odds += slope * (x @ beta) + shift
    return [r for r, o in zip(rows, odds) if o >= 0]


def test_stages_in_order(ran):
    assert [name for name, _ in corpus_pipeline.STAGES] == STAGE_NAMES and corpus_pipeline.ORACLE_SQL is None
    given, columns, _ = ran
    assert list(given) == [*STAGE_NAMES, "end"]
    assert Counter(given["quality classifier"]) == Counter(ROWS)
    assert columns == [*[c.split()[0] for c in SCHEMA.split(", ")], "slot", "shard"]
    sizes = [len(given[n]) for n in STAGE_NAMES[:4]]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4 and sizes[3] > 80


def test_quality_equals_plain_co_training(ran):
    given, _, held = ran
    assert Counter(given["near-duplicates"]) == Counter(_accepted(ROWS, LABELS, held))
    spam = {r[0] for r in ROWS if r[1] and "!!" in r[1]}
    kept = {r[0] for r in given["near-duplicates"]}
    assert not kept & spam and {r[0] for r in ROWS if r[1]} - spam <= kept


def test_near_duplicates_equal_all_pairs(ran):
    given = ran[0]
    rows = given["near-duplicates"]
    sets = [frozenset(shingles(r[1], 5)) for r in rows]

    def alike(i, j):
        a, b = sets[i], sets[j]
        return a == b or 5 * len(a & b) >= 4 * len(a | b)

    names = list(range(len(rows)))
    group = components(names, alike)
    best: dict = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, r), r, key=lambda q: (q[0] is None, q[0] or 0))
    assert Counter(r[:5] for r in given["decontamination"]) == Counter(r[:5] for r in best.values())
    assert len(rows) - len(best) >= 16  # the copies of eight texts are among them


def test_decontamination_equals_brute_force(ran):
    given = ran[0]
    rows = given["decontamination"]
    hit = {n for n, _ in leaks(list(enumerate(r[1] for r in rows)), [(k, t) for k, t in ITEMS])}
    assert Counter(given["mixing"]) == Counter(r for n, r in enumerate(rows) if n not in hit)
    assert len(hit) == 4


def test_mixing_meets_plain_targets(ran):
    given = ran[0]
    rows, mixed = given["mixing"], given["sharding"]
    size = lambda r: len(words(r[1]))
    totals, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        totals[r[2]] += size(r)
        most[r[2]] = max(most[r[2]], size(r))
    for r in mixed:
        taken[r[2]] += size(r)
    copies = Counter(mixed)
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    for source, wanted in targets(totals, mixing.WEIGHTS, 3).items():
        assert abs(taken[source] - wanted) <= most[source] / 2


def test_shards_equal_the_table(ran):
    given = ran[0]
    table = slots(corpus_pipeline.SHARDS, sharding.SLOTS, lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16))
    want = Counter()
    for r in given["sharding"]:
        slot = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        want[(*r, slot, table[slot])] += 1
    got = Counter(given["end"])
    names = {r[-1] for r in got}
    if names <= set(corpus_pipeline.SHARDS):
        want = Counter({(*r[:-1], corpus_pipeline.SHARDS[r[-1]]): n for r, n in want.items()})
    assert got == want
