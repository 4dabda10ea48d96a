"""What the planner sizes too low, exploded rows above all, is never broadcast."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import pytest

from rangeframe.llm import common, decontaminate, simhash, similar


def noting(monkeypatch, module):
    """The final plans of what the module writes from now on."""
    plans, written = [], module.written

    def noted(df, label, *more):
        plans.append(final_plan(df))
        return written(df, label, *more)

    monkeypatch.setattr(module, "written", noted)
    return plans


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def broadcast_with(plan: str, node: str) -> list[str]:
    """The broadcast parts of a plan that hold such a node, down to the first shuffle, whose rows Spark has measured."""
    lines, found = plan.splitlines(), []
    depths = [re.search(r"[A-Za-z*]", line).start() if re.search(r"[A-Za-z*]", line) else 0 for line in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(at + 1, len(lines)) if depths[k] <= depths[at]), len(lines))
            part = "\n".join(lines[at:end]).split("ShuffleQueryStage")[0]
            found += [part] if node in part else []
    return found


@pytest.mark.parametrize("pair_limit", [64, 3], ids=["pairs", "stars"])
def test_fingerprint_index_is_merged(spark, monkeypatch, pair_limit):
    """Sixty-four variants a fingerprint, or hundreds in a crowd, go by the size of the fingerprints."""
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << rng.randrange(64)) for p in prints for _ in range(8)]
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    rows = [(p, [p & 0xFFFFFFFF, (p >> 32) & 0xFFFFFFFF]) for p in signed]
    nodes = simhash.written(spark.createDataFrame(rows, "node bigint, parts array<bigint>"), "test-nodes")
    plans = noting(monkeypatch, simhash)
    links = simhash.node_links(nodes, pair_limit=pair_limit)
    plans.append(final_plan(links))
    assert links.count()
    assert [b for p in plans for b in broadcast_with(p, "Generate explode")] == []
    assert any("Generate explode" in p and "SortMergeJoin" in p for p in plans)
    assert "BroadcastHashJoin" not in "".join(plans)


def test_members_of_a_shingle_are_merged(spark, monkeypatch):
    """Their files are small by dictionaries, and each block of a crowd gets a copy of those outside its largest group."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    docs = [(n, " ".join(f"w{k}" for k in range(60)) + f" a{n % 9} b{n % 9} c{n} d{n}" + " z" * (n % 3)) for n in range(60)]
    texts = similar.written(spark.createDataFrame(docs, "node bigint, text string"), "test-texts")
    plans = noting(monkeypatch, similar)
    members = similar._members(texts)
    roots = spark.createDataFrame([(n, n % 9) for n in range(60)], "node bigint, root bigint")
    assert similar._rest(members, roots, texts).count()
    assert any("x_key" in p for p in plans)
    assert [b for p in plans for b in broadcast_with(p, "Generate explode")] == []
    merged = [line for p in plans for line in p.splitlines() if re.search(r"Join \[(x_)?key#", line)]
    assert len(merged) >= 3 and all("SortMergeJoin" in line for line in merged)


def test_hits_of_documents_are_not_broadcast(spark, monkeypatch):
    """Items are broadcast when they are counted as few, and merged with the documents' hits when not."""
    rng = random.Random(2)
    items = [(n, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for n in range(60)]
    docs = [(1, " ".join(text for _, text in items[:20])), (2, "nothing of that"), (None, items[30][1])]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for most, joined in ((decontaminate.BROADCAST_ROWS, "BroadcastHashJoin [shingle#"), (0, "SortMergeJoin [shingle#")):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        leaks = decontaminate.find_leaks(*tables)
        plan = final_plan(leaks)
        assert "Generate explode" in plan and joined in plan
        assert broadcast_with(plan, "Generate explode(shared") + broadcast_with(plan, "Generate explode(hits") == []
        assert sorted(r["item_id"] for r in leaks.collect()) == [*range(20), 30]


def test_shuffles_end_with_what_they_were_for(spark):
    """What a step shuffled is off the disk once its table is written, and the session's own setting is back."""
    before = spark.conf.get(common.DROP_SHUFFLES, None)
    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    known = files()
    rows = common.written(spark.range(10_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "test-counts")
    for _ in range(50):
        if files() <= known:
            break
        time.sleep(0.2)
    assert files() <= known
    assert rows.count() == 1000 and spark.conf.get(common.DROP_SHUFFLES, None) == before
