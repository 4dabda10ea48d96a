"""Settled keys: batches anti-join the runs, and the result is that of counting everything at once."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from brute import without_common_lines
from rangeframe.llm import line_dedup


def md5(line):
    return hashlib.md5(line.encode()).hexdigest()


def test_settled_keys_are_not_added_again(spark):
    runs = line_dedup.LineRuns(spark, fan_in=3, buckets=4)
    kinds = "line_key string, n_docs bigint"
    for counts in ([("a", 3), ("b", 1)], [("a", 5), ("b", 1), ("c", 4)], [("b", 1), ("c", 1), ("d", 1)]):
        left = runs.unseen(spark.createDataFrame([(md5(k), n) for k, n in counts], kinds), 3)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == len(runs.names) and plan.count("LeftAnti") >= len(runs.names)
        runs.add(left)
    # a and c were settled by the first run that held them three times; b never was before all came together
    got = {r["line_key"]: r["n_docs"] for r in runs.counts().collect()}
    assert got == {md5("a"): 3, md5("b"): 3, md5("c"): 4, md5("d"): 1}
    assert [len(level) for level in runs.levels] == [0, 1]
    assert runs.unseen(spark.createDataFrame([(md5("b"), 9), (md5("e"), 1)], kinds), 3).collect()[0]["line_key"] == md5("e")
    runs.drop()


def test_any_number_of_batches_gives_one_result(spark):
    rng = random.Random(4)
    lines = ["menu", " Menu\t", "home", "about us", ""] + [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines[: rng.choice([5, 45])]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = Counter(without_common_lines(rows, 10))
    for batches, fan_in in ((1, 2), (4, 2), (7, 3)):
        got = line_dedup.drop_common_lines(table, batches=batches, fan_in=fan_in).collect()
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == want
