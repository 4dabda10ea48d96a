"""Many appends: batches merge by themselves, and nothing that is read grows with their number."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rangeframe.operators import directory as d
from rangeframe.operators.layouts import POINT, fit_layout
from rangeframe.operators.lookup import Window
from rangeframe.plans.runtime import child_names, scratch_path
from rangeframe.plans.stored import MERGED, StoredLayout
from rangeframe.streaming import ingest

POINTS = "value bigint, x double, y double"


def spot(rng, n, first):
    return [(first + i, rng.gauss(500, 3), rng.gauss(200, 3)) for i in range(n)]


@pytest.mark.parametrize("by, options", [("grid", {}), ("leaves", {"capacity": 40, "max_depth": 16})])
def test_batches_merge_by_levels(spark, by, options):
    rng = random.Random(5)
    every = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(200)]
    path = scratch_path(spark, "merges")
    stored = StoredLayout.create(spark.createDataFrame(every, POINTS), path, by, at=POINT, n_cells=9, **options)
    stored = replace(stored, merge_at=3, retain_seconds=0)
    for n in range(11):
        more = spot(rng, 0 if n == 4 else 12, 1000 * (n + 1))  # one batch is empty
        stored.append(spark.createDataFrame(more, POINTS), f"2024-06-{n:02d}")
        every += more
        assert len(stored._live_batches()) <= 1 + 2 * 3
    live = stored._live_batches()
    assert "base" in live and any(name.startswith(f"{MERGED}2") for name in live)
    assert len(child_names(spark, f"{path}/{stored.version}/directory")) <= len(live) + 2 * 3
    assert sorted(map(tuple, stored.data().select("value", "x", "y").collect())) == sorted(every)
    sizes = {r["cell"]: r["n_items"] for r in stored.directory().collect()}
    assert sum(sizes.values()) == len(every)
    if by == "leaves":
        assert max(sizes.values()) <= 40
    reopened = StoredLayout.open(spark, path)
    inside = sorted(v for v, x, y in every if 495 <= x <= 505 and 190 <= y <= 201)
    assert sorted(r[0] for r in reopened.lookup(Window(495.0, 190.0, 505.0, 201.0)).collect()) == inside
    for handle in (stored, reopened, stored.compact("all")):
        with pytest.raises(ValueError, match="cannot be replaced"):
            handle.append(spark.createDataFrame(every[:1], POINTS), "2024-06-00")


def test_merged_batches_stay_while_they_may_be_read(spark):
    path = scratch_path(spark, "merges")
    rng = random.Random(6)
    stored = StoredLayout.create(spark.createDataFrame(spot(rng, 100, 0), POINTS), path, "grid", at=POINT, n_cells=4)
    stored = replace(stored, merge_at=2)
    stored.append(spark.createDataFrame(spot(rng, 5, 1000), POINTS), "a")
    before = stored.data()
    stored.append(spark.createDataFrame(spot(rng, 5, 2000), POINTS), "b")
    assert before.count() == 105 and stored.data().count() == 110
    assert not {"a", "b"} & set(stored._live_batches()) and {"a", "b"} <= set(stored._folders())
    assert stored.was_merged("a") and not stored.was_merged("c")


def test_running_directory_is_read_from_a_snapshot_and_its_tail(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(260)]
    for n in range(13):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], POINTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n:02d}"))
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    points = spark.createDataFrame(rows, POINTS)
    grid = fit_layout(points, "grid", at=POINT, n_cells=9)
    out = str(tmp_path / "directory")
    updates = ingest.directory_stream(stream, grid, POINT)
    ingest.write_directory_updates(updates, out, str(tmp_path / "state"), snapshot_every=3).awaitTermination()
    want = d.mbr_directory(grid.assign(points, POINT), sides=POINT.sides)
    got = ingest.read_directory(spark, out)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert child_names(spark, f"{out}/_snapshots") == ["upto=11", "upto=8"]
    assert ingest._numbers(spark, out, "batch=") == [9, 10, 11, 12]
    # a micro-batch that is retried after its snapshot changes nothing
    ingest._snapshot(spark, out, 11)
    assert got.agg(F.sum("n_items")).first()[0] == 260
    with pytest.raises(ValueError, match="no directory"):
        ingest.read_directory(spark, str(tmp_path / "nothing"))
