"""Membership filters: nothing is missed, and what is not there reads no file."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog import views
from rangeframe.operators import membership as m
from rangeframe.operators.layouts import KEY, POINT, RECT
from rangeframe.operators.lookup import KeyAt, KeyRange, PointAt
from rangeframe.plans.runtime import child_names, scratch_path
from rangeframe.plans.stored import StoredLayout

SF = "/root/testdata/sf0.001"


def files_read(df) -> int:
    """Files of all scans of a plan without shuffles, after it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    counts = [leaves.apply(i).metrics().get("numFiles") for i in range(leaves.size())]
    return sum(c.get().value() for c in counts if c.isDefined())


def values(df) -> list:
    return sorted(r["value"] for r in df.collect())


@pytest.fixture(scope="module")
def even(spark):
    """Even keys in eight cells, and an append of every tenth number."""
    data = spark.range(40_000).selectExpr("id * 2 AS key", "id AS value")
    stored = StoredLayout.create(data, scratch_path(spark, "members"), "key", at=KEY, n_cells=8, membership=True)
    stored.append(spark.range(8_000).selectExpr("id * 10 AS key", "-id AS value"), "more")
    return stored


def test_no_key_is_missed(spark, even):
    """Every key passes the filters of its own cells, though cells take more than one bucket or less."""
    rows = even._stored_rows()
    for part in even._parts():
        filters = spark.read.parquet(f"{even._folder}/filters/part={part}")
        own = rows.filter(F.col("part") == part)
        code = m.hash_of([F.col("key")], [own.schema["key"].dataType])
        asked = own.select("cell", "key").withColumnRenamed("cell", "c").withColumn("code", code)
        met = m.may_hold(asked.join(filters, F.col("c") == F.col("cell")), F.col("code"))
        assert met.count() == own.count()


def test_hot_cell_has_many_buckets(spark):
    """A cell with a third of the rows and more than a bucket takes: no row of the filters grows with it."""
    data = spark.range(60_000).select(F.lit(1).alias("cell"), F.col("id").alias("key"))
    filters = m.membership_filters(data.union(spark.range(100).selectExpr("2", "id")), ["key"])
    rows = filters.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("n_buckets").alias("b"), F.max(F.length("bits0")).alias("w"))
    assert {r["cell"]: (r["n"], r["b"], r["w"]) for r in rows.collect()} == {1: (8, 8, 4096), 2: (1, 1, 4096)}
    asked = spark.range(100_000, 120_000).select(F.xxhash64("id").alias("code"))
    one = filters.filter("cell = 1")
    assert m.may_hold(asked.join(F.broadcast(one)), F.col("code")).count() < 20_000 * 0.03


def test_misses_read_nothing(even):
    misses = [even.candidate_places(KeyAt(k)) for k in range(1, 2_000, 50) if k % 2]
    assert sum(map(len, misses)) <= 2
    assert files_read(even.lookup(KeyAt(next(k for k in range(1, 2_000, 2) if not even.candidate_places(KeyAt(k)))))) == 0


def test_hits_read_their_parts_only(even):
    assert [len(even.candidate_places(KeyAt(k))) for k in (10, 12)] == [2, 1]
    assert values(even.lookup(KeyAt(10))) == [-1, 5] and values(even.lookup(KeyAt(12))) == [6]
    plain = even._pruned(even.candidate_cells(KeyAt(12))).filter("key = 12")
    assert files_read(even.lookup(KeyAt(12))) < files_read(plain)
    assert values(even.lookup(KeyRange(8, 12))) == [-1, 4, 5, 6]


def test_points_and_both_zeros(spark):
    rows = [(1, 0.0, -0.0), (2, -0.0, 0.0), (3, 5.5, 7.25), (4, 5.5, 7.25), (5, None, 1.0), (6, float("nan"), 1.0), (7, 9.0, 9.0)]
    stored = StoredLayout.create(
        spark.createDataFrame(rows, "value bigint, x double, y double"), scratch_path(spark, "members"), "packed", at=POINT, n_cells=2, membership=True
    )
    assert values(stored.lookup(PointAt(0.0, -0.0))) == [1, 2]
    assert values(stored.lookup(PointAt(5.5, 7.25))) == [3, 4]
    assert values(stored.lookup(PointAt(5.5, 7.0))) == [] == stored.candidate_places(PointAt(5.5, 7.0))


def test_all_points_are_found(spark):
    points = views.points(spark, SF)
    stored = StoredLayout.create(points, scratch_path(spark, "members"), "quad", at=POINT, n_cells=16, membership=True)
    for r in points.limit(12).collect():
        assert r["value"] in values(stored.lookup(PointAt(r["x"], r["y"])))


@pytest.mark.parametrize("key", [5.0, 2**53 + 0.0, 2**40, True], ids=["double", "huge double", "beyond the type", "boolean"])
def test_literals_of_other_types(spark, key):
    """Numbers compared in a third type are not asked of the filters, so nothing gets lost."""
    kind = "int" if key == 2**40 else "bigint"
    data = spark.createDataFrame([(5, 1), (2**53 + 1 if kind == "bigint" else 6, 2)], f"key {kind}, value bigint")
    stored = StoredLayout.create(data, scratch_path(spark, "members"), "key", at=KEY, n_cells=1, membership=True)
    if key is True:
        assert stored._asked_values(KeyAt(key)) is None
    else:
        assert values(stored.lookup(KeyAt(key))) == values(data.filter(F.col("key") == F.lit(key)).select("value"))


def test_comparable_types(spark):
    kinds = spark.sql("SELECT DATE'2024-01-01' d, TIMESTAMP'2024-01-01 00:00:00' t, TIMESTAMP_NTZ'2024-01-01 00:00:00' n, 'a' s").schema
    of = {f.name: f.dataType for f in kinds}
    literal = spark.range(0).select(F.lit(dt.datetime(2024, 1, 1)).alias("v")).schema["v"].dataType
    assert m.comparable(literal, of["t"]) and not m.comparable(literal, of["n"]) and not m.comparable(of["s"], of["d"])


def test_merged_compacted_and_reopened(spark):
    """Filters follow their records into merged batches and new versions, and go with what is removed."""
    data = spark.range(0, 4_000, 2).selectExpr("id AS key", "id AS value")
    path = scratch_path(spark, "members")
    made = StoredLayout.create(data, path, "key", at=KEY, n_cells=4, membership=True)
    stored = StoredLayout(spark, path, made.layout, made.at, made.schema, made.version, merge_at=3, retain_seconds=0, membership=True)
    for i in range(7):
        stored.append(spark.createDataFrame([(2 * i + 1, 10_000 + i)], "key bigint, value bigint"), f"b{i}")
    assert [values(stored.lookup(KeyAt(2 * i + 1))) for i in range(7)] == [[10_000 + i] for i in range(7)]
    assert stored.candidate_places(KeyAt(1_001)) == []
    assert set(child_names(spark, f"{stored._folder}/filters")) == set(n for n in child_names(spark, f"{stored._folder}/data") if n.startswith("part="))
    stored.compact()
    again = StoredLayout.open(spark, path)
    assert again.membership and values(again.lookup(KeyAt(3))) == [10_001] and len(again.candidate_places(KeyAt(3))) == 1


def test_splits_keep_filters(spark):
    """Cells that split on append: their points move, and are found under their new cells."""
    some = spark.range(200).selectExpr("id AS value", "cast(id AS double) AS x", "cast(id * 7 % 200 AS double) AS y")
    stored = StoredLayout.create(some, scratch_path(spark, "members"), "leaves", at=POINT, n_cells=1, capacity=100, membership=True)
    stored.append(spark.range(300).selectExpr("id + 1000 AS value", "id / 100D AS x", "(id * 7 % 300) / 100D AS y"), "crowd")
    assert stored.current().n_cells > stored.layout.n_cells
    for i in (0, 17, 299):
        assert 1_000 + i in values(stored.lookup(PointAt(i / 100, (i * 7 % 300) / 100)))
    assert stored.candidate_places(PointAt(0.005, 0.005)) == []


def test_refused_and_empty(spark):
    with pytest.raises(ValueError):
        StoredLayout.create(views.rects(spark, SF), scratch_path(spark, "members"), "grid", at=RECT, n_cells=4, membership=True)
    none = spark.createDataFrame([], "key bigint, value bigint")
    stored = StoredLayout.create(none, scratch_path(spark, "members"), "key", at=KEY, n_cells=4, membership=True)
    assert values(stored.lookup(KeyAt(1))) == []
    stored.append(spark.createDataFrame([(1, 2), (None, 3)], "key bigint, value bigint"), "first")
    assert values(stored.lookup(KeyAt(1))) == [2] and values(stored.lookup(KeyAt(2))) == []
