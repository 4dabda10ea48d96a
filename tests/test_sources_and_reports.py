"""Generators, samplers, loading, summaries, sinks and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rangeframe import schema
from rangeframe.operators import directory as d
from rangeframe.operators import joins as j
from rangeframe.operators.layouts import KEY, POINT, fit_layout
from rangeframe.plans import workload as w
from rangeframe.plans.stored import StoredLayout
from rangeframe.sources import generators as gen
from rangeframe.sources import samplers, sinks, tables
from rangeframe.streaming import ingest


def test_key_values(spark):
    df = gen.key_values(spark.range(2000), key_min=10, key_max=59, seed=3)
    low, high, distinct = df.agg(F.min("key"), F.max("key"), F.countDistinct("key")).first()
    assert (low, high, distinct) == (10, 59, 50)
    again = gen.key_values(spark.range(2000).repartition(5), key_min=10, key_max=59, seed=3)
    assert df.exceptAll(again).count() == 0
    assert gen.key_values(spark.range(100), key_max=2**40, seed=3).agg(F.max("key")).first()[0] > 2**33


def test_unique_keys(spark):
    df = gen.key_values(spark.range(1000), key_min=5, key_max=1004, allow_duplicates=False, seed=3)
    assert df.agg(F.countDistinct("key"), F.min("key"), F.max("key")).first() == (1000, 5, 1004)
    with pytest.raises(ValueError):
        gen.key_values(spark.range(1000), key_max=998, allow_duplicates=False)


def test_boxes_and_ranges_are_bounded(spark):
    rects = gen.rects(spark.range(3000), space_width=500.0, space_height=300.0, max_rect_width=9.0, seed=2)
    bad = rects.filter("xmin < 0 OR ymin < 0 OR xmax > 500 OR ymax > 300 OR xmax < xmin OR xmax - xmin > 9.000001")
    assert bad.count() == 0
    assert rects.filter("xmax - xmin < 0.999999 AND xmax < 500").count() == 0
    windows = gen.rect_queries(spark.range(500), seed=2)
    assert windows.filter("qxmax > 10000 OR qxmax - qxmin > 500.000001").count() == 0
    ranges = gen.range_queries(spark.range(500), low_max=50, max_width=7, seed=2)
    assert ranges.filter("low < 0 OR low > 50 OR high - low < 1 OR high - low > 7").count() == 0


def test_points_fill_the_space(spark):
    points = gen.points(spark.range(20_000), space_width=100.0, space_height=100.0, seed=1)
    cells = points.groupBy(F.floor(F.col("x") / 25.001), F.floor(F.col("y") / 25.001)).count()
    sizes = [r["count"] for r in cells.collect()]
    assert len(sizes) == 16 and min(sizes) > 1_000 and max(sizes) < 1_500


def test_sampled_queries_always_hit(spark):
    asked = spark.range(60)
    kv = gen.key_values(spark.range(500), seed=1)
    keys = samplers.sample_keys(kv, asked, seed=2)
    assert j.match_keys(kv, keys).select("qid").distinct().count() == keys.count() == 60
    points = gen.points(spark.range(500), seed=1)
    exact = samplers.sample_points(points, asked, seed=2)
    assert j.match_points(points, exact).select("qid").distinct().count() == 60
    rects = gen.rects(spark.range(500), seed=1)
    inside = samplers.sample_points_in_rects(rects, asked, seed=2)
    assert j.match_rects_at_points(rects, inside).select("qid").distinct().count() == 60
    assert keys.exceptAll(samplers.sample_keys(kv.repartition(3), asked, seed=2)).count() == 0


def test_load_maps_columns(spark, tmp_path):
    rows = [(1, 2.0, "3"), (2, float("nan"), "4"), (3, 5.0, None)]
    spark.createDataFrame(rows, "id int, lon double, lat string").write.parquet(str(tmp_path / "t"))
    got = tables.load(spark, str(tmp_path / "t"), schema.POINTS, {"value": "id", "x": "lon", "y": "lat"})
    assert got.schema == schema.POINTS and [tuple(r) for r in got.collect()] == [(1, 2.0, 3.0)]
    with pytest.raises(ValueError):
        tables.as_shape(got, schema.POINTS, {"z": "x"})


@pytest.fixture
def workload(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 9.0, 9.0)], "value bigint, x double, y double")
    names = "qid bigint, qxmin double, qymin double, qxmax double, qymax double"
    queries = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 20.0, 20.0, 30.0, 30.0)], names)
    return points, queries, j.match_points_in_rects(points, queries)


def test_summaries(spark, workload):
    points, queries, pairs = workload
    assert sorted(map(tuple, w.per_query(pairs, queries).collect())) == [(1, 2), (2, 0)]
    row = w.summary(points, queries, pairs, algorithm="Grid", workload="range", extra={"n_cells": 9}).first()
    assert tuple(row)[:6] == ("Grid", "range", 3, 2, 2, 1.0) and row["extra"] == {"n_cells": "9"}
    none = queries.limit(0)
    row = w.summary(points, none, j.match_points_in_rects(points, none), algorithm="Grid", workload="none").first()
    assert (row["num_queries"], row["total_results"], row["avg_results"]) == (0, 0, 0.0)


def test_timed_and_compared(spark, workload, tmp_path):
    points, queries, pairs = workload
    base = w.summary(points, queries, pairs, algorithm="Grid", workload="range")
    build = lambda: StoredLayout.create(points, str(tmp_path), "grid", at=POINT, n_cells=4)
    row = w.timed(build, queries, algorithm="Grid", workload="range").first()
    assert row["total_results"] == base.first()["total_results"]
    assert row["build_seconds"] > 0 and row["query_avg_seconds"] == row["query_total_seconds"] / 2
    table = w.compare({str(n): lambda: base for n in (16, 32, 64)})
    assert table.count() == 3 and table.select("total_results").distinct().count() == 1
    grid = fit_layout(points, "grid", at=POINT, n_cells=4)
    shape = w.layout_shape(grid.assign(points, POINT), grid, queries, POINT).first()
    assert (shape["n_cells"], shape["n_rows"], shape["largest_cell"], shape["avg_cells"]) == (2, 3, 2, 0.5)
    # pairs that occur twice on one side only are a difference
    assert tuple(w.answers_differ(pairs.unionByName(pairs), pairs).first()) == (2, 0)


def test_reports(spark, workload, tmp_path):
    points, queries, pairs = workload
    rows = w.family(
        [w.summary(points, queries, pairs, algorithm="Grid", workload=k, extra={"n": 1}) for k in ("range", "again")]
    )
    sinks.write_json(rows, str(tmp_path / "json"))
    written = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {r["workload"] for r in written} == {"range", "again"} and written[0]["extra"] == {"n": "1"}
    sinks.write_text(rows, str(tmp_path / "text"), "Points")
    files = sorted((tmp_path / "text").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[0] == "Points" and lines[1].startswith("algorithm | workload | n_items")
    assert set(lines[2]) == {"-", "+"} and len({len(line) for line in lines[1:]}) == 1
    assert [line.split(" | ")[1].strip() for line in lines[3:]] == ["again", "range"]


def make_stream(spark, tmp_path, df):
    for n, part in enumerate(df.randomSplit([0.5, 0.5], seed=1)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_equal_batches(spark, tmp_path):
    points = gen.points(spark.range(400), seed=1)
    stream = make_stream(spark, tmp_path, points)
    base = gen.points(spark.range(1000, 1200), seed=2)
    stored = StoredLayout.create(base, str(tmp_path / "layout"), "quad", at=POINT, n_cells=16)
    ingest.append_stream(stream, stored, str(tmp_path / "c1")).awaitTermination()
    assert stored.data().select(base.columns).exceptAll(base.unionByName(points)).count() == 0
    assert stored.count().first()[0] == stored.data().count() == 600

    windows = gen.rect_queries(spark.range(40), max_query_width=3_000.0, seed=3)
    pairs = ingest.match_stream(stream, windows, j.match_points_in_rects)
    out = str(tmp_path / "pairs")
    pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    want = j.match_points_in_rects(points, windows)
    assert tuple(w.answers_differ(want, spark.read.parquet(out)).first()) == (0, 0) and want.count() > 0

    grid = fit_layout(points, "grid", at=POINT, n_cells=9)
    updates = ingest.directory_stream(stream, grid, POINT)
    ingest.write_directory_updates(updates, str(tmp_path / "dir"), str(tmp_path / "c3")).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "dir"))
    last = written.groupBy("cell").agg(F.max_by(F.struct("n_items", *d.RECT_SIDES), "batch").alias("now"))
    want = d.mbr_directory(grid.assign(points, POINT), sides=POINT.sides)
    got = last.select("cell", "now.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_streamed_boxes_and_keys_match(spark, tmp_path):
    rects = gen.rects(spark.range(200), seed=1, max_rect_width=900.0)
    stream = make_stream(spark, tmp_path, rects)
    windows = gen.rect_queries(spark.range(30), seed=3)
    # beyond the broadcast size a stream is joined without looking at its data first
    for n, tuning in enumerate((j.JoinTuning(), j.JoinTuning(broadcast_rows=0))):
        pairs = ingest.match_stream(stream, windows, j.match_rects, tuning=tuning)
        out = str(tmp_path / f"pairs{n}")
        pairs.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(
            out
        ).awaitTermination()
        assert tuple(w.answers_differ(j.match_rects(rects, windows), spark.read.parquet(out)).first()) == (0, 0)
    cells = ingest.with_cells_stream(stream, fit_layout(rects.selectExpr("value AS key", "value"), "key", at=KEY, n_cells=4),
                                     KEY.__class__(("value",)))
    assert cells.isStreaming and "cell" in cells.columns
