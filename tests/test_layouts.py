"""Adaptive cells, directories and stored layouts."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangeframe.functions.cells import Bounds
from rangeframe.operators import directory as d
from rangeframe.operators import joins as j
from rangeframe.operators import lookup as l
from rangeframe.operators.buckets import key_buckets
from rangeframe.operators.kdsplit import kd_cells
from rangeframe.operators.layouts import (
    KEY,
    POINT,
    RECT,
    fit_layout,
    layout_from_dict,
    layout_to_dict,
    with_cells,
)
from rangeframe.operators.quadleaves import quad_height, quad_leaves
from rangeframe.operators.ranks import with_rank
from rangeframe.plans.stored import StoredLayout, cell_ranges
from rangeframe.plans.workload import answers_differ

POINTS = "value bigint, x double, y double"


def make_points(n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(0, 50) ** 2, rng.uniform(0, 100)) for i in range(n)]
    return rows + [(n + i, 400.0, 50.0) for i in range(n // 2)]  # a third in one spot


def python_leaves(points, capacity, max_depth):
    xs, ys = [p[1] for p in points], [p[2] for p in points]
    leaves = {}

    def visit(box, level, path, inside):
        degenerate = box[0] == box[2] and box[1] == box[3]
        if len(inside) <= capacity or level >= max_depth or degenerate:
            if inside:
                leaves[(level, path)] = len(inside)
            return
        mx, my = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        boxes = [(box[0], box[1], mx, my), (mx, box[1], box[2], my), (box[0], my, mx, box[3]), (mx, my, box[2], box[3])]
        for code, child in enumerate(boxes):
            part = [p for p in inside if (p[1] > mx) + 2 * (p[2] > my) == code]
            visit(child, level + 1, path * 4 + code, part)

    visit((min(xs), min(ys), max(xs), max(ys)), 0, 0, points)
    return leaves


@pytest.mark.parametrize("capacity,max_depth", [(1, 11), (8, 5), (1000, 3), (8, 0), (8, 1)])
def test_quad_leaves_equal_a_tree(spark, capacity, max_depth):
    points = make_points()
    leaves = quad_leaves(spark.createDataFrame(points, POINTS), capacity=capacity, max_depth=max_depth)
    want = python_leaves(points, capacity, max_depth)
    assert {(r["level"], r["path"]): r["n_items"] for r in leaves.collect()} == want
    assert quad_height(leaves).first()[0] == 1 + max(level for level, _ in want)


def test_quad_leaves_special_cases(spark):
    same = spark.createDataFrame([(i, 3.0, 4.0) for i in range(20)], POINTS)
    assert [tuple(r) for r in quad_leaves(same, capacity=2, max_depth=6).collect()] == [(0, 0, 20)]
    line = [(i, float(i), 4.0) for i in range(20)]
    got = quad_leaves(spark.createDataFrame(line, POINTS), capacity=2, max_depth=6)
    assert {(r["level"], r["path"]): r["n_items"] for r in got.collect()} == python_leaves(line, 2, 6)
    # two neighbouring floats: the box shrinks to a point before the depth limit
    tight = [(i, 1.0 + (i % 2) * 2**-52, 1.0) for i in range(20)]
    got = quad_leaves(spark.createDataFrame(tight, POINTS), capacity=2, max_depth=6)
    assert {(r["level"], r["path"]): r["n_items"] for r in got.collect()} == python_leaves(tight, 2, 6)
    empty = quad_leaves(spark.createDataFrame([], POINTS), capacity=2, max_depth=3)
    assert empty.collect() == [] and quad_height(empty).first()[0] == 0
    with pytest.raises(ValueError):
        quad_leaves(same, capacity=0, max_depth=3)
    with pytest.raises(ValueError):
        quad_leaves(same, capacity=1, max_depth=-1)


def python_kd(points, depth, capacity, keep_pivot):
    nodes = {}

    def visit(rows, level, node):
        if level == depth or len(rows) <= capacity:
            nodes.update({p[0]: node for p in rows})
            return
        rows = sorted(rows, key=lambda p: (p[1 + level % 2], p[0]))
        mid = len(rows) // 2
        if keep_pivot:
            nodes[rows[mid][0]] = node
        visit(rows[:mid], level + 1, 2 * node)
        visit(rows[mid + keep_pivot :], level + 1, 2 * node + 1)

    visit(points, 0, 1)
    return nodes


@pytest.mark.parametrize("keep_pivot", [True, False])
@pytest.mark.parametrize("window_rows", [1_000_000, 10])
def test_kd_cells_equal_a_tree(spark, keep_pivot, window_rows):
    points = make_points(120)
    got = kd_cells(
        spark.createDataFrame(points, POINTS),
        depth=4,
        capacity=3,
        keep_pivot=keep_pivot,
        window_rows=window_rows,
    )
    assert {r["value"]: r["node"] for r in got.collect()} == python_kd(points, 4, 3, keep_pivot)


@pytest.mark.parametrize("by,n_cells", [("grid", 9), ("quad", 16), ("kd", 8)])
def test_spatial_layouts_keep_every_row(spark, by, n_cells):
    points = make_points()
    df = spark.createDataFrame(points, POINTS)
    layout = fit_layout(df, by, at=POINT, n_cells=n_cells)
    cells = layout.assign(df, POINT)
    assert sorted(r["value"] for r in cells.collect()) == sorted(p[0] for p in points)
    assert cells.filter(~F.col("cell").between(0, layout.n_cells - 1)).count() == 0
    assert layout_from_dict(layout_to_dict(layout)) == layout
    if by == "kd":
        sizes = Counter(r["cell"] for r in cells.collect())
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        with_cells(spark.createDataFrame(make_points(), POINTS), "hilbert", at=POINT, n_cells=4)


def test_empty_middle_chunk_routes_right(spark):
    rows = [(k, k) for k in [*range(10), *range(90, 100)]]
    kv = spark.createDataFrame(rows, "key bigint, value bigint")
    chunks = fit_layout(kv, "key", at=KEY, n_cells=3)
    directory = d.key_directory(chunks.assign(kv), n_cells=3)
    assert [r["n_items"] for r in directory.orderBy("cell").collect()] == [10, 0, 10]
    assert [tuple(r) for r in d.separators(directory).collect()] == [(2, 90)]
    asked = spark.createDataFrame([(1, 95), (2, 50), (3, -7), (4, 10**9)], "qid bigint, k bigint")
    routed = {r["qid"]: r["cell"] for r in d.route_keys(asked, chunks.cell_of(F.col("k"))).collect()}
    assert routed == {1: 2, 2: 1, 3: 0, 4: 2}
    ranges = spark.createDataFrame([(1, 5, 95), (2, 40, 50), (3, 95, 5)], "qid bigint, low bigint, high bigint")
    assert sorted(tuple(r) for r in d.route_key_ranges(ranges, directory).collect()) == [(1, 0), (1, 2)]


def test_empty_input(spark):
    kv = spark.createDataFrame([], "key bigint, value bigint")
    assert tuple(d.key_bounds(kv).first()) == (None, None, 0)
    assert with_cells(kv, "key", at=KEY, n_cells=4).collect() == []
    points = spark.createDataFrame([], POINTS)
    for by in ("grid", "quad", "kd"):
        assert with_cells(points, by, at=POINT, n_cells=4).collect() == []


def test_ranks(spark):
    rows = [(i * 7919 % 1000, i) for i in range(500)]
    ranked = with_rank(spark.createDataFrame(rows, "key bigint, value bigint").repartition(7), ["key"])
    assert [r["rank"] for r in ranked.orderBy("key").collect()] == list(range(500))


@pytest.mark.parametrize("bucket_rows", [10_000, 4])
def test_key_buckets_keep_all_values(spark, bucket_rows):
    rows = [(i % 5, i) for i in range(60)] + [(1, 7)] * 30 + [(9, None)]
    df = spark.createDataFrame(rows, "key bigint, value bigint").filter("value IS NOT NULL")
    got = key_buckets(df, bucket_rows=bucket_rows).collect()
    listed = Counter((r["key"], v) for r in got for v in r["values"])
    assert listed == Counter(r for r in rows if r[1] is not None)
    assert all(r["n_values"] == len(r["values"]) for r in got)
    if bucket_rows > 60:
        assert len(got) == 5


CASES = [("key", KEY), ("grid", POINT), ("quad", POINT), ("kd", POINT), ("grid", RECT), ("quad", RECT), ("kd", RECT)]


def case_data(spark, at, n=150, seed=1):
    rows = make_points(n, seed)
    if at is KEY:
        return spark.createDataFrame([(int(x), v) for v, x, _ in rows], "key bigint, value bigint")
    if at is POINT:
        return spark.createDataFrame(rows, POINTS)
    boxes = [(v, x, y, x + v % 9, y + v % 4) for v, x, y in rows]
    return spark.createDataFrame(boxes, "value bigint, xmin double, ymin double, xmax double, ymax double")


def filters_on_cell(plan):
    return any("cell#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by,at", CASES, ids=[f"{by}-{len(at.columns)}" for by, at in CASES])
def test_stored_layout_answers_like_a_scan(spark, tmp_path, by, at):
    base = case_data(spark, at)
    more = case_data(spark, at, 40, seed=9).withColumn("value", F.col("value") + 10_000)
    StoredLayout.create(base, str(tmp_path), by, at=at, n_cells=8)
    stored = StoredLayout.open(spark, str(tmp_path))
    stored.append(more, "more")
    stored.append(more, "more")  # a repeated batch replaces itself
    everything = base.unionByName(more)
    assert stored.count().first()[0] == everything.count() == stored.data().count()

    rebuilt = stored.layout.assign(everything, at)
    fresh = d.key_directory(rebuilt) if at is KEY else d.mbr_directory(rebuilt, sides=at.sides)
    columns = fresh.columns
    assert sorted(map(tuple, stored.directory().select(columns).collect())) == sorted(map(tuple, fresh.collect()))

    if at is KEY:
        lookups, scan = [l.KeyAt(400), l.KeyRange(100, 420), l.KeyRange(9, 3)], l.key_query
        queries = spark.createDataFrame([(1, 100, 420), (2, 5, 5)], "qid bigint, low bigint, high bigint")
        match = j.match_key_ranges
    else:
        lookups = [l.PointAt(400.0, 50.0), l.Window(100, 10, 420, 60), l.PointAt(-5.0, -5.0)]
        scan = l.point_query if at is POINT else l.rect_query
        names = "qid bigint, qxmin double, qymin double, qxmax double, qymax double"
        queries = spark.createDataFrame([(1, 100.0, 10.0, 420.0, 60.0), (2, 0.0, 0.0, 9.0, 9.0)], names)
        match = j.match_points_in_rects if at is POINT else j.match_rects
    for query in lookups:
        answer = stored.lookup(query)
        want = sorted(r[0] for r in scan(everything, query).collect())
        assert sorted(r[0] for r in answer.collect()) == want
    plan = plan_of(stored.lookup(lookups[1]))
    assert filters_on_cell(plan)
    assert "PushedFilters: [IsNotNull" in plan
    assert tuple(answers_differ(match(everything, queries), stored.match(queries)).first()) == (0, 0)


def test_repeated_positions_outside_the_bounds(spark, tmp_path):
    stored = StoredLayout.create(case_data(spark, POINT), str(tmp_path), "grid", at=POINT, n_cells=9)
    far = spark.createDataFrame([(77_777, 1e9, -1e9), (77_778, float("nan"), 1.0)], POINTS)
    stored.append(far, "far")
    assert [r[0] for r in stored.lookup(l.PointAt(1e9, -1e9)).collect()] == [77_777]
    assert stored.data().filter("value = 77778").count() == 0


def test_bounds_of_rects_stick_out_of_cells(spark):
    rects = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 1.0), (2, 9.0, 9.0, 10.0, 10.0), (3, 0.0, 0.0, 9.0, 9.0)],
        "value bigint, xmin double, ymin double, xmax double, ymax double",
    )
    directory = d.mbr_directory(with_cells(rects, "grid", at=RECT, n_cells=4))
    asked = spark.createDataFrame([(1, 8.5, 8.5)], "qid bigint, px double, py double")
    cells = {r["cell"] for r in d.route_points(asked, directory).collect()}
    placed = {r["value"]: r["cell"] for r in with_cells(rects, "grid", at=RECT, n_cells=4).collect()}
    assert placed[3] in cells
    assert d.read_bounds(d.rect_bounds(rects)) == Bounds(0.0, 0.0, 10.0, 10.0)


def test_recreated_layout_forgets_older_rows(spark, tmp_path):
    old, new = case_data(spark, POINT), case_data(spark, POINT).filter("value % 2 = 0")
    first = StoredLayout.create(old, str(tmp_path), "grid", at=POINT, n_cells=9)
    first.append(old.withColumn("value", F.col("value") + 10_000), "more")
    again = StoredLayout.create(new, str(tmp_path), "quad", at=POINT, n_cells=16)
    assert again.count().first()[0] == again.data().count() == new.count()
    assert StoredLayout.open(spark, str(tmp_path)).data().count() == new.count()
    assert first.data().count() == 2 * old.count()


def test_input_is_computed_once_per_append(spark, tmp_path):
    stored = StoredLayout.create(case_data(spark, POINT), str(tmp_path), "grid", at=POINT, n_cells=9)
    rows = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            rows.add(len(frame))
            yield frame

    more = case_data(spark, POINT).mapInPandas(seen, "value bigint, x double, y double")
    stored.append(more, "more")
    assert rows.value == case_data(spark, POINT).count()


def test_compaction_keeps_rows_and_batches(spark, tmp_path):
    base = case_data(spark, POINT)
    stored = StoredLayout.create(base, str(tmp_path), "grid", at=POINT, n_cells=9)
    for n in range(4):
        stored.append(base.withColumn("value", F.col("value") + 10_000 * (n + 1)), f"b{n}")
    small = stored.compact()
    assert small.data().select(base.columns).exceptAll(stored.data().select(base.columns)).count() == 0
    assert small.count().first()[0] == stored.count().first()[0] == 5 * base.count()
    assert StoredLayout.open(spark, str(tmp_path)).version == small.version != stored.version
    files = lambda s: sum(1 for p in (tmp_path / s.version / "data").rglob("part-*"))
    assert files(small) < files(stored)
    with pytest.raises(ValueError):
        small.append(base, "b1")
    small.append(base.withColumn("value", F.col("value") + 90_000), "later")
    assert small.count().first()[0] == 6 * base.count()


def test_many_candidate_cells_still_prune(spark, tmp_path):
    points = spark.range(6_000).selectExpr("id AS value", "cast(id % 80 AS double) AS x", "cast(id div 80 AS double) AS y")
    stored = StoredLayout.create(points, str(tmp_path), "quad", at=POINT, n_cells=4_096)
    assert stored.directory().count() > 2_000
    answer = stored.lookup(l.Window(0, 0, 1e9, 1e9))
    assert answer.count() == 6_000 and filters_on_cell(plan_of(answer))


def test_cell_ranges_cover_the_cells_and_leave_wide_gaps_out():
    cells = sorted(random.Random(1).sample(range(10_000), 900))
    for most in (1, 7, 200, 5_000):
        ranges = cell_ranges(cells, most)
        assert len(ranges) <= most and all(sum(a <= c <= b for a, b in ranges) == 1 for c in cells)
    assert cell_ranges([3, 4, 5, 9, 20], 2) == [(3, 9), (20, 20)] and cell_ranges([7], 3) == [(7, 7)]


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,2)"])
def test_median_splits_take_any_value_and_any_depth(spark, tmp_path, kind):
    values = {"string": "concat('v', lpad(value, 9, '0'))", "date": "date_add(DATE'2020-01-01', cast(value AS int))"}
    data = case_data(spark, POINT).dropDuplicates(["value"]).selectExpr(f"{values.get(kind, f'cast(value AS {kind})')} AS value", "x", "y")
    layout = fit_layout(data, "kd", at=POINT, n_cells=8)
    sizes = [r["count"] for r in layout.assign(data, POINT).groupBy("cell").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 3
    StoredLayout.create(data, str(tmp_path), "kd", at=POINT, n_cells=8)
    stored = StoredLayout.open(spark, str(tmp_path))
    stored.append(data.limit(5), "again")
    assert stored.data().count() == data.count() + 5


def test_deep_median_splits(spark):
    data = spark.range(300).selectExpr("id AS value", "cast(id * 7919 % 1009 AS double) AS x", "cast(id * 31 % 997 AS double) AS y")
    nodes = [r["node"] for r in kd_cells(data, depth=16, keep_pivot=True).collect()]
    assert len(set(nodes)) == 300  # every node keeps one record
    with pytest.raises(ValueError):
        fit_layout(data, "grid", at=POINT, n_cells=200_000)
    assert fit_layout(data, "grid", at=POINT, n_cells=200_000, most_cells=300_000).n_cells >= 200_000


def test_far_keys_go_to_the_edge_chunks(spark):
    data = spark.createDataFrame([(-5, 1), (10, 2), (90, 3)], "key bigint, value bigint")
    chunks = fit_layout(data, "key", at=KEY, n_cells=4)
    far = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (10,)], "key bigint")
    assert [r[0] for r in far.select(chunks.cell_of(F.col("key"))).collect()] == [3, 0, 0]
    wide = fit_layout(spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 2)], "key bigint, value bigint"), "key", at=KEY, n_cells=4)
    assert [r[0] for r in far.select(wide.cell_of(F.col("key"))).collect()] == [3, 0, 2]


def test_long_keys_span_contiguous_chunks(spark):
    data = spark.range(25_000).selectExpr("1 AS key", "id * 7919 % 25013 AS value").union(spark.createDataFrame([(2, 5), (2, 5)], "key int, value bigint"))
    got = {(r["key"], r["chunk"]): r for r in key_buckets(data).collect()}
    assert {k: r["n_values"] for k, r in got.items()} == {(1, 0): 10_000, (1, 1): 10_000, (1, 2): 5_000, (2, 0): 2}
    assert got[1, 0]["values"][-1] < got[1, 1]["values"][0] and got[1, 1]["values"][-1] < got[1, 2]["values"][0]
