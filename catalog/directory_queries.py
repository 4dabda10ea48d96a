"""Extents, directories and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeframe.operators import directory as d
from rangeframe.operators.buckets import key_buckets
from rangeframe.operators.layouts import KEY, POINT, RECT, fit_layout, with_cells
from rangeframe.plans.workload import layout_shape

from . import views as v
from .views import sql


def agg_spatial_bounds(spark, sf):
    around_points = d.point_bounds(v.points(spark, sf)).select(F.lit("points").alias("data"), "*")
    around_rects = d.rect_bounds(v.rects(spark, sf)).select(F.lit("rects").alias("data"), "*")
    return around_points.unionByName(around_rects)


BUCKET_ROWS = 4


def agg_key_buckets(spark, sf):
    """Values are shown as one comma-separated text per bucket; most keys span several buckets."""
    listed = F.array_join(F.col("values").cast("array<string>"), ",")
    return key_buckets(v.kv(spark, sf), bucket_rows=BUCKET_ROWS).select(
        "key", F.col("chunk").cast("bigint").alias("chunk"), "n_values", listed.alias("listed")
    )


def dir_key(spark, sf):
    return d.key_directory(with_cells(v.kv(spark, sf), "key", at=KEY, n_cells=8), n_cells=8)


def _mbr(spark, sf, kind):
    data, at = (v.points(spark, sf), POINT) if kind == "points" else (v.rects(spark, sf), RECT)
    return d.mbr_directory(with_cells(data, "grid", at=at, n_cells=9), sides=at.sides, n_cells=9)


def dir_mbr(spark, sf):
    parts = [_mbr(spark, sf, kind).select(F.lit(kind).alias("data"), "*") for kind in ("points", "rects")]
    return parts[0].unionByName(parts[1])


def route_key(spark, sf):
    chunks = fit_layout(v.kv(spark, sf), "key", at=KEY, n_cells=8)
    return d.route_keys(v.qkeys(spark, sf), chunks.cell_of(F.col("k")))


def lay_pruning(spark, sf):
    data, queries = v.points(spark, sf), v.qrects(spark, sf)
    grid = fit_layout(data, "grid", at=POINT, n_cells=9)
    return layout_shape(grid.assign(data, POINT), grid, queries, POINT)


QUERIES = {
    "agg_key_bounds": lambda spark, sf: d.key_bounds(v.kv(spark, sf)),
    "agg_spatial_bounds": agg_spatial_bounds,
    "agg_key_buckets": agg_key_buckets,
    "agg_extreme_keys": lambda spark, sf: d.extreme_keys(v.kv(spark, sf)),
    "dir_key": dir_key,
    "dir_mbr": dir_mbr,
    "dir_separators": lambda spark, sf: d.separators(dir_key(spark, sf)),
    "route_key": route_key,
    "route_key_range": lambda spark, sf: d.route_key_ranges(v.qranges(spark, sf), dir_key(spark, sf)),
    "route_point": lambda spark, sf: d.route_points(v.qinside(spark, sf), _mbr(spark, sf, "rects")),
    "route_rect": lambda spark, sf: d.route_rects(v.qrects(spark, sf), _mbr(spark, sf, "points")),
    "lay_pruning": lay_pruning,
}

_CHUNKED = f"chunked AS (SELECT kv.key, kv.value, {v.key_chunk_sql(8, 'kv.key')} AS cell FROM kv, kb)"
_KEY_DIR = """kd AS (SELECT cast(r.cell AS integer) AS cell, count(key) AS n_items, min(key) AS min_key, max(key) AS max_key
               FROM range(8) r(cell) LEFT JOIN chunked USING (cell) GROUP BY r.cell)"""
_POINT_DIR = f"""pd AS (SELECT cast(r.cell AS integer) AS cell, count(x) AS n_items, min(x) AS xmin, min(y) AS ymin,
                        max(x) AS xmax, max(y) AS ymax FROM range(9) r(cell)
                 LEFT JOIN (SELECT x, y, {v.grid_cell_sql('points.x', 'points.y', 'pb', 3, 3)} AS cell FROM points, pb)
                 USING (cell) GROUP BY r.cell)"""
_CX, _CY = "(rects.xmin + rects.xmax) / 2", "(rects.ymin + rects.ymax) / 2"
_RECT_DIR = f"""rd AS (SELECT cast(r.cell AS integer) AS cell, count(g.xmin) AS n_items, min(g.xmin) AS xmin,
                        min(g.ymin) AS ymin, max(g.xmax) AS xmax, max(g.ymax) AS ymax FROM range(9) r(cell)
                 LEFT JOIN (SELECT rects.*, {v.grid_cell_sql(_CX, _CY, 'rb', 3, 3)} AS cell FROM rects, rb) g
                 USING (cell) GROUP BY r.cell)"""
_ROUTED = """routed AS (SELECT qid, cell, n_items FROM pd JOIN qrects
               ON xmin <= qxmax AND xmax >= qxmin AND ymin <= qymax AND ymax >= qymin)"""


ORACLES = {
    "agg_key_bounds": sql("SELECT min(key) AS min_key, max(key) AS max_key, count(*) AS n_items FROM kv"),
    "agg_spatial_bounds": sql(
        """SELECT 'points' AS data, count(*) AS n_items, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
           FROM points UNION ALL
           SELECT 'rects', count(*), min(xmin), min(ymin), max(xmax), max(ymax) FROM rects"""
    ),
    "agg_key_buckets": sql(
        f"""SELECT key, chunk, count(*) AS n_values, string_agg(cast(value AS varchar), ',' ORDER BY value) AS listed
            FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY value) - 1) // {BUCKET_ROWS} AS chunk FROM kv)
            GROUP BY key, chunk"""
    ),
    "agg_extreme_keys": sql("SELECT min(key) AS leftmost_key, max(key) AS rightmost_key FROM kv"),
    "dir_key": sql("SELECT * FROM kd", _CHUNKED, _KEY_DIR),
    "dir_mbr": sql("SELECT 'points' AS data, * FROM pd UNION ALL SELECT 'rects', * FROM rd", _POINT_DIR, _RECT_DIR),
    "dir_separators": sql(
        "SELECT cell, min_key AS separator FROM kd WHERE cell > 0 AND n_items > 0", _CHUNKED, _KEY_DIR
    ),
    "route_key": sql(f"SELECT qid, {v.key_chunk_sql(8, 'k')} AS cell FROM qkeys, kb"),
    "route_key_range": sql(
        "SELECT qid, cell FROM kd JOIN qranges ON max_key >= low AND min_key <= high", _CHUNKED, _KEY_DIR
    ),
    "route_point": sql(
        "SELECT qid, cell FROM rd JOIN qinside ON px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax", _RECT_DIR
    ),
    "route_rect": sql("SELECT qid, cell FROM routed", _POINT_DIR, _ROUTED),
    "lay_pruning": sql(
        """SELECT n_cells, n_rows, largest_cell, largest_cell * n_cells / n_rows AS skew, num_queries,
                   cells / num_queries AS avg_cells, touched / num_queries AS avg_rows,
                   cells / num_queries / n_cells AS cell_share, touched / num_queries / n_rows AS row_share
            FROM (SELECT count(*) AS n_cells, cast(sum(n_items) AS bigint) AS n_rows, max(n_items) AS largest_cell
                  FROM pd WHERE n_items > 0),
                 (SELECT count(*) AS cells, cast(sum(n_items) AS bigint) AS touched FROM routed),
                 (SELECT count(*) AS num_queries FROM qrects)""",
        _POINT_DIR,
        _ROUTED,
    ),
}
