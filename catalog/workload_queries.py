"""Workload summaries and layout comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeframe.operators import counts, joins
from rangeframe.operators.layouts import KEY, POINT, RECT
from rangeframe.plans import workload as w
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout

from . import views as v
from .views import sql

FIGURES = ("algorithm", "workload", "n_items", "num_queries", "total_results", "avg_results")
FAMILIES = {"KeyChunks": ("key", 8), "Grid": ("grid", 9), "KdCells": ("kd", 8), "Quad": ("quad", 16)}


def wrk_family(spark, sf):
    """Every family answers its workloads from its own stored layout; ``cells`` tells its occupied cells."""
    kv, points, rects = v.kv(spark, sf), v.points(spark, sf), v.rects(spark, sf)
    qpoints, qrects = v.qpoints(spark, sf), v.qrects(spark, sf)
    asked = {
        "KeyChunks": (kv, KEY, {"point": v.qkeys(spark, sf), "range": v.qranges(spark, sf)}),
        "Grid": (rects, RECT, {"point-location": v.qinside(spark, sf), "rect-intersection": qrects}),
        "KdCells": (points, POINT, {"point": qpoints, "rect-range": qrects}),
        "Quad": (points, POINT, {"point": qpoints, "rect-range": qrects}),
    }
    base, rows = scratch_path(spark, "family"), []
    for name, (data, at, workloads) in asked.items():
        by, n_cells = FAMILIES[name]
        stored = StoredLayout.create(data, f"{base}/{name}", by, at=at, n_cells=n_cells)
        cells = stored.directory().agg(F.count(F.lit(1)).alias("n")).scalar()
        for kind, queries in workloads.items():
            row = w.summary(stored.data(), queries, stored.match(queries), algorithm=name, workload=kind, extra={"cells": cells})
            rows.append(row.select(*FIGURES, F.col("extra")["cells"].cast("bigint").alias("cells")))
    return w.family(rows)


def wrk_summary(spark, sf):
    data, queries = v.points(spark, sf), v.qrects(spark, sf)
    return w.summary(data, queries, counts.rect_hits(data, queries), algorithm="points", workload="rect-range").select(*FIGURES)


def wrk_per_query(spark, sf):
    data, queries = v.points(spark, sf), v.qrects(spark, sf)
    return w.per_query(counts.rect_hits(data, queries), queries)


def wrk_per_query_keys(spark, sf):
    """Hits of key lookups and key ranges, tagged with their kind."""
    data, keys, ranges = v.kv(spark, sf), v.qkeys(spark, sf), v.qranges(spark, sf)
    asked = {"key": (counts.key_hits, keys), "range": (counts.key_range_hits, ranges)}
    return w.compare({name: lambda h=h, q=q: w.per_query(h(data, q), q) for name, (h, q) in asked.items()})


def wrk_per_query_positions(spark, sf):
    """Hits of exact positions, and of wide boxes of which most cells are covered in full."""
    data, positions, boxes = v.points(spark, sf), v.qpoints(spark, sf), v.wide_boxes(spark, sf)
    asked = {"position": (counts.point_hits, positions), "box": (counts.rect_hits, boxes)}
    return w.compare({name: lambda h=h, q=q: w.per_query(h(data, q), q) for name, (h, q) in asked.items()})


SETTINGS = {"kd-4": ("kd", 4), "kd-16": ("kd", 16), "quad-4": ("quad", 4), "quad-64": ("quad", 64), "grid-4": ("grid", 4), "grid-16": ("grid", 16)}


def wrk_compare(spark, sf):
    """One workload over layouts and sizes, each stored and asked: answers stay, cells change."""
    data, queries, base = v.points(spark, sf), v.qrects(spark, sf), scratch_path(spark, "settings")

    def asked(name):
        by, n_cells = SETTINGS[name]
        stored = StoredLayout.create(data, f"{base}/{name}", by, at=POINT, n_cells=n_cells)
        cells = stored.directory().agg(F.count(F.lit(1)).alias("n")).scalar()
        row = w.summary(stored.data(), queries, stored.match(queries), algorithm=by, workload="rect-range", extra={"cells": cells})
        return row.select("num_queries", "total_results", "n_items", F.col("extra")["cells"].cast("bigint").alias("cells"))

    return w.compare({name: lambda name=name: asked(name) for name in SETTINGS})


def wrk_indexed_vs_scan(spark, sf):
    """Answers read from stored layouts against answers from the raw tables."""
    base = scratch_path(spark, "compared")
    rows = []
    for name, data, at, by, queries, match in (
        ("key", v.kv(spark, sf), KEY, "key", v.qranges(spark, sf), joins.match_key_ranges),
        ("points", v.points(spark, sf), POINT, "kd", v.qrects(spark, sf), joins.match_points_in_rects),
        ("rects", v.rects(spark, sf), RECT, "grid", v.qrects(spark, sf), joins.match_rects),
    ):
        stored = StoredLayout.create(data, f"{base}/{name}", by, at=at, n_cells=16)
        indexed, scanned = stored.match(queries), match(data, queries)
        tallies = w.tally(scanned), w.tally(indexed)
        differing = w.answers_differ(scanned, indexed, tallies=tallies).select(F.struct("missing", "surplus").alias("d"))
        total = w.summary(data, queries, tallies[1], algorithm=name, workload="indexed")
        row = total.select(F.lit(name).alias("data"), "total_results", differing.scalar().alias("d"))
        rows.append(row.select("data", "total_results", "d.missing", "d.surplus"))
    return w.family(rows)


def wrk_timing(spark, sf):
    """Seconds differ from run to run; the flags and all other columns do not."""
    data, queries = v.points(spark, sf), v.qrects(spark, sf)
    path = scratch_path(spark, "timed")
    row = w.timed(lambda: StoredLayout.create(data, path, "grid", at=POINT, n_cells=9), queries, algorithm="Grid", workload="rect-range")
    timed = ("build_seconds", "query_total_seconds", "query_avg_seconds")
    return row.select(*FIGURES, *((F.col(c) >= 0).alias(f"has_{c}") for c in timed))


QUERIES = {
    "wrk_summary": wrk_summary,
    "wrk_per_query": wrk_per_query,
    "wrk_per_query_keys": wrk_per_query_keys,
    "wrk_per_query_positions": wrk_per_query_positions,
    "wrk_family": wrk_family,
    "wrk_compare": wrk_compare,
    "wrk_indexed_vs_scan": wrk_indexed_vs_scan,
    "wrk_timing": wrk_timing,
}

_RANGE = "points JOIN qrects ON x BETWEEN qxmin AND qxmax AND y BETWEEN qymin AND qymax"
_MEET = "rects JOIN qrects ON xmin <= qxmax AND xmax >= qxmin AND ymin <= qymax AND ymax >= qymin"
_HOLD = "rects JOIN qinside ON px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax"
_SAME = "points JOIN qpoints ON x = px AND y = py"


def _row(algorithm: str, workload: str, data: str, queries: str, pairs: str) -> str:
    return (
        f"SELECT '{algorithm}' AS algorithm, '{workload}' AS workload, (SELECT count(*) FROM {data}) AS n_items, "
        f"(SELECT count(*) FROM {queries}) AS num_queries, (SELECT count(*) FROM {pairs}) AS total_results"
    )


def _cells(table: str, cell: str) -> str:
    return f"(SELECT count(DISTINCT {cell}) FROM {table})"


_KEYS = _cells("kv, kb", v.key_chunk_sql(8, "kv.key"))
_BOXES = _cells("rects, rb", v.grid_cell_sql("(rects.xmin + rects.xmax) / 2", "(rects.ymin + rects.ymax) / 2", "rb", 3, 3))
_FAMILY = " UNION ALL ".join(
    f"SELECT *, {cells} AS cells FROM ({_row(*r)})"
    for *r, cells in (
        ("KeyChunks", "point", "kv", "qkeys", "kv JOIN qkeys ON key = k", _KEYS),
        ("KeyChunks", "range", "kv", "qranges", "kv JOIN qranges ON key BETWEEN low AND high", _KEYS),
        ("Grid", "point-location", "rects", "qinside", _HOLD, _BOXES),
        ("Grid", "rect-intersection", "rects", "qrects", _MEET, _BOXES),
        ("KdCells", "point", "points", "qpoints", _SAME, _cells("kd3", "node")),
        ("KdCells", "rect-range", "points", "qrects", _RANGE, _cells("kd3", "node")),
        ("Quad", "point", "points", "qpoints", _SAME, _cells("(SELECT path FROM descent WHERE level = 2)", "path")),
        ("Quad", "rect-range", "points", "qrects", _RANGE, _cells("(SELECT path FROM descent WHERE level = 2)", "path")),
    )
)


def _compare_sql() -> str:
    base = f"""base AS (SELECT (SELECT count(*) FROM qrects) AS num_queries, (SELECT count(*) FROM {_RANGE}) AS total_results,
                        (SELECT count(*) FROM points) AS n_items)"""
    cells = {"kd-4": _cells("kd2", "node"), "kd-16": _cells("kd4", "node")}
    for name, depth in (("quad-4", 1), ("quad-64", 3)):
        cells[name] = _cells(f"(SELECT path FROM descent WHERE level = {depth})", "path")
    for name, side in (("grid-4", 2), ("grid-16", 4)):
        cells[name] = _cells("points, pb", v.grid_cell_sql("points.x", "points.y", "pb", side, side))
    rows = " UNION ALL ".join(f"SELECT '{name}' AS setting, *, {n} AS cells FROM base" for name, n in cells.items())
    return sql(rows, v.descent_sql(3), v.kd_sql(4, keep_pivot=False), base, recursive=True)


ORACLES = {
    "wrk_summary": sql(
        f"SELECT *, total_results / num_queries AS avg_results FROM ({_row('points', 'rect-range', 'points', 'qrects', _RANGE)})"
    ),
    "wrk_per_query": sql(
        f"""SELECT q.qid, count(h.value) AS n_results FROM qrects q
            LEFT JOIN (SELECT qid, value FROM {_RANGE}) h ON h.qid = q.qid GROUP BY q.qid"""
    ),
    "wrk_per_query_keys": sql(
        """SELECT 'key' AS setting, qid, (SELECT count(*) FROM kv WHERE key = k) AS n_results FROM qkeys
           UNION ALL SELECT 'range', qid, (SELECT count(*) FROM kv WHERE key BETWEEN low AND high) FROM qranges"""
    ),
    "wrk_per_query_positions": sql(
        """SELECT 'position' AS setting, q.qid, count(p.value) AS n_results FROM qpoints q LEFT JOIN points p ON x = px AND y = py GROUP BY q.qid
           UNION ALL SELECT 'box', q.qid, count(p.value) FROM wide_boxes q
           LEFT JOIN points p ON x BETWEEN qxmin AND qxmax AND y BETWEEN qymin AND qymax GROUP BY q.qid"""
    ),
    "wrk_family": sql(
        f"SELECT * EXCLUDE (cells), total_results / num_queries AS avg_results, cells FROM ({_FAMILY})",
        v.descent_sql(2),
        v.kd_sql(3, keep_pivot=False),
        recursive=True,
    ),
    "wrk_timing": sql(
        f"""SELECT *, total_results / num_queries AS avg_results, true AS has_build_seconds,
                   true AS has_query_total_seconds, true AS has_query_avg_seconds
            FROM ({_row('Grid', 'rect-range', 'points', 'qrects', _RANGE)})"""
    ),
    "wrk_compare": _compare_sql(),
    "wrk_indexed_vs_scan": sql(
        f"""SELECT 'key' AS data, (SELECT count(*) FROM kv JOIN qranges ON key BETWEEN low AND high) AS total_results,
                   cast(0 AS bigint) AS missing, cast(0 AS bigint) AS surplus
            UNION ALL SELECT 'points', (SELECT count(*) FROM {_RANGE}), 0, 0
            UNION ALL SELECT 'rects', (SELECT count(*) FROM {_MEET}), 0, 0"""
    ),
}
