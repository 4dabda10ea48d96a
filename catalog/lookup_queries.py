"""Single-query lookups, sizes and insertion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeframe.operators import lookup as l
from rangeframe.operators.layouts import KEY, POINT, RECT
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout

from . import views as v
from .views import sql

MEMBERS = (1, 2, 3, 77, 149, -5, 10_000_019)
WINDOW = l.Window(100_000.0, 500.0, 300_000.0, 1_500.0)


def _east_point(spark, sf) -> l.PointAt:
    """The easternmost point, so that the lookup has an answer at every scale."""
    row = v.points(spark, sf).agg(F.max("x").alias("x"), F.max_by("y", "x").alias("y")).first()
    return l.PointAt(row["x"], row["y"])


def kv_query(spark, sf):
    kv = v.kv(spark, sf)
    one = l.key_query(kv, l.KeyAt(77)).select(F.lit("point").alias("kind"), "value")
    many = l.key_query(kv, l.KeyRange(100, 150)).select(F.lit("range").alias("kind"), "value")
    return one.unionByName(many)


def spatial_query(spark, sf):
    at = _east_point(spark, sf)
    points, rects = v.points(spark, sf), v.rects(spark, sf)
    parts = {
        "point-at": l.point_query(points, at),
        "point-window": l.point_query(points, WINDOW),
        "rect-at": l.rect_query(rects, at),
        "rect-window": l.rect_query(rects, WINDOW),
    }
    tagged = [df.select(F.lit(kind).alias("kind"), "value") for kind, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])


def idx_len(spark, sf):
    base = scratch_path(spark, "sizes")
    made = {
        "key": StoredLayout.create(v.kv(spark, sf), f"{base}/key", "key", at=KEY, n_cells=8),
        "points": StoredLayout.create(v.points(spark, sf), f"{base}/points", "quad", at=POINT, n_cells=16),
        "rects": StoredLayout.create(v.rects(spark, sf), f"{base}/rects", "grid", at=RECT, n_cells=9),
    }
    sizes = [s.count().select(F.lit(name).alias("data"), "n_items") for name, s in made.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def _with_appended(spark, sf) -> StoredLayout:
    stored = StoredLayout.create(v.kv(spark, sf), scratch_path(spark, "append"), "key", at=KEY, n_cells=8)
    more = v.table(spark, sf, "lineitem").selectExpr("l_partkey AS key", "l_orderkey AS value")
    stored.append(more, "lineitem")
    return stored


def idx_insert(spark, sf):
    """Directory after an append; it equals that of a rebuild under the same cells."""
    return _with_appended(spark, sf).directory()


def idx_insert_lookup(spark, sf):
    """A lookup that sees both the first records and the appended ones."""
    return _with_appended(spark, sf).lookup(l.KeyRange(100, 150))


def idx_membership(spark, sf):
    """Lookups over a layout with membership filters and an append: keys in one batch, in both, and in none."""
    stored = StoredLayout.create(v.kv(spark, sf), scratch_path(spark, "members"), "key", at=KEY, n_cells=8, membership=True)
    stored.append(v.table(spark, sf, "lineitem").selectExpr("l_partkey AS key", "l_orderkey AS value"), "lineitem")
    answers = [stored.lookup(l.KeyAt(key)).select(F.lit(key).cast("bigint").alias("key"), "value") for key in MEMBERS]
    return reduce(DataFrame.unionByName, answers)


def idx_packed(spark, sf):
    """Rectangles that touch a window, from a stored layout of packed cells."""
    stored = StoredLayout.create(v.rects(spark, sf), scratch_path(spark, "packed"), "packed", at=RECT, n_cells=64)
    return stored.lookup(WINDOW)


QUERIES = {
    "kv_point": lambda spark, sf: l.key_query(v.kv(spark, sf), l.KeyAt(77)),
    "kv_range": lambda spark, sf: l.key_query(v.kv(spark, sf), l.KeyRange(100, 150, ordered=True)),
    "kv_query": kv_query,
    "pt_exact": lambda spark, sf: l.point_query(v.points(spark, sf), _east_point(spark, sf)),
    "pt_range": lambda spark, sf: l.point_query(v.points(spark, sf), WINDOW),
    "rect_contains_point": lambda spark, sf: l.rect_query(v.rects(spark, sf), _east_point(spark, sf)),
    "rect_intersects": lambda spark, sf: l.rect_query(v.rects(spark, sf), WINDOW),
    "spatial_query": spatial_query,
    "idx_len": idx_len,
    "idx_insert": idx_insert,
    "idx_insert_lookup": idx_insert_lookup,
    "idx_membership": idx_membership,
    "idx_packed": idx_packed,
}

_EAST = "east AS (SELECT max(x) AS px, arg_max(y, x) AS py FROM points)"
_AT = "SELECT value FROM points, east WHERE x = px AND y = py"
_IN = "SELECT value FROM points WHERE x BETWEEN 100000 AND 300000 AND y BETWEEN 500 AND 1500"
_AROUND = "SELECT value FROM rects, east WHERE px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax"
_TOUCH = "SELECT value FROM rects WHERE xmin <= 300000 AND xmax >= 100000 AND ymin <= 1500 AND ymax >= 500"
_BOTH = "both_kv AS (SELECT key, value FROM kv UNION ALL SELECT l_partkey, l_orderkey FROM lineitem)"

ORACLES = {
    "kv_point": sql("SELECT value FROM kv WHERE key = 77"),
    "kv_range": sql("SELECT value FROM kv WHERE key BETWEEN 100 AND 150"),
    "kv_query": sql(
        """SELECT 'point' AS kind, value FROM kv WHERE key = 77
           UNION ALL SELECT 'range', value FROM kv WHERE key BETWEEN 100 AND 150"""
    ),
    "pt_exact": sql(_AT, _EAST),
    "pt_range": sql(_IN),
    "rect_contains_point": sql(_AROUND, _EAST),
    "rect_intersects": sql(_TOUCH),
    "spatial_query": sql(
        f"""SELECT 'point-at' AS kind, value FROM ({_AT}) UNION ALL SELECT 'point-window', value FROM ({_IN})
            UNION ALL SELECT 'rect-at', value FROM ({_AROUND}) UNION ALL SELECT 'rect-window', value FROM ({_TOUCH})""",
        _EAST,
    ),
    "idx_len": """SELECT 'key' AS data, count(*) AS n_items FROM orders
                  UNION ALL SELECT 'points', count(*) FROM orders UNION ALL SELECT 'rects', count(*) FROM orders""",
    "idx_insert": sql(
        f"""SELECT cell, count(*) AS n_items, min(key) AS min_key, max(key) AS max_key
            FROM (SELECT both_kv.key, {v.key_chunk_sql(8, 'both_kv.key')} AS cell FROM both_kv, kb) GROUP BY cell""",
        _BOTH,
    ),
    "idx_insert_lookup": sql("SELECT value FROM both_kv WHERE key BETWEEN 100 AND 150", _BOTH),
    "idx_membership": sql(f"SELECT key, value FROM both_kv WHERE key IN {MEMBERS}", _BOTH),
    "idx_packed": sql(_TOUCH),
}
