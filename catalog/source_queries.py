"""Generators, samplers, loading and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeframe import schema
from rangeframe.functions.mixing import (
    MODULUS,
    MULTIPLIER_A,
    MULTIPLIER_B,
    MULTIPLIER_C,
    SEED_STEP,
    STREAM_STEP,
    permutation_step,
)
from rangeframe.operators import joins
from rangeframe.operators.layouts import RECT
from rangeframe.operators import directory as d
from rangeframe.plans import workload as w
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout
from rangeframe.sources import generators as gen
from rangeframe.sources import samplers, sinks, tables

from . import views as v
from .views import sql

SPACE = 100_000.0


def order_ids(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "orders").selectExpr("o_orderkey AS id")


def customer_ids(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "customer").selectExpr("c_custkey AS id")


# -- the mixer in SQL ---------------------------------------------------------


def mixed_sql(id_sql: str, seed: int, stream: int) -> str:
    p = f"cast({MODULUS} AS bigint)"
    offset = (seed * SEED_STEP + stream * STREAM_STEP) % MODULUS
    base = f"({id_sql} % {p})"
    first = f"(({base} * {MULTIPLIER_A} + {offset}) % {p})"
    second = f"((({first} * {first}) % {p} + ({first} * {MULTIPLIER_B}) % {p} + {base}) % {p})"
    return f"(({second} * {MULTIPLIER_C} + {offset + stream}) % {p})"


def int_sql(id_sql: str, low: int, high: int, seed: int, stream: int) -> str:
    return f"({mixed_sql(id_sql, seed, stream)} % {high - low + 1} + {low})"


def unit_sql(id_sql: str, seed: int, stream: int) -> str:
    return f"(cast({mixed_sql(id_sql, seed, stream)} AS double) / cast({MODULUS - 1} AS double))"


def box_sql(id_sql: str, side: int, seed: int, names: tuple[str, str, str, str]) -> str:
    space = f"cast({SPACE} AS double)"
    low = [f"({unit_sql(id_sql, seed, s)} * {space})" for s in (1, 2)]
    length = [f"({unit_sql(id_sql, seed, s)} * cast({side - 1} AS double) + cast(1 AS double))" for s in (3, 4)]
    high = [f"least({space}, {a} + {b})" for a, b in zip(low, length)]
    return ", ".join(f"{e} AS {n}" for e, n in zip((*low, *high), names))


RECT_NAMES = ("xmin", "ymin", "xmax", "ymax")
QRECT_NAMES = ("qxmin", "qymin", "qxmax", "qymax")
UNIQUE_SPAN = 10_000_000


def _drawn_sql(data: str, order: str, seed: int) -> tuple[str, str]:
    """Common tables ``ranked`` and ``picks`` of a draw with replacement."""
    ranked = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS place, count(*) OVER () AS n FROM {data})"
    picks = (
        f"picks AS (SELECT c_custkey AS qid, {mixed_sql('c_custkey', seed, 11)} "
        f"% (SELECT count(*) FROM {data}) AS place FROM customer)"
    )
    return ranked, picks


# -- queries ------------------------------------------------------------------


def src_sample_points(spark, sf):
    return samplers.sample_points(v.points(spark, sf), customer_ids(spark, sf), seed=5)


def src_load(spark, sf):
    columns = {"value": "o_orderkey", "x": "o_totalprice", "y": v.Y}
    return tables.load(spark, f"{sf}/orders.parquet", schema.POINTS, columns)


def snk_layout(spark, sf):
    path = scratch_path(spark, "layout")
    stored = StoredLayout.create(v.rects(spark, sf), path, "grid", at=RECT, n_cells=9)
    return d.mbr_directory(stored.data(), sides=RECT.sides)


def _result_rows(spark, sf):
    keys, ranges = v.qkeys(spark, sf), v.qranges(spark, sf)
    data = v.kv(spark, sf)
    return w.family(
        [
            w.summary(data, keys, joins.match_keys(data, keys), algorithm="KeyChunks", workload="keys-point"),
            w.summary(data, ranges, joins.match_key_ranges(data, ranges), algorithm="KeyChunks", workload="keys-range"),
        ]
    )


_RESULT_SQL = """results AS (
  SELECT 'KeyChunks' AS algorithm, 'keys-point' AS workload, (SELECT count(*) FROM kv) AS n_items,
         (SELECT count(*) FROM qkeys) AS num_queries,
         (SELECT count(*) FROM kv JOIN qkeys ON key = k) AS total_results
  UNION ALL
  SELECT 'KeyChunks', 'keys-range', (SELECT count(*) FROM kv), (SELECT count(*) FROM qranges),
         (SELECT count(*) FROM kv JOIN qranges ON key BETWEEN low AND high))"""


def snk_results_json(spark, sf):
    path = scratch_path(spark, "results-json")
    sinks.write_json(_result_rows(spark, sf), path)
    return spark.read.schema(schema.RESULTS).json(path).drop("extra")


TEXT_REPORT = ("algorithm", "workload", "n_items", "num_queries", "total_results", "avg_results")


def snk_results_text(spark, sf):
    path = scratch_path(spark, "results-text")
    sinks.write_text(_result_rows(spark, sf), path, "Key workloads", columns=TEXT_REPORT)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _text_sql() -> str:
    cells = ", ".join(
        f"cast({c} AS varchar) AS {c}" if c != "avg_results" else "printf('%.3f', total_results / num_queries) AS avg_results"
        for c in TEXT_REPORT
    )
    widths = ", ".join(f"greatest({len(c)}, max(length({c}))) AS {c}" for c in TEXT_REPORT)
    row = " || ' | ' || ".join(f"rpad(s.{c}, cast(w.{c} AS integer), ' ')" for c in TEXT_REPORT)
    head = " || ' | ' || ".join(f"rpad('{c}', cast(w.{c} AS integer), ' ')" for c in TEXT_REPORT)
    rule = " || '-+-' || ".join(f"repeat('-', cast(w.{c} AS integer))" for c in TEXT_REPORT)
    return sql(
        f"SELECT 'Key workloads' AS line UNION ALL SELECT {head} FROM w UNION ALL SELECT {rule} FROM w "
        f"UNION ALL SELECT {row} FROM shown s, w",
        _RESULT_SQL,
        f"shown AS (SELECT {cells} FROM results)",
        f"w AS (SELECT {widths} FROM shown)",
    )


QUERIES = {
    "src_keyvalue": lambda spark, sf: gen.key_values(order_ids(spark, sf), key_max=10_000_000, seed=1),
    "src_keyvalue_unique": lambda spark, sf: gen.key_values(
        order_ids(spark, sf), key_max=UNIQUE_SPAN - 1, allow_duplicates=False, seed=1
    ),
    "src_points": lambda spark, sf: gen.points(
        order_ids(spark, sf), space_width=SPACE, space_height=SPACE, seed=1
    ),
    "src_rects": lambda spark, sf: gen.rects(
        order_ids(spark, sf),
        space_width=SPACE,
        space_height=SPACE,
        max_rect_width=1_200.0,
        max_rect_height=1_200.0,
        seed=1,
    ),
    "src_sample_keys": lambda spark, sf: samplers.sample_keys(v.kv(spark, sf), customer_ids(spark, sf), seed=2),
    "src_sample_points": src_sample_points,
    "src_sample_ranges": lambda spark, sf: gen.range_queries(
        customer_ids(spark, sf), low_max=9_000_000, max_width=500_000, seed=3
    ),
    "src_sample_rects": lambda spark, sf: gen.rect_queries(
        customer_ids(spark, sf),
        space_width=SPACE,
        space_height=SPACE,
        max_query_width=6_000.0,
        max_query_height=6_000.0,
        seed=3,
    ),
    "src_sample_points_in_rects": lambda spark, sf: samplers.sample_points_in_rects(
        v.rects(spark, sf), customer_ids(spark, sf), seed=4
    ),
    "src_load": src_load,
    "snk_layout": snk_layout,
    "snk_results_json": snk_results_json,
    "snk_results_text": snk_results_text,
}

ORACLES = {
    "src_keyvalue": f"SELECT {int_sql('o_orderkey', 0, 10_000_000, 1, 1)} AS key, o_orderkey AS value FROM orders",
    "src_keyvalue_unique": (
        f"SELECT ((o_orderkey % {UNIQUE_SPAN}) * {permutation_step(UNIQUE_SPAN)} + {SEED_STEP % UNIQUE_SPAN}) "
        f"% {UNIQUE_SPAN} AS key, o_orderkey AS value FROM orders"
    ),
    "src_points": (
        f"SELECT o_orderkey AS value, {unit_sql('o_orderkey', 1, 1)} * cast({SPACE} AS double) AS x, "
        f"{unit_sql('o_orderkey', 1, 2)} * cast({SPACE} AS double) AS y FROM orders"
    ),
    "src_rects": f"SELECT o_orderkey AS value, {box_sql('o_orderkey', 1_200, 1, RECT_NAMES)} FROM orders",
    "src_sample_keys": sql(
        "SELECT qid, key AS k FROM ranked JOIN picks USING (place)", *_drawn_sql("kv", "value, key", 2)
    ),
    "src_sample_points": sql(
        "SELECT qid, x AS px, y AS py FROM ranked JOIN picks USING (place)", *_drawn_sql("points", "value, x, y", 5)
    ),
    "src_sample_ranges": (
        f"SELECT c_custkey AS qid, {int_sql('c_custkey', 0, 9_000_000, 3, 1)} AS low, "
        f"{int_sql('c_custkey', 0, 9_000_000, 3, 1)} + {int_sql('c_custkey', 1, 500_000, 3, 2)} AS high FROM customer"
    ),
    "src_sample_rects": f"SELECT c_custkey AS qid, {box_sql('c_custkey', 6_000, 3, QRECT_NAMES)} FROM customer",
    "src_sample_points_in_rects": sql(
        f"""SELECT qid, least(xmin + {unit_sql('qid', 4, 13)} * (xmax - xmin), xmax) AS px,
                   least(ymin + {unit_sql('qid', 4, 14)} * (ymax - ymin), ymax) AS py
            FROM ranked JOIN picks USING (place)""",
        *_drawn_sql("rects", "value, xmin, ymin, xmax, ymax", 4),
    ),
    "src_load": sql("SELECT value, x, y FROM points"),
    "snk_layout": sql(
        f"""SELECT cell, count(*) AS n_items, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax
            FROM (SELECT rects.*, {v.grid_cell_sql('(rects.xmin + rects.xmax) / 2', '(rects.ymin + rects.ymax) / 2', 'rb', 3, 3)}
                  AS cell FROM rects, rb) GROUP BY cell"""
    ),
    "snk_results_json": sql("SELECT *, total_results / num_queries AS avg_results FROM results", _RESULT_SQL),
    "snk_results_text": _text_sql(),
}
