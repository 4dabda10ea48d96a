"""Keys, points, rectangles and query tables derived from whole test tables.

The Spark functions and the SQL text below describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Y = "cast(datediff(cast(o_orderdate as date), DATE'1995-01-01') as double)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS value", "o_totalprice AS x", f"{Y} AS y")


def rects(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).selectExpr(
        "value",
        "x AS xmin",
        "y AS ymin",
        "x + cast(value % 7 + 1 AS double) * 150.0D AS xmax",
        "y + cast(value % 5 + 1 AS double) * 3.0D AS ymax",
    )


def kv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_custkey AS key", "o_orderkey AS value")


QUERY_RECT = (
    "c_custkey AS qid",
    "cast((c_custkey * 7919) % 490000 AS double) AS qxmin",
    "cast((c_custkey * 131) % 2400 AS double) AS qymin",
    "cast((c_custkey * 7919) % 490000 + 1 + (c_custkey * 37) % 6000 AS double) AS qxmax",
    "cast((c_custkey * 131) % 2400 + 1 + (c_custkey * 17) % 60 AS double) AS qymax",
)


def qrects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*QUERY_RECT)


WIDE_BOX = (
    "s_suppkey AS qid",
    "cast((s_suppkey * 7919) % 300000 AS double) AS qxmin",
    "cast((s_suppkey * 131) % 1500 AS double) AS qymin",
    "cast((s_suppkey * 7919) % 300000 + 1 + (s_suppkey * 3637) % 190000 AS double) AS qxmax",
    "cast((s_suppkey * 131) % 1500 + 1 + (s_suppkey * 417) % 900 AS double) AS qymax",
)


def wide_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*WIDE_BOX)


QUERY_RANGE = (
    "c_custkey AS qid",
    "(c_custkey * 7) % 1400 AS low",
    "(c_custkey * 7) % 1400 + 1 + c_custkey % 50 AS high",
)


def qranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*QUERY_RANGE)


def qkeys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS qid", "c_custkey AS k")


def qpoints(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).selectExpr("value AS qid", "x AS px", "y AS py")


def qinside(spark: SparkSession, sf: str) -> DataFrame:
    return rects(spark, sf).selectExpr(
        "value AS qid", "(xmin + xmax) / 2.0D AS px", "(ymin + ymax) / 2.0D AS py"
    )


PAIR_BOX = (
    "cast((c_custkey * 7919) % 490000 - 200000 AS double) AS qxmin",
    "cast((c_custkey * 131) % 2400 - 800 AS double) AS qymin",
    "cast((c_custkey * 7919) % 490000 + 200000 AS double) AS qxmax",
    "cast((c_custkey * 131) % 2400 + 800 AS double) AS qymax",
)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's rectangle next to a box of its customer."""
    boxes = table(spark, sf, "customer").selectExpr("c_custkey", *PAIR_BOX)
    owners = table(spark, sf, "orders").selectExpr("o_orderkey AS value", "o_custkey AS c_custkey", "o_totalprice AS x", f"{Y} AS y")
    owned = owners.selectExpr(
        "value",
        "c_custkey",
        "x AS xmin",
        "y AS ymin",
        "x + cast(value % 7 + 1 AS double) * 150.0D AS xmax",
        "y + cast(value % 5 + 1 AS double) * 3.0D AS ymax",
    )
    return owned.join(boxes, "c_custkey").drop("c_custkey")


def event_points(events: DataFrame) -> DataFrame:
    """Events as points; takes the static table or a stream of it."""
    return events.selectExpr("event_id AS value", "value AS x", "cast(user_id AS double) AS y")


EVENT_QUERY = (
    "c_custkey AS qid",
    "cast((c_custkey * 37) % 100 AS double) AS qxmin",
    "cast((c_custkey * 131) % 150 AS double) AS qymin",
    "cast((c_custkey * 37) % 100 + 2 AS double) AS qxmax",
    "cast((c_custkey * 131) % 150 + 3 AS double) AS qymax",
)


def event_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*EVENT_QUERY)


_DAY = "cast(date_diff('day', DATE '1995-01-01', cast(o_orderdate AS date)) AS double)"

VIEWS = f"""
points AS (SELECT o_orderkey AS value, o_totalprice AS x, {_DAY} AS y FROM orders),
rects AS (SELECT value, x AS xmin, y AS ymin,
                 x + cast(value % 7 + 1 AS double) * cast(150 AS double) AS xmax,
                 y + cast(value % 5 + 1 AS double) * cast(3 AS double) AS ymax FROM points),
kv AS (SELECT o_custkey AS key, o_orderkey AS value FROM orders),
qrects AS (SELECT {", ".join(QUERY_RECT)} FROM customer),
wide_boxes AS (SELECT {", ".join(WIDE_BOX)} FROM supplier),
qranges AS (SELECT {", ".join(QUERY_RANGE)} FROM customer),
qkeys AS (SELECT c_custkey AS qid, c_custkey AS k FROM customer),
qpoints AS (SELECT value AS qid, x AS px, y AS py FROM points),
qinside AS (SELECT value AS qid, (xmin + xmax) / 2 AS px, (ymin + ymax) / 2 AS py FROM rects),
pairs AS (SELECT r.*, b.* EXCLUDE (c_custkey)
          FROM rects r JOIN orders o ON o.o_orderkey = r.value
               JOIN (SELECT c_custkey, {", ".join(PAIR_BOX)} FROM customer) b ON b.c_custkey = o.o_custkey),
pb AS (SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM points),
rb AS (SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM rects),
kb AS (SELECT min(key) AS lo, max(key) AS hi FROM kv)
"""


def sql(select: str, *more: str, recursive: bool = False) -> str:
    """A statement over the views, with further common tables in between."""
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {', '.join([VIEWS.strip(), *more])} {select}"


# -- cell formulas in SQL -----------------------------------------------------


def key_chunk_sql(n: int, key: str = "key", lo: str = "kb.lo", hi: str = "kb.hi") -> str:
    width = f"greatest(1, cast(ceil(({hi} - {lo} + 1) / {n}.0) AS bigint))"
    return f"cast(least(greatest(({key} - {lo}) // {width}, 0), {n - 1}) AS integer)"


def grid_cell_sql(x: str, y: str, b: str, rows: int, cols: int, clamp: int | None = None) -> str:
    def index(v: str, low: str, high: str, n: int) -> str:
        side = f"greatest(greatest({high} - {low}, 1) / {n}, 1)"
        return f"least(greatest(cast(floor(({v} - {low}) / {side}) AS integer), 0), {n - 1})"

    cell = f"{index(y, f'{b}.ymin', f'{b}.ymax', rows)} * {cols} + {index(x, f'{b}.xmin', f'{b}.xmax', cols)}"
    return f"cast({cell} AS integer)" if clamp is None else f"cast(least({cell}, {clamp - 1}) AS integer)"


def descent_sql(depth: int, source: str = "points", bounds: str = "pb", x: str = "x", y: str = "y") -> str:
    """Recursive table ``descent``: every point with its box and path on each level."""
    return f"""
descent AS (
  SELECT s.value, cast({x} AS double) AS x, cast({y} AS double) AS y, 0 AS level, cast(0 AS bigint) AS path,
         b.xmin, b.ymin, b.xmax, b.ymax FROM {source} s, {bounds} b
  UNION ALL
  SELECT value, x, y, level + 1,
         path * 4 + CASE WHEN x > (xmin + xmax) / 2 THEN 1 ELSE 0 END + CASE WHEN y > (ymin + ymax) / 2 THEN 2 ELSE 0 END,
         CASE WHEN x > (xmin + xmax) / 2 THEN (xmin + xmax) / 2 ELSE xmin END,
         CASE WHEN y > (ymin + ymax) / 2 THEN (ymin + ymax) / 2 ELSE ymin END,
         CASE WHEN x > (xmin + xmax) / 2 THEN xmax ELSE (xmin + xmax) / 2 END,
         CASE WHEN y > (ymin + ymax) / 2 THEN ymax ELSE (ymin + ymax) / 2 END
  FROM descent WHERE level < {depth})"""


def kd_sql(depth: int, keep_pivot: bool) -> str:
    """Common tables ``kd0 .. kd<depth>``: heap number of each point's node after each level."""
    tables = ["kd0 AS (SELECT value, x, y, cast(1 AS bigint) AS node, false AS settled FROM points)"]
    for level in range(depth):
        axis = "x" if level % 2 == 0 else "y"
        moves = f"(NOT settled AND size > 1 AND node >= {2 ** level})"
        stays = f"WHEN {moves} AND place = size // 2 THEN node" if keep_pivot else ""
        settled = f"settled OR ({moves} AND place = size // 2)" if keep_pivot else "settled"
        tables.append(
            f"""kd{level + 1} AS (
  SELECT value, x, y,
         CASE WHEN NOT {moves} THEN node {stays} WHEN place < size // 2 THEN node * 2 ELSE node * 2 + 1 END AS node,
         {settled} AS settled
  FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {axis}, value) - 1 AS place,
               count(*) OVER (PARTITION BY node) AS size FROM kd{level}))"""
        )
    return ", ".join(tables)
