"""Streaming forms, driven to the end of the events table."""

from __future__ import annotations

from rangeframe.operators import joins
from rangeframe.operators.layouts import POINT, fit_layout
from rangeframe.plans.runtime import scratch_path
from rangeframe.plans.stored import StoredLayout
from rangeframe.streaming import ingest

from . import views as v
from .views import sql


def _stream(spark, sf):
    static = v.table(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return v.event_points(stream)


def str_route(spark, sf):
    """Stream of events into a layout that was fitted to, and starts with, the orders' points."""
    path = scratch_path(spark, "routed")
    stored = StoredLayout.create(v.points(spark, sf), f"{path}/layout", "grid", at=POINT, n_cells=9)
    ingest.append_stream(_stream(spark, sf), stored, f"{path}/state").awaitTermination()
    return stored.directory()


def str_match(spark, sf):
    """Events matched against a static query table as they arrive."""
    path = scratch_path(spark, "matched")
    pairs = ingest.match_stream(_stream(spark, sf), v.event_queries(spark, sf), joins.match_points_in_rects)
    query = (
        pairs.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start(f"{path}/pairs")
    )
    query.awaitTermination()
    return spark.read.schema("qid bigint, value bigint").parquet(f"{path}/pairs")


def str_directory(spark, sf):
    """Running directory of the events under a grid fitted to the orders' points."""
    path = scratch_path(spark, "directory")
    grid = fit_layout(v.event_points(v.table(spark, sf, "events")), "grid", at=POINT, n_cells=9)
    updates = ingest.directory_stream(_stream(spark, sf), grid, POINT)
    ingest.write_directory_updates(updates, f"{path}/updates", f"{path}/state").awaitTermination()
    return ingest.read_directory(spark, f"{path}/updates")


QUERIES = {"str_route": str_route, "str_match": str_match, "str_directory": str_directory}

_EVENTS = "ep AS (SELECT event_id AS value, value AS x, cast(user_id AS double) AS y FROM events)"
_ALL = "every AS (SELECT x, y FROM points UNION ALL SELECT x, y FROM ep)"
_EB = "eb AS (SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM ep)"


def _directory(source: str, bounds: str) -> str:
    return f"""SELECT cell, count(*) AS n_items, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
               FROM (SELECT s.x, s.y, {v.grid_cell_sql('s.x', 's.y', bounds, 3, 3)} AS cell FROM {source} s, {bounds})
               GROUP BY cell"""


ORACLES = {
    "str_route": sql(_directory("every", "pb"), _EVENTS, _ALL),
    "str_match": sql(
        f"""SELECT qid, value FROM ep JOIN (SELECT {", ".join(v.EVENT_QUERY)} FROM customer)
            ON x BETWEEN qxmin AND qxmax AND y BETWEEN qymin AND qymax""",
        _EVENTS,
    ),
    "str_directory": sql(_directory("ep", "eb"), _EVENTS, _EB),
}
