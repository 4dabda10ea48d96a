"""Layouts on storage: partitioned parquet with a directory next to it.

``layout`` holds the numbers that fix the cells and names the version in use, a
folder of its own: re-creating or compacting a layout writes a new version and
then publishes it, so readers never see a mixture.

Inside a version ``data/part=P/cell=C`` holds records and ``directory/batch=B`` one row
per cell of a batch, with the part that holds its records.  A batch's records are written
first and its directory is read off them, so the input is computed once;
writing the directory publishes the part.  A batch that is repeated publishes
a new part instead of the old one and never adds records twice.

Cells of the adaptive layout (``leaves``) split when an append makes them over-full.  The records of such a cell are
written once more as a part of their own, under new cells, and ``splits/batch=B`` logs where these begin.  Publishing that
part's directory publishes the split: readers fold the logged splits of published batches into the routing,
and cells that were split hold nothing any more.

Appends merge small batches by themselves: once a level has ``merge_at`` of them they are written as one batch of the
next level, whose name and ``merges/batch=B`` (the batches it stands for) are published with its directory.  So after
``n`` appends there are about ``merge_at * log(n)`` live batches, and a record is rewritten once per level.
Merged batches stay on storage for ``retain_seconds``, for those who still read them, and are removed by a later
merge.  One writer at a time may append to a layout; any number may read it.

With ``membership`` every part has filters as well, in ``filters/part=P``: a lookup of one key or position then
reads the parts and cells whose filter knows it, and as a rule none at all if it is not there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.geometry import Box
from ..operators import directory as d
from ..operators import joins
from ..operators import membership as m
from ..operators.layouts import (
    KeyChunks,
    Layout,
    Position,
    QuadLeaves,
    colocated,
    fit_layout,
    layout_from_dict,
    layout_to_dict,
)
from ..operators.lookup import KeyAt, KeyRange, PointAt, Window, key_query, point_query, rect_query
from ..schema import drop_unusable
from .runtime import cut_lineage, path_exists, remove_folder, row_count_up_to, seconds_since_change, written_folders

CELL_RANGES = 200  # most ranges of cells in a partition filter; beyond it the nearest ranges are joined
BLOCK_SHARE = 16  # expanded rows of a query, as a rule; so many fewer queries than may be broadcast form a block
MERGED = "merged-"  # begins the names of batches that stand for others; their level follows
MERGE_AT = 32  # batches of a level that are merged into one of the next
RETAIN_SECONDS = 86_400  # how long merged batches stay on storage
MOST_BLOCKS = 8  # blocks of a batch, all of them in the driver's memory at once; beyond it data and queries are shuffled once instead


def cell_ranges(cells: list[int], most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover the sorted cells; the widest gaps between cells stay out."""
    gaps = sorted(range(1, len(cells)), key=lambda i: cells[i - 1] - cells[i])
    starts = sorted(i for i in gaps[: most - 1] if cells[i] - cells[i - 1] > 1)
    return [(cells[a], cells[b - 1]) for a, b in zip([0, *starts], [*starts, len(cells)])]


def _among(cells: list[int]) -> Column:
    """A partition filter of bounded length that holds for the sorted cells."""
    return reduce(or_, (F.col("cell").between(a, b) for a, b in cell_ranges(cells, CELL_RANGES)))


def query_blocks(asked: list[tuple[int, int]], most: int) -> list[tuple[list[int], int]]:
    """Neighbouring cells with at most ``most`` routed queries together, as ``(cells, pieces)``.

    ``asked`` holds ``(cell, queries)`` in order.  A cell with more queries is a block of its own, its queries
    dealt to as many pieces as it takes.
    """
    blocks: list[tuple[list[int], int]] = []
    room = 0
    for cell, n in asked:
        if n <= room:
            blocks[-1][0].append(cell)
            room -= n
        else:
            blocks.append(([cell], -(-n // most)))
            room = max(0, most - n)
    return blocks


@dataclass(frozen=True)
class StoredLayout:
    """A data set laid out in cells at ``path``."""

    spark: SparkSession
    path: str
    layout: Layout
    at: Position
    schema: T.StructType
    version: str
    compacted: tuple[str, ...] = ()  # batches that can no longer be replaced one by one
    merge_at: int = MERGE_AT
    retain_seconds: float = RETAIN_SECONDS
    membership: bool = False

    # -- writing --

    @classmethod
    def create(
        cls,
        df: DataFrame,
        path: str,
        by: str,
        *,
        at: Position,
        n_cells: int,
        batch: str = "base",
        membership: bool = False,
        **options,
    ) -> "StoredLayout":
        """Fit a layout to ``df``, write it and return the handle; an older layout at ``path`` is superseded.

        ``membership`` keeps filters of keys or positions, for which each part is read once more.
        """
        if membership and len(at.columns) == 4:
            raise ValueError("rectangles are not looked up by equality, so they have no membership filters")
        df = drop_unusable(df, list(at.columns))
        layout = fit_layout(df, by, at=at, n_cells=n_cells, **options)
        stored = cls(df.sparkSession, path.rstrip("/"), layout, at, df.schema, uuid.uuid4().hex, membership=membership)
        stored.append(df, batch)
        stored._publish()
        return stored

    def _publish(self) -> None:
        description = json.dumps(
            {
                "layout": layout_to_dict(self.layout),
                "columns": list(self.at.columns),
                "value": self.at.value,
                "schema": json.loads(self.schema.json()),
                "version": self.version,
                "compacted": list(self.compacted),
                "membership": self.membership,
            },
            default=str,
        )
        self.spark.createDataFrame([(description,)], "value string").write.mode("overwrite").text(f"{self.path}/layout")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "StoredLayout":
        path = path.rstrip("/")
        state = json.loads(spark.read.text(f"{path}/layout").first()["value"])
        return cls(
            spark,
            path,
            layout_from_dict(state["layout"]),
            Position(tuple(state["columns"]), state["value"]),
            T.StructType.fromJson(state["schema"]),
            state["version"],
            tuple(state["compacted"]),
            membership=state.get("membership", False),
        )

    @property
    def _folder(self) -> str:
        return f"{self.path}/{self.version}"

    def append(self, df: DataFrame, batch: str) -> None:
        """Add records under the stored cells; records outside the bounds go to edge cells."""
        if batch in self.compacted:
            raise ValueError(f"batch {batch!r} is part of a compacted one and cannot be replaced")
        if self.was_merged(batch):
            raise ValueError(f"batch {batch!r} was merged with others and cannot be replaced")
        if isinstance(self.layout, QuadLeaves) and batch != "base" and self._was_moved(batch):
            raise ValueError(f"records of batch {batch!r} have moved with a split cell and cannot be replaced")
        picked = drop_unusable(df.select(*self.schema.fieldNames()), list(self.at.columns))
        self._add(self.current().assign(picked, self.at), batch)
        if isinstance(self.layout, QuadLeaves):
            self.split()
        self.merge_batches()

    # -- merging --

    def _merge_log(self) -> DataFrame | None:
        """``(gone, batch)``: the batches that merged ones stand for, published or not."""
        if not path_exists(self.spark, f"{self._folder}/merges"):
            return None
        kinds = "gone string, batch string"
        return self.spark.read.schema(kinds).option("basePath", f"{self._folder}/merges").parquet(f"{self._folder}/merges")

    def _gone(self, among: list[str], folders: list[str]) -> list[str]:
        """Those of the batches ``among`` that some published one stands for; no longer than ``among``."""
        log, merged = self._merge_log(), [n for n in folders if n.startswith(MERGED)]
        if log is None or not merged or not among:
            return []
        hit = log.filter(F.col("batch").isin(merged) & F.col("gone").isin(among))
        return sorted({r["gone"] for r in hit.select("gone").collect()})

    def _folders(self) -> list[str]:
        """Published batches that are still on storage."""
        return written_folders(self.spark, f"{self._folder}/directory", "batch=")

    def _live_batches(self) -> list[str]:
        folders = self._folders()
        gone = set(self._gone(folders, folders))
        return [n for n in folders if n not in gone]

    def was_merged(self, batch: str) -> bool:
        """Whether a batch is part of a merged one, and so can no longer be replaced."""
        return bool(self._gone([batch], self._folders()))

    def merge_batches(self) -> int:
        """Merge the full levels, lowest first; returns how many batches went into others."""
        merged, level = 0, 0
        while True:
            live = self._live_batches()
            levels = {n: int(n[len(MERGED) :].split("-")[0]) if n.startswith(MERGED) else 0 for n in live}
            picked = self._without_largest([n for n in live if levels[n] == level])
            if len(picked) >= self.merge_at:
                self._merge(picked, level + 1)
                merged += len(picked)
            elif level >= max(levels.values(), default=0):
                break
            level += 1
        if merged:
            self._remove_merged()
        return merged

    def _without_largest(self, names: list[str]) -> list[str]:
        """Without a batch larger than all others together: merging it would rewrite little else."""
        if len(names) < self.merge_at:
            return []
        rows = self._published(names).groupBy("part").agg(F.sum("n_items").alias("n"), F.first("name").alias("name"))
        sizes = {r["name"]: r["n"] for r in rows.collect()}  # one row per batch of a level
        return [n for n in names if 2 * sizes.get(n, 0) <= sum(sizes.values())]

    def _merge(self, names: list[str], level: int) -> None:
        batch = f"{MERGED}{level}-{uuid.uuid4().hex}"
        parts = self._parts(names)
        rows = self._live(self._stored_rows().filter(F.col("part").isin(parts)))
        gone = self.spark.createDataFrame([(n,) for n in names], "gone string")
        log, splits = self._merge_log(), self._logged()
        if log is not None:
            gone = gone.union(log.filter(F.col("batch").isin(names)).select("gone"))
        gone.coalesce(1).write.parquet(f"{self._folder}/merges/batch={batch}")
        if splits is not None:
            splits = splits.filter(F.col("batch").isin(names)).select("start", "cell")
            splits.coalesce(1).write.parquet(f"{self._folder}/splits/batch={batch}")
        self._add(rows.select(*self.schema.fieldNames(), "cell"), batch)

    def _remove_merged(self) -> None:
        """Remove from storage what was merged ``retain_seconds`` ago."""
        folders = self._folders()
        log = self._merge_log()
        since = {n: seconds_since_change(self.spark, f"{self._folder}/directory/batch={n}") for n in folders if n.startswith(MERGED)}
        old = [n for n, age in since.items() if age >= self.retain_seconds]
        if log is None or not old:
            return
        hit = log.filter(F.col("batch").isin(old) & F.col("gone").isin(folders)).select("gone").distinct()
        for name in [r["gone"] for r in hit.collect()]:
            parts = self._parts([name])
            remove_folder(self.spark, f"{self._folder}/directory/batch={name}")
            for part in parts:
                for kind in ("data", "filters"):
                    remove_folder(self.spark, f"{self._folder}/{kind}/part={part}")
            for kind in ("splits", "merges"):
                remove_folder(self.spark, f"{self._folder}/{kind}/batch={name}")

    # -- splitting --

    def _logged(self) -> DataFrame | None:
        """``(start, cell, batch)`` of all splits written, published or not."""
        if not isinstance(self.layout, QuadLeaves) or not path_exists(self.spark, f"{self._folder}/splits"):
            return None
        kinds = "start bigint, cell int, batch string"
        return self.spark.read.schema(kinds).option("basePath", f"{self._folder}/splits").parquet(f"{self._folder}/splits")

    def _splits(self) -> list[tuple[int, int]]:
        """``(first code, cell)`` of the published splits; at most two rows per cell."""
        logged = self._logged()
        if logged is None:
            return []
        return [(r["start"], r["cell"]) for r in logged.filter(F.col("batch").isin(self._live_batches())).collect()]

    def _was_moved(self, batch: str) -> bool:
        known = path_exists(self.spark, f"{self._folder}/directory/batch={batch}")
        return known and bool(self._splits())

    def current(self) -> Layout:
        """The layout with all published splits."""
        splits = self._splits()
        return self.layout.with_splits(splits) if splits else self.layout

    def _dead_cells(self) -> list[int]:
        """Cells that were split; at most as many as there are cells."""
        splits = self._splits()
        if not splits:
            return []
        live = {cell for _, cell in self.layout.with_splits(splits).starts}
        return sorted({cell for _, cell in self.layout.starts}.union(c for _, c in splits) - live)

    def split(self) -> int:
        """Split every over-full cell in place; returns how many were split."""
        layout = self.current()
        over = [r["cell"] for r in self.directory().filter(F.col("n_items") > layout.capacity).select("cell").collect()]
        if not over:
            return 0
        codes = layout.leaf_codes(self._pruned(sorted(over)), self.at)
        every = [cell for _, cell in self.layout.starts] + [cell for _, cell in self._splits()]
        pieces = layout.split(codes, set(over), max(every) + 1)
        if not pieces:  # points that the finest level cannot tell apart
            return 0
        batch = f"split-{uuid.uuid4().hex}"
        after = layout.with_splits(pieces)
        gone = {cell for _, cell in layout.starts} - {cell for _, cell in after.starts}
        moved = self._pruned(sorted(gone)).select(*self.schema.fieldNames())
        self.spark.createDataFrame(pieces, "start bigint, cell int").write.parquet(f"{self._folder}/splits/batch={batch}")
        self._add(after.assign(moved, self.at), batch)
        return len(gone)

    # -- writing parts --

    def _add(self, placed: DataFrame, batch: str) -> None:
        part = uuid.uuid4().hex
        order = [self.at.columns[0]]
        colocated(placed, order).write.partitionBy("cell").parquet(f"{self._folder}/data/part={part}")
        rows = self._stored_rows().filter(F.col("part") == part)
        if self.membership:
            filters = m.membership_filters(rows, list(self.at.columns))
            # a few narrow files, so that the cells in their footers are selective
            filters.repartitionByRange("cell", "bucket").sortWithinPartitions("cell", "bucket").write.parquet(f"{self._folder}/filters/part={part}")
        directory = self._directory_of(rows)
        directory.withColumn("part", F.lit(part)).write.mode("overwrite").parquet(f"{self._folder}/directory/batch={batch}")

    def compact(self, batch: str = "compacted") -> "StoredLayout":
        """All batches as one, in a new version: few files per cell again after many small batches.

        Returns the handle of the new version; the old one stays readable for those
        who hold it.  The batches merged can no longer be replaced one by one.
        """
        merged = self._live_batches()
        log = self._merge_log()
        if log is not None:  # what merged batches stand for cannot be replaced either
            merged += [r["gone"] for r in log.filter(F.col("batch").isin(merged)).select("gone").distinct().collect()]
        fresh = replace(self, layout=self.current(), version=uuid.uuid4().hex, compacted=self.compacted + tuple(merged))
        fresh._add(self.data().select(*self.schema.fieldNames(), "cell"), batch)
        fresh._publish()
        return fresh

    def _directory_of(self, placed: DataFrame) -> DataFrame:
        if isinstance(self.layout, KeyChunks):
            return d.key_directory(placed, key=self.at.columns[0])
        return d.mbr_directory(placed, sides=self.at.sides)

    # -- reading --

    def _stored_rows(self) -> DataFrame:
        full = T.StructType(
            [*self.schema.fields, T.StructField("part", T.StringType()), T.StructField("cell", T.IntegerType())]
        )
        # an empty batch leaves no file, and its folder may be the only one
        return self.spark.read.schema(full).option("basePath", f"{self._folder}/data").parquet(f"{self._folder}/data")

    def _published(self, names: list[str] | None = None) -> DataFrame:
        """Directory rows of live batches, or of those given, with the ``name`` of their batch."""
        names = self._live_batches() if names is None else names
        place = f"{self._folder}/directory"
        rows = self.spark.read.parquet(*(f"{place}/batch={n}" for n in names))
        return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]*)/[^/]*$", 1))

    def _parts(self, names: list[str] | None = None) -> list[str]:
        """Parts that hold the records of live batches, or of those given: one per batch."""
        return [r["part"] for r in self._published(names).select("part").distinct().collect()]

    def data(self) -> DataFrame:
        """All records of published batches with their cell; ``cell`` is a partition column."""
        return self._live(self._stored_rows().filter(F.col("part").isin(self._parts())).drop("part"))

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self._dead_cells()
        return rows.filter(~F.col("cell").isin(dead)) if dead else rows

    def directory(self) -> DataFrame:
        """Directory over all batches."""
        return d.merge_directories(self._live(self._published()))

    def count(self) -> DataFrame:
        """One row ``(n_items)``, from the directory alone."""
        return d.item_count(self.directory())

    def _touches(self, query: KeyAt | KeyRange | PointAt | Window) -> Column:
        """Whether a directory row's bounds admit an answer."""
        if isinstance(query, KeyAt):
            return F.lit(query.key).between(F.col("min_key"), F.col("max_key"))
        if isinstance(query, KeyRange):
            return (F.col("max_key") >= query.low) & (F.col("min_key") <= query.high)
        if isinstance(query, PointAt):
            return g.contains_point(Box.of(), F.lit(float(query.x)), F.lit(float(query.y)))
        return g.intersects(Box.of(), query.box)

    def candidate_cells(self, query: KeyAt | KeyRange | PointAt | Window) -> list[int]:
        """Cells that can hold an answer: a small filter over the directory."""
        directory = self.directory().filter(F.col("n_items") > 0)
        return sorted(row["cell"] for row in directory.filter(self._touches(query)).select("cell").collect())

    def _asked_values(self, query: KeyAt | KeyRange | PointAt | Window) -> list[Column] | None:
        """What the filters can be asked for: literals of the columns' own types; None for other queries."""
        if not self.membership or not isinstance(query, KeyAt if len(self.at.columns) == 1 else PointAt):
            return None
        literals = [F.lit(query.key)] if isinstance(query, KeyAt) else [F.lit(float(query.x)), F.lit(float(query.y))]
        given = [f.dataType for f in self.spark.range(0).select(*(v.alias(f"v{i}") for i, v in enumerate(literals))).schema]
        kinds = [self.schema[c].dataType for c in self.at.columns]
        if not all(m.comparable(a, b) for a, b in zip(given, kinds)):
            return None
        return [v.try_cast(kind) for v, kind in zip(literals, kinds)]

    def candidate_places(self, query: KeyAt | PointAt) -> list[tuple[str, int]]:
        """``(part, cell)`` that can hold an answer, by the bounds of each part and, where it has them, by its filters."""
        live = self._live(self._published()).filter((F.col("n_items") > 0) & self._touches(query))
        places = [(r["part"], r["cell"]) for r in live.select("part", "cell").collect()]  # at most one row per part and cell
        asked = self._asked_values(query)
        if not places or asked is None:
            return sorted(places)
        place = f"{self._folder}/filters"
        parts = sorted({part for part, _ in places})
        filters = self.spark.read.option("basePath", place).parquet(*(f"{place}/part={part}" for part in parts))
        code = m.hash_of(asked, [self.schema[c].dataType for c in self.at.columns])
        known = m.may_hold(filters.filter(_among(sorted({cell for _, cell in places}))), code)
        return sorted(set(places).intersection((r["part"], r["cell"]) for r in known.select("part", "cell").collect()))

    def _at_places(self, places: list[tuple[str, int]]) -> DataFrame:
        rows = self._stored_rows()
        by_part: dict[str, list[int]] = {}
        for part, cell in places:
            by_part.setdefault(part, []).append(cell)
        wanted = [(F.col("part") == part) & _among(cells) for part, cells in by_part.items()]  # one per batch
        return (rows.filter(reduce(or_, wanted)) if wanted else rows.limit(0)).drop("part")

    def _pruned(self, cells: list[int]) -> DataFrame:
        data = self.data()
        return data.filter(_among(cells)) if cells else data.limit(0)

    def lookup(self, query: KeyAt | KeyRange | PointAt | Window) -> DataFrame:
        """Values that answer one query, reading candidate cells only."""
        if self._asked_values(query) is not None:
            data = self._at_places(self.candidate_places(query))
        else:
            data = self._pruned(self.candidate_cells(query))
        columns, value = self.at.columns, self.at.value
        if len(columns) == 1:
            return key_query(data, query, key=columns[0], value=value)
        if len(columns) == 2:
            return point_query(data, query, x=columns[0], y=columns[1], value=value)
        return rect_query(data, query, sides=columns, value=value)

    def route(self, queries: DataFrame) -> DataFrame:
        """``(qid, cell)`` for a query table; the table's columns tell the kind of query."""
        names = set(queries.columns)
        if "k" in names:
            return d.route_keys(queries, self.layout.cell_of(F.col("k")))
        if "low" in names:
            return d.route_key_ranges(queries, self.directory())
        if "px" in names:
            return d.route_points(queries, self.directory())
        return d.route_rects(queries, self.directory())

    def match(self, queries: DataFrame, *, tuning: joins.JoinTuning = joins.DEFAULT_TUNING) -> DataFrame:
        """``(qid, value)`` for a whole query table, reading only cells some query needs.

        The stored cells take the place of a shuffle of the data.  A query table that is too large to be
        broadcast is cut into blocks by the cells that its queries are routed to.  Each block's queries
        are broadcast to its own cells, so every stored row is read where it lies and meets the queries of one
        block.  Only where a single cell has more queries than a block takes is it read once per block.
        A batch of more than ``MOST_BLOCKS`` would fill the driver with broadcasts and is shuffled with the data instead.
        """
        routed = self.route(queries)
        most = tuning.broadcast_rows if {"k", "px"} & set(queries.columns) and len(self.at.columns) < 4 else max(1, tuning.broadcast_rows // BLOCK_SHARE)
        if row_count_up_to(queries, most) <= most:
            cells = sorted(row["cell"] for row in routed.select("cell").distinct().collect())  # at most one row per cell
            return self._matched(self._pruned(cells), queries, tuning)
        asked = routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # at most one row per cell
        blocks = query_blocks([(r["cell"], r["n"]) for r in asked], most)
        if sum(pieces for _, pieces in blocks) > MOST_BLOCKS:
            return self._matched(self._pruned([r["cell"] for r in asked]), queries, tuning)
        routed, found = cut_lineage(routed), []
        for cells, pieces in blocks:
            wanted = routed.filter(F.col("cell").between(cells[0], cells[-1])).select(F.col("qid").alias("__routed"))
            own = queries.join(wanted, F.col("qid").eqNullSafe(F.col("__routed")), "left_semi")
            for piece in range(pieces):
                some = own if pieces == 1 else own.filter(F.pmod(F.xxhash64(*own.columns), F.lit(pieces)) == piece)
                found.append(self._matched(self._pruned(cells), cut_lineage(some), tuning))
        return reduce(DataFrame.union, found) if found else self._matched(self._pruned([]), queries, tuning)

    def _matched(self, data: DataFrame, queries: DataFrame, tuning: joins.JoinTuning) -> DataFrame:
        columns, value = self.at.columns, self.at.value
        names = set(queries.columns)
        if len(columns) == 1:
            match = joins.match_keys if "k" in names else joins.match_key_ranges
            return match(data, queries, key=columns[0], value=value, tuning=tuning)
        if len(columns) == 2:
            match = joins.match_points if "px" in names else joins.match_points_in_rects
            return match(data, queries, x=columns[0], y=columns[1], value=value, tuning=tuning)
        match = joins.match_rects_at_points if "px" in names else joins.match_rects
        return match(data, queries, sides=columns, value=value, tuning=tuning)
