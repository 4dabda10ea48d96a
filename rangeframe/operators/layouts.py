"""Named layouts: each gives every record a ``cell``.

A layout object holds the few numbers that fix its cells, so the same cells can
be computed later for appended records, streams and queries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as c
from ..functions import geometry as g
from ..functions.cells import Bounds
from ..functions.geometry import Box
from ..plans.runtime import cut_lineage
from .directory import key_bounds, point_bounds, read_bounds
from .intervals import bounds_below, constant_array, with_interval
from .kdsplit import ROOT, kd_cells
from .quadleaves import quad_leaves

MOST_ACCURACY = 1_000_000  # bounds the memory of a quantile summary
QUANTILE_ERRORS = 100  # a bound of packed cells is off by at most this part of a share
MAX_CELLS = 100_000  # default of ``most_cells``: cells travel with the plan and are listed on the driver


def _check_cells(n_cells: int, most_cells: int) -> None:
    if not 1 <= n_cells <= most_cells:
        raise ValueError(f"the number of cells must be in [1, {most_cells}]; most_cells raises the limit")


@dataclass(frozen=True)
class Position:
    """Where a record lies: a key column, two coordinates, or four sides (their center counts)."""

    columns: tuple[str, ...]
    value: str = "value"

    def __post_init__(self):
        if len(self.columns) not in (1, 2, 4):
            raise ValueError("give one key column, two coordinates or four sides")

    @property
    def key(self) -> Column:
        return F.col(self.columns[0])

    @property
    def xy(self) -> tuple[Column, Column]:
        if len(self.columns) == 2:
            return F.col(self.columns[0]), F.col(self.columns[1])
        return g.center(Box.of(*self.columns))

    @property
    def sides(self) -> tuple[str, str, str, str]:
        if len(self.columns) == 2:
            return (*self.columns, *self.columns)
        return self.columns  # type: ignore[return-value]


KEY = Position(("key",))
POINT = Position(("x", "y"))
RECT = Position(("xmin", "ymin", "xmax", "ymax"))


@dataclass(frozen=True)
class KeyChunks:
    """Equal-width key intervals."""

    min_key: int
    width: int
    n_cells: int
    name = "key"

    @classmethod
    def fit(cls, df: DataFrame, at: Position, n_cells: int, *, most_cells: int = MAX_CELLS) -> "KeyChunks":
        _check_cells(n_cells, most_cells)
        row = key_bounds(df, key=at.columns[0]).first()
        if row["n_items"] == 0:
            return cls(0, 1, n_cells)
        return cls(row["min_key"], c.chunk_width(row["min_key"], row["max_key"], n_cells), n_cells)

    def cell_of(self, key: Column) -> Column:
        return c.key_chunk(key, self.min_key, self.width, self.n_cells)

    def assign(self, df: DataFrame, at: Position = KEY, cell: str = "cell") -> DataFrame:
        return df.withColumn(cell, self.cell_of(at.key))


@dataclass(frozen=True)
class Grid:
    """Uniform row-major grid; ``clamp_to`` folds surplus cells into the last one."""

    bounds: Bounds
    rows: int
    cols: int
    clamp_to: int | None = None
    min_cell: float = 1.0
    name = "grid"

    @classmethod
    def fit(
        cls, df: DataFrame, at: Position, n_cells: int, *, clamp: bool = False, min_cell: float = 1.0, most_cells: int = MAX_CELLS
    ) -> "Grid":
        _check_cells(n_cells, most_cells)
        rows, cols = c.grid_dimensions(n_cells)
        return cls(_data_bounds(df, at), rows, cols, n_cells if clamp else None, min_cell)

    @property
    def n_cells(self) -> int:
        return self.clamp_to or self.rows * self.cols

    def assign(self, df: DataFrame, at: Position = POINT, cell: str = "cell") -> DataFrame:
        x, y = at.xy
        number = c.grid_cell(x, y, self.bounds, self.rows, self.cols, self.clamp_to, self.min_cell)
        return df.withColumn(cell, number)


@dataclass(frozen=True)
class Quad:
    """Quadtree cells of one depth."""

    bounds: Bounds
    depth: int
    clamp_to: int | None = None
    name = "quad"

    @classmethod
    def fit(cls, df: DataFrame, at: Position, n_cells: int, *, clamp: bool = False, most_cells: int = MAX_CELLS) -> "Quad":
        _check_cells(n_cells, most_cells)
        return cls(_data_bounds(df, at), c.quad_depth(n_cells), n_cells if clamp else None)

    @property
    def n_cells(self) -> int:
        return self.clamp_to or 4**self.depth

    def assign(self, df: DataFrame, at: Position = POINT, cell: str = "cell") -> DataFrame:
        x, y = at.xy
        coded = c.with_quad_path(df, x, y, self.bounds, self.depth, path=cell)
        number = F.col(cell)
        if self.clamp_to is not None:
            number = F.least(number, F.lit(self.clamp_to - 1).cast("bigint"))
        return coded.withColumn(cell, number.cast("int"))


@dataclass(frozen=True)
class KdCells:
    """Median-split cells; ``pivots`` holds ``(node, coord, value)`` of each splitting node."""

    depth: int
    pivots: tuple[tuple[int, float, object], ...] = ()
    value_type: str = "bigint"
    name = "kd"

    @classmethod
    def fit(cls, df: DataFrame, at: Position, n_cells: int, *, most_cells: int = MAX_CELLS) -> "KdCells":
        _check_cells(n_cells, most_cells)
        depth = (n_cells - 1).bit_length()
        x, y = at.xy
        placed = df.select(x.alias("x"), y.alias("y"), F.col(at.value).alias("value"))
        kind = placed.schema["value"].dataType.simpleString()
        placed = kd_cells(placed, depth=depth, keep_pivot=False)
        return cls(depth, tuple(_pivots(placed, depth)), kind)

    @property
    def n_cells(self) -> int:
        return 2**self.depth

    def assign(self, df: DataFrame, at: Position = POINT, cell: str = "cell") -> DataFrame:
        """Descend the stored pivots: one broadcast join of bounded size per level."""
        spark = df.sparkSession
        x, y = at.xy
        state = df.withColumns({"__node": F.lit(ROOT).cast("bigint"), "__x": x, "__y": y})
        for level in range(self.depth):
            rows = [p for p in self.pivots if p[0].bit_length() == level + 1]
            pivots = spark.createDataFrame([(n, c, str(p)) for n, c, p in rows], "__node bigint, __coord double, __pivot string")
            pivots = pivots.withColumn("__pivot", F.col("__pivot").cast(self.value_type))
            state = state.join(F.broadcast(pivots), "__node", "left")
            v = F.col("__x" if level % 2 == 0 else "__y")
            right = (v > F.col("__coord")) | ((v == F.col("__coord")) & (F.col(at.value) >= F.col("__pivot")))
            # a node without a pivot never split: all its records go left
            step = F.coalesce(right, F.lit(False)).cast("bigint")
            state = state.withColumn("__node", F.col("__node") * 2 + step).drop("__coord", "__pivot")
        number = (F.col("__node") - F.lit(2**self.depth)).cast("int")
        return state.select(*df.columns, number.alias(cell))


@dataclass(frozen=True)
class QuadLeaves:
    """Leaves of an adaptive quadtree as intervals of its curve: none holds more than ``capacity`` points.

    ``starts`` holds the first code of each interval on the finest level and its cell, in the order of codes.  An
    interval ends where the next one begins, so boxes that were empty belong to the leaf before them.
    Only identical points, and what the finest level cannot tell apart, may exceed the capacity.
    """

    bounds: Bounds
    depth: int
    capacity: int
    starts: tuple[tuple[int, int], ...] = ((0, 0),)
    name = "leaves"

    @classmethod
    def fit(
        cls, df: DataFrame, at: Position, n_cells: int, *, capacity: int | None = None, max_depth: int = 16, most_cells: int = MAX_CELLS
    ) -> "QuadLeaves":
        """Without ``capacity``, it is what ``n_cells`` half full leaves would hold together."""
        _check_cells(n_cells, most_cells)
        bounds, depth = _data_bounds(df, at), min(30, max_depth + max_depth % 2)  # whole digits of four bits
        if capacity is None:
            capacity = max(1, -(-2 * df.count() // n_cells))
        empty = cls(bounds, depth, capacity)
        codes = empty.leaf_codes(df, at, most_cells)
        return cls(bounds, depth, capacity, tuple((0 if i == 0 else code, i) for i, code in enumerate(codes)) or ((0, 0),))

    def leaf_codes(self, df: DataFrame, at: Position, most_cells: int = MAX_CELLS) -> list[int]:
        """First codes of the leaves that the records alone would need, in order."""
        x, y = at.xy
        leaves = quad_leaves(df.select(x.alias("x"), y.alias("y")), capacity=self.capacity, max_depth=self.depth, bounds=self.bounds)
        leaves = cut_lineage(leaves)
        _check_cells(max(1, leaves.count()), most_cells)
        rows = leaves.select("level", "path").collect()
        return sorted(r["path"] << 2 * (self.depth - r["level"]) for r in rows)

    @property
    def n_cells(self) -> int:
        return len(self.starts)

    def assign(self, df: DataFrame, at: Position = POINT, cell: str = "cell") -> DataFrame:
        x, y = at.xy
        coded = c.with_quad_path(df, x, y, self.bounds, self.depth, path="__path")
        placed = with_interval(coded, F.col("__path"), list(self.starts), 2 * self.depth, cell)
        return placed.drop("__path")

    def split(self, codes: Sequence[int], cells: Sequence[int], next_cell: int) -> list[tuple[int, int]]:
        """``(first code, new cell)`` of the pieces of over-full ``cells`` that begin at some of the ``codes``.

        The first piece gets a new cell as well: a cell that was split holds nothing any more.  A cell in which
        no piece begins cannot be split and is left out.
        """
        ends = [start for start, _ in self.starts[1:]] + [1 << 2 * self.depth]
        pieces = []
        for (start, cell), end in zip(self.starts, ends):
            inside = [code for code in codes if start < code < end] if cell in cells else []
            if inside:
                pieces += [(code, next_cell + len(pieces) + i) for i, code in enumerate([start, *inside])]
        return pieces

    def with_splits(self, rows: Sequence[tuple[int, int]]) -> "QuadLeaves":
        """The layout after all splits ``(first code, cell)``: of the cells of one code the latest counts."""
        latest = dict(self.starts)
        for code, cell in rows:
            latest[code] = max(cell, latest.get(code, -1))
        return QuadLeaves(self.bounds, self.depth, self.capacity, tuple(sorted(latest.items())))


@dataclass(frozen=True)
class Packed:
    """Sort-tile-recursive cells: slices of equal numbers of centers along x, each cut into tiles along y.

    ``slices`` holds the x at which each slice but the first begins, ``tiles`` for every slice the y at which each
    of its tiles but the first begins.  Cells follow the data, so they are small where the data are dense, and rectangles
    of a cell lie close together.  A slice that got more than its share, as its centers have one x, has more tiles.
    Only centers of one position may make a cell larger; approximate quantiles make cells uneven by a percent or so.
    """

    slices: tuple[float, ...] = ()
    tiles: tuple[tuple[float, ...], ...] = ((),)
    name = "packed"

    @classmethod
    def fit(cls, df: DataFrame, at: Position, n_cells: int, *, most_cells: int = MAX_CELLS) -> "Packed":
        """Two aggregates of quantiles and one of counts; an empty table has one cell."""
        _check_cells(n_cells, most_cells)
        x, y = at.xy
        placed = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("NOT isnan(x) AND NOT isnan(y)")
        side = math.isqrt(n_cells - 1) + 1
        slices = _distinct(placed.agg(_quantiles("x", side).alias("q")).first()["q"])
        placed = placed.withColumn("slice", bounds_below(F.col("x"), slices))
        sizes = {r["slice"]: r["n"] for r in placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(sizes.values())
        cuts = {s: max(1, round(n_cells * n / total)) for s, n in sizes.items()}
        kinds = sorted(set(cuts.values()))  # as many quantiles in all as there are cells, at most
        found = {}
        if kinds:
            has = {k: F.col("slice").isin([s for s in cuts if cuts[s] == k]) for k in kinds}
            wanted = [_quantiles("y", k, has[k]).alias(f"q{k}") for k in kinds]
            rows = placed.groupBy("slice").agg(*wanted)  # one row per slice
            found = {r["slice"]: _distinct(r[f"q{cuts[r['slice']]}"]) for r in rows.collect()}
        return cls(tuple(slices), tuple(tuple(found.get(s, ())) for s in range(len(slices) + 1)))

    @property
    def n_cells(self) -> int:
        return sum(len(t) + 1 for t in self.tiles)

    def assign(self, df: DataFrame, at: Position = RECT, cell: str = "cell") -> DataFrame:
        """Two binary searches in the row, over bounds that travel with the plan."""
        x, y = at.xy
        kept = [F.col(f"`{c}`") for c in df.columns if c != cell]
        state = df.select(*kept, y.cast("double").alias("__y"), bounds_below(x.cast("double"), self.slices).alias("__slice"))
        counts = [len(t) for t in self.tiles]
        firsts = list(accumulate(counts, initial=0))[:-1]
        place = bounds_below(F.col("__y"), [b for t in self.tiles for b in t], F.col("__slice"), firsts, counts)
        number = F.get(constant_array(firsts, "int"), F.col("__slice")) + F.col("__slice") + place
        return state.select(*kept, number.alias(cell))


def _quantiles(column: str, pieces: int, given: Column | None = None) -> Column:
    """The bounds between ``pieces`` equal shares."""
    v = F.col(column) if given is None else F.when(given, F.col(column))
    if pieces == 1:
        return F.max(F.array().cast("array<double>"))
    return F.percentile_approx(v, [i / pieces for i in range(1, pieces)], max(10_000, min(QUANTILE_ERRORS * pieces, MOST_ACCURACY)))


def _distinct(bounds: Sequence[float] | None) -> list[float]:
    return sorted(set(bounds or ()))


def _pivots(placed: DataFrame, depth: int) -> list[tuple[int, float, object]]:
    """The least record of each right half, which is the record its parent split at."""
    if depth == 0:
        return []
    bottom = placed.filter(F.col("node") >= 2**depth)  # nodes that stopped early need no pivot below
    steps = []
    for level in range(depth):
        child = F.shiftright(F.col("node"), depth - level - 1)
        at = F.struct(F.col("x" if level % 2 == 0 else "y").alias("coord"), F.col("value").alias("value"))
        right = child.bitwiseAND(F.lit(1)) == 1
        steps.append(F.when(right, F.struct(F.shiftright(child, 1).alias("parent"), at.alias("at"))))
    halves = bottom.select(F.inline(F.array_compact(F.array(*steps))))
    pivots = halves.groupBy("parent").agg(F.min("at").alias("at"))
    # at most 2**depth - 1 rows
    return [(r["parent"], r["at"]["coord"], r["at"]["value"]) for r in pivots.collect()]


def _data_bounds(df: DataFrame, at: Position) -> Bounds:
    if len(at.columns) == 4:
        sides = at.sides
        row = df.agg(
            F.min(sides[0]).alias("xmin"), F.min(sides[1]).alias("ymin"),
            F.max(sides[2]).alias("xmax"), F.max(sides[3]).alias("ymax"),
        )
        return read_bounds(row)
    return read_bounds(point_bounds(df, x=at.columns[0], y=at.columns[1]))


LAYOUTS = {"key": KeyChunks, "grid": Grid, "quad": Quad, "kd": KdCells, "leaves": QuadLeaves, "packed": Packed}
Layout = KeyChunks | Grid | Quad | KdCells | QuadLeaves | Packed


def fit_layout(df: DataFrame, by: str, *, at: Position, n_cells: int, **options) -> Layout:
    """Fit the layout of that name to the data."""
    if by not in LAYOUTS:
        raise ValueError(f"unknown layout {by!r}; choose from {sorted(LAYOUTS)}")
    return LAYOUTS[by].fit(df, at, n_cells, **options)


def with_cells(df: DataFrame, by: str, *, at: Position, n_cells: int, cell: str = "cell", **options) -> DataFrame:
    """``df`` with the cell of the layout of that name."""
    return fit_layout(df, by, at=at, n_cells=n_cells, **options).assign(df, at, cell)


def layout_to_dict(layout: Layout) -> dict:
    return {"layout": layout.name, **asdict(layout)}


def layout_from_dict(state: dict) -> Layout:
    state = dict(state)
    cls = LAYOUTS[state.pop("layout")]
    if "bounds" in state:
        state["bounds"] = Bounds(**state["bounds"])
    for name in ("pivots", "starts", "tiles"):
        if name in state:
            state[name] = tuple(tuple(p) for p in state[name])
    if "slices" in state:
        state["slices"] = tuple(state["slices"])
    return cls(**state)


# -- physical placement -------------------------------------------------------


def sorted_by_key(df: DataFrame, *, key: str = "key", partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by key, so parquet min/max statistics become selective."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(F.col(key))
    return ranged.sortWithinPartitions(key)


def colocated(df: DataFrame, sort_by: Sequence[str] = (), *, cell: str = "cell") -> DataFrame:
    """Rows of a cell side by side.

    A rebalance, not a plain hash shuffle: at run time Spark splits the partitions
    of very large cells and joins small ones, so no task gets a cell of any size whole.
    """
    return df.hint("rebalance", F.col(cell)).sortWithinPartitions(cell, *sort_by)
