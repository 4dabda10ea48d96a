"""Batches of queries as joins.

A batch is a join of the data with a query table.  Spark has no equi-key for
``low <= key <= high`` or for overlapping rectangles, so both sides get cell
numbers on a uniform grid and meet in an equi-join on the cell, with the exact
predicate as residual condition.

Cells come in levels; each level's cells are four times as wide as the one
below.  A query lives on the finest level where it covers few cells, so a very
wide query costs a handful of rows rather than thousands, and nothing ever
falls back to comparing all pairs.  The coarsest level is one single cell.

* Key and point data have one cell per level that queries use (usually one).
* Rectangle data live on their own level as well; a pair meets on the coarser of
  the two levels, in the one cell that holds the lower-left corner of the
  overlap, so each pair comes out exactly once.

A query side whose expanded size is counted and small is broadcast, and the data
is then never shuffled.  Beyond that size both sides are shuffled, with the
cells that hold very many rows split by salt.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..functions.geometry import Box
from ..plans.runtime import broadcast_if_small, cut_lineage, row_count_up_to

TOP_LEVEL = 9  # one cell for everything
LEVEL_FACTOR = 4.0
CELL_LIMIT = float(1 << 40)  # cell numbers saturate here, on both sides alike


@dataclass(frozen=True)
class JoinTuning:
    """Size limits of the batch joins; none of them changes an answer."""

    query_cells: int = 64  # most cells of a query on its own level
    data_cells: int = 4  # most cells of a data rectangle on its own level
    broadcast_rows: int = 500_000  # most expanded query rows to broadcast
    hot_rows: int = 2_000_000  # data rows of one cell or key above which it is split


DEFAULT_TUNING = JoinTuning()


# -- meeting on a key ---------------------------------------------------------


def _and(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def key_row_counts(data: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, __n)``: exact row counts, checkpointed so that one pass over the data serves all uses."""
    return cut_lineage(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))


def join_on(
    data: DataFrame,
    queries: DataFrame,
    keys: list[str],
    *,
    small: bool,
    tuning: JoinTuning = DEFAULT_TUNING,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join of ``data`` with a query side; ``small`` says its size was checked.

    Without ``small`` both sides are shuffled, and every key of more than
    ``hot_rows`` data rows is salted, into as many pieces as it takes: a data row
    goes to one piece, the query rows of a hot key to all of them.  Keys of equal
    value but different type (INT and BIGINT, FLOAT and DOUBLE) meet, as in any join.
    ``counts`` are the data's ``key_row_counts`` where the caller has them.  The
    merge hint keeps Spark from broadcasting a side by its size before expansion.
    """
    data, queries = _common_types(data, queries, keys)
    if small:
        return data.join(F.broadcast(queries), keys)
    if data.isStreaming:
        return data.join(queries, keys)
    counts = key_row_counts(data, keys) if counts is None else counts
    pieces = F.ceil(F.col("__n") / tuning.hot_rows).cast("int").alias("__salts")
    heavy = cut_lineage(counts.filter(F.col("__n") > tuning.hot_rows).select(*keys, pieces))
    if heavy.isEmpty():
        return data.join(queries.hint("merge"), keys)
    # there is at most one hot key for every ``hot_rows`` data rows
    heavy = broadcast_if_small(_common_types(heavy, data, keys)[0], tuning.broadcast_rows)
    # the partition id spreads identical copies as well; a re-run task has the same id
    content = F.xxhash64(*data.columns, F.spark_partition_id())
    salt = F.coalesce(F.pmod(content, F.col("__salts").cast("bigint")), F.lit(0)).cast("int")
    spread = data.join(heavy, keys, "left").withColumn("__salt", salt).drop("__salts")
    copies = queries.join(heavy, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return spread.join(copies.drop("__salts").hint("merge"), [*keys, "__salt"]).drop("__salt")


def _common_types(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with keys of the type that a comparison of the two would use."""
    for key in keys:
        if a.schema[key].dataType != b.schema[key].dataType:
            common = a.select(key).union(b.select(key)).schema[key].dataType
            a, b = a.withColumn(key, F.col(key).cast(common)), b.withColumn(key, F.col(key).cast(common))
    return a, b


def _usable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the columns: those match nothing."""
    tests = []
    for name in columns:
        tests.append(F.col(name).isNotNull())
        if df.schema[name].dataType.simpleString() in ("float", "double"):
            tests.append(~F.isnan(name))
    return df.filter(_and(tests))


def _in_text(value: Column, kind: T.DataType) -> Column:
    """A key as text that gives back exactly the same key, whatever the session's time zone."""
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def _from_text(text: str, kind: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(int(text))) if isinstance(kind, T.TimestampType) else F.lit(text).cast(kind)


@dataclass(frozen=True)
class _Reach:
    """How many queries there are, and the least and the greatest key they ask for, as literals of the key's own type."""

    rows: int
    ends: tuple[tuple[Column, Column], ...] | None  # None if no query asks for anything
    texts: tuple[tuple[str, str], ...] = ()

    def within(self, data: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``data`` between the ends, as plain comparisons for the scan."""
        if self.ends is None:
            return data.filter(F.lit(False))
        return data.filter(_and([F.col(key).between(*ends) for key, ends in zip(keys, self.ends)]))


def _reach(queries: DataFrame, lows: Sequence[str], highs: Sequence[str]) -> _Reach:
    """One aggregate over the queries.

    Bounds travel as text and are cast back by Spark: Python's own dates and times would not
    come back as the same type, nor as the same time in another zone.
    """
    measures = [F.count(F.lit(1)).alias("n")]
    for i, (low, high) in enumerate(zip(lows, highs)):
        for name, best, column in ((f"lo{i}", F.min, low), (f"hi{i}", F.max, high)):
            measures.append(_in_text(best(column), queries.schema[column].dataType).alias(name))
    row = queries.agg(*measures).first()
    if row["n"] == 0:
        return _Reach(0, None)
    texts = tuple((row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(lows)))
    kinds = [(queries.schema[low].dataType, queries.schema[high].dataType) for low, high in zip(lows, highs)]
    ends = tuple((_from_text(a, ka), _from_text(b, kb)) for (a, b), (ka, kb) in zip(texts, kinds))
    return _Reach(row["n"], ends, texts)


# -- grids with levels --------------------------------------------------------


@dataclass(frozen=True)
class Axis:
    """One axis of a box: its range, as two columns."""

    low: Column
    high: Column

    @property
    def extent(self) -> Column:
        return self.high.cast("double") - self.low.cast("double")


@dataclass(frozen=True)
class QueryGrid:
    """What a query table asks of the grid: base cell sides and the levels its queries live on."""

    sides: tuple[float, ...]
    levels: tuple[int, ...]
    own_rows: float  # query rows, counted on each query's own level
    reach: tuple[tuple[object, object], ...]  # per axis, the range outside which no query looks

    def within_reach(self, lows: Sequence[Column], highs: Sequence[Column]) -> Column:
        """Plain comparisons on the data's columns, so they are pushed into the scan."""
        tests = []
        for (first, last), low, high in zip(self.reach, lows, highs):
            if first is not None and last is not None:
                tests += [high >= F.lit(first), low <= F.lit(last)]
        return _and(tests) if tests else F.lit(False)


def _cell_number(v: Column, side: Column | float) -> Column:
    scaled = v.cast("double") / (F.lit(side) if isinstance(side, float) else side)
    return F.floor(F.least(F.greatest(scaled, F.lit(-CELL_LIMIT)), F.lit(CELL_LIMIT)))


def _own_level(axes: Sequence[Axis], sides: Sequence[float], most_cells: int) -> Column:
    """Finest level where a box covers at most about ``most_cells`` cells.

    A range of length ``w`` covers at most ``w / side + 2`` cells, so the level
    follows from the logarithm of the extent.
    """
    spare = max(1.0, most_cells ** (1.0 / len(axes)) - 2.0)
    steps = [F.ceil(F.log(LEVEL_FACTOR, axis.extent / (side * spare))) for axis, side in zip(axes, sides)]
    # log of an empty extent is null (and least() skips nulls), of an endless one infinite
    needed = [F.least(F.coalesce(s.cast("double"), F.lit(0.0)), F.lit(float(TOP_LEVEL))) for s in steps]
    return F.greatest(F.lit(0.0), *needed).cast("int")


def plan_grid(queries: DataFrame, axes: Sequence[Axis], tuning: JoinTuning, *, min_side: float = 0.0) -> QueryGrid:
    """Choose cell sides from the query table and measure what it expands to.

    Two aggregates over the query table, none over the data.  A side is half the
    median query extent, but not far below the spacing between queries, which is
    taken between the fifth and the last but fifth hundredth: a few far queries do
    not widen the cells of all others.
    """
    finite = F.lit(float("inf"))

    def known(c: Column) -> Column:
        return F.when(F.abs(c.cast("double")) < finite, c.cast("double"))

    measures = [F.count(F.lit(1)).alias("n")]
    for i, axis in enumerate(axes):
        measures += [
            F.percentile_approx(known(axis.high.cast("double") - axis.low.cast("double")), 0.5, 1000).alias(f"m{i}"),
            F.percentile_approx(known(axis.low), 0.05, 1000).alias(f"lo{i}"),
            F.percentile_approx(known(axis.high), 0.95, 1000).alias(f"hi{i}"),
            F.min(axis.low).alias(f"first{i}"),
            F.max(axis.high).alias(f"last{i}"),
        ]
    stats = queries.agg(*measures).first()
    n_queries = stats["n"]
    sides = []
    for i in range(len(axes)):
        extent = (stats[f"hi{i}"] or 0.0) - (stats[f"lo{i}"] or 0.0)
        spacing = max(extent, 0.0) / max(1.0, n_queries ** (1.0 / len(axes)))
        sides.append(max((stats[f"m{i}"] or 0.0) / 2.0, spacing / 8.0, min_side) or 1.0)
    placed = queries.select("*", _own_level(axes, sides, tuning.query_cells).alias("__level"))
    counts = []
    for axis, base in zip(axes, sides):
        side = _side_at(base, F.col("__level"))
        span = _number_at(axis.high, side) - _number_at(axis.low, side)
        counts.append(span.cast("double") + 1.0)
    own_rows = F.sum(reduce(lambda a, b: a * b, counts))
    used = placed.groupBy("__level").agg(own_rows.alias("own_rows")).collect()  # at most TOP_LEVEL + 1 rows
    return QueryGrid(
        tuple(sides),
        tuple(sorted(row["__level"] for row in used)) or (0,),
        sum(row["own_rows"] for row in used),
        tuple((stats[f"first{i}"], stats[f"last{i}"]) for i in range(len(axes))),
    )


def _side_at(base: float, level: Column) -> Column:
    """Cell side of a level, null on the top level; powers of four are exact."""
    return F.when(level < TOP_LEVEL, F.lit(base) * F.pow(F.lit(LEVEL_FACTOR), level))


def _number_at(v: Column, side: Column) -> Column:
    return F.when(side.isNull(), F.lit(0).cast("bigint")).otherwise(_cell_number(v, side))


def _side_names(n_axes: int) -> list[str]:
    return [f"__side{i}" for i in range(n_axes)]


def _cell_names(n_axes: int) -> list[str]:
    return [f"__cell{i}" for i in range(n_axes)]


def _cell_keys(n_axes: int) -> list[str]:
    return ["__level", *_cell_names(n_axes)]


def _with_level_sides(df: DataFrame, grid: QueryGrid) -> DataFrame:
    level = F.col("__level")
    return df.select("*", *(_side_at(b, level).alias(n) for b, n in zip(grid.sides, _side_names(len(grid.sides)))))


def _expand_cells(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """One row per covered cell of the row's level."""
    for axis, side, cell in zip(axes, _side_names(len(axes)), _cell_names(len(axes))):
        cells = F.sequence(_number_at(axis.low, F.col(side)), _number_at(axis.high, F.col(side)))
        df = df.select("*", F.explode(cells).alias(cell))
    return df


def _one_cell_side(data: DataFrame, values: Sequence[Column], grid: QueryGrid) -> DataFrame:
    """Keys or points: one cell on each level in use."""
    n = len(values)
    if len(grid.levels) == 1:
        (level,) = grid.levels
        cells = [
            F.lit(0).cast("bigint") if level == TOP_LEVEL else _cell_number(v, base * LEVEL_FACTOR**level)
            for v, base in zip(values, grid.sides)
        ]
        return data.select("*", F.lit(level).alias("__level"), *(c.alias(k) for c, k in zip(cells, _cell_names(n))))
    spread = data.select("*", F.explode(F.array(*(F.lit(level) for level in grid.levels))).alias("__level"))
    spread = _with_level_sides(spread, grid)
    cells = [_number_at(v, F.col(s)).alias(k) for v, s, k in zip(values, _side_names(n), _cell_names(n))]
    return spread.select("*", *cells).drop(*_side_names(n))


def _own_cells_side(queries: DataFrame, axes: Sequence[Axis], grid: QueryGrid, tuning: JoinTuning) -> DataFrame:
    """Queries over keys or points: the covered cells of the query's own level."""
    placed = queries.select("*", _own_level(axes, grid.sides, tuning.query_cells).alias("__level"))
    return _expand_cells(_with_level_sides(placed, grid), axes).drop(*_side_names(len(axes)))


def _box_side(
    df: DataFrame,
    axes: Sequence[Axis],
    grid: QueryGrid,
    most_cells: int,
    guest_levels: Sequence[int] | None,
    own_name: str,
) -> DataFrame:
    """Boxes that meet boxes: cells on the own level and on each coarser guest level (None: all)."""
    df = df.select("*", _own_level(axes, grid.sides, most_cells).alias(own_name))
    own = F.col(own_name)
    if guest_levels is None:
        levels = F.sequence(own, F.lit(TOP_LEVEL))
    else:
        guests = [F.when(own < level, F.lit(level)) for level in guest_levels if level > 0]
        levels = F.array_compact(F.array(own, *guests))
    df = df.select("*", F.explode(levels).alias("__level"))
    return _expand_cells(_with_level_sides(df, grid), axes)


def _is_small(side: DataFrame, tuning: JoinTuning) -> bool:
    return row_count_up_to(side, tuning.broadcast_rows) <= tuning.broadcast_rows


def _range_match(
    data: DataFrame,
    values: Sequence[Column],
    queries: DataFrame,
    axes: Sequence[Axis],
    predicate: Column,
    tuning: JoinTuning,
    min_side: float = 0.0,
) -> DataFrame:
    """Rows of ``data`` whose position lies in a query's box."""
    grid = plan_grid(queries, axes, tuning, min_side=min_side)
    located = _one_cell_side(data.filter(grid.within_reach(values, values)), values, grid)
    expanded = _own_cells_side(queries, axes, grid, tuning)
    small = grid.own_rows <= tuning.broadcast_rows
    met = join_on(located, expanded, _cell_keys(len(axes)), small=small, tuning=tuning)
    return met.filter(predicate)


# -- keys ---------------------------------------------------------------------


def match_keys(
    data: DataFrame,
    queries: DataFrame,
    *,
    key: str = "key",
    value: str = "value",
    qid: str = "qid",
    k: str = "k",
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every record whose key equals a query's key."""
    left = data.select(F.col(key).alias("__key"), F.col(value).alias("value"))
    right = _usable(queries.select(F.col(k).alias("__key"), F.col(qid).alias("qid")), ["__key"])
    asked = _reach(right, ["__key"], ["__key"])
    small = asked.rows <= tuning.broadcast_rows
    return join_on(asked.within(left, ["__key"]), right, ["__key"], small=small, tuning=tuning).select("qid", "value")


def match_key_ranges(
    data: DataFrame,
    queries: DataFrame,
    *,
    key: str = "key",
    value: str = "value",
    qid: str = "qid",
    low: str = "low",
    high: str = "high",
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every record with ``low <= key <= high``; ``low > high`` matches nothing.

    Keys may be of any atomic type that has an order: numbers, dates, times, strings.
    """
    left = _usable(data.select(F.col(key).alias("__key"), F.col(value).alias("value")), ["__key"])
    bounds = queries.select(F.col(qid).alias("qid"), F.col(low).alias("__low"), F.col(high).alias("__high"))
    right = _usable(bounds, ["__low", "__high"]).filter(F.col("__low") <= F.col("__high"))
    kind, skip = left.schema["__key"].dataType, 0
    asked = _reach(right, ["__low"], ["__high"])
    left = asked.within(left, ["__key"])
    if isinstance(kind, T.StringType) and asked.texts:
        both = [e.encode() for e in asked.texts[0]]
        skip = next((i for i, (a, b) in enumerate(zip(*both)) if a != b), min(map(len, both)))
    right = right.withColumns({"__from": _ordinal(F.col("__low").cast(kind), kind, skip), "__to": _ordinal(F.col("__high").cast(kind), kind, skip)})
    left = left.withColumn("__at", _ordinal(F.col("__key"), kind, skip))
    axis = Axis(F.col("__from"), F.col("__to"))
    predicate = F.col("__key").between(F.col("__low"), F.col("__high"))
    return _range_match(left, [F.col("__at")], right, [axis], predicate, tuning).select("qid", "value")


def _ordinal(key: Column, kind: T.DataType, skip: int) -> Column:
    """A number that never falls as the key rises; equal numbers are told apart by the exact predicate.

    For strings it is made from the seven bytes after the first ``skip``, which all
    keys in question share.
    """
    if isinstance(kind, T.StringType):
        digits = F.substring(F.hex(F.encode(key, "UTF-8")), 2 * skip + 1, 14)
        return F.conv(F.rpad(digits, 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # by its fields: as an instant it would fall where clocks are set back
        seconds = F.hour(key) * 3600 + F.minute(key) * 60 + F.date_part(F.lit("SECOND"), key).cast("double")
        return F.unix_date(key.cast("date")).cast("double") * 86400.0 + seconds
    return key.cast("double")


# -- points -------------------------------------------------------------------


def match_points(
    data: DataFrame,
    queries: DataFrame,
    *,
    x: str = "x",
    y: str = "y",
    value: str = "value",
    qid: str = "qid",
    px: str = "px",
    py: str = "py",
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every point equal to a query point on both coordinates."""
    left = data.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(value).alias("value"))
    right = _usable(queries.select(F.col(px).alias("__x"), F.col(py).alias("__y"), F.col(qid).alias("qid")), ["__x", "__y"])
    asked = _reach(right, ["__x", "__y"], ["__x", "__y"])
    small = asked.rows <= tuning.broadcast_rows
    return join_on(asked.within(left, ["__x", "__y"]), right, ["__x", "__y"], small=small, tuning=tuning).select("qid", "value")


def _query_boxes(queries: DataFrame, qid: str, sides: Sequence[str]) -> DataFrame:
    names = ("__qxmin", "__qymin", "__qxmax", "__qymax")
    return queries.select(F.col(qid).alias("qid"), *(F.col(s).alias(n) for s, n in zip(sides, names)))


_QUERY_BOX = ("__qxmin", "__qymin", "__qxmax", "__qymax")
_DATA_BOX = ("__xmin", "__ymin", "__xmax", "__ymax")


def match_points_in_rects(
    data: DataFrame,
    queries: DataFrame,
    *,
    x: str = "x",
    y: str = "y",
    value: str = "value",
    qid: str = "qid",
    sides: Sequence[str] = ("qxmin", "qymin", "qxmax", "qymax"),
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every point inside a query rectangle; inverted ones match nothing."""
    left = data.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(value).alias("value"))
    left = _usable(left, ["__x", "__y"])
    box = Box.of(*_QUERY_BOX)
    right = _usable(_query_boxes(queries, qid, sides), _QUERY_BOX).filter((box.xmin <= box.xmax) & (box.ymin <= box.ymax))
    axes = [Axis(box.xmin, box.xmax), Axis(box.ymin, box.ymax)]
    predicate = g.contains_point(box, "__x", "__y")
    return _range_match(left, [F.col("__x"), F.col("__y")], right, axes, predicate, tuning).select("qid", "value")


# -- rectangles ---------------------------------------------------------------


def _overlap_match(
    data: DataFrame, queries: DataFrame, predicate: Column, tuning: JoinTuning
) -> DataFrame:
    """Pairs of boxes that satisfy ``predicate``, which must imply overlap of the normalized boxes."""
    box, qbox = Box.of(*_DATA_BOX), Box.of(*_QUERY_BOX)
    norm, qnorm = g.normalized(box), g.normalized(qbox)
    query_axes = [Axis(qnorm.xmin, qnorm.xmax), Axis(qnorm.ymin, qnorm.ymax)]
    data_axes = [Axis(norm.xmin, norm.xmax), Axis(norm.ymin, norm.ymax)]
    grid = plan_grid(queries, query_axes, tuning)

    near = data.filter(grid.within_reach([box.xmin, box.ymin], [box.xmax, box.ymax]))
    left = _box_side(near, data_axes, grid, tuning.data_cells, grid.levels, "__own")
    # a data box may live on any coarser level, so queries show up on those that data boxes do live on
    levels, counts = None, None
    if not data.isStreaming:
        own = near.select(_own_level(data_axes, grid.sides, tuning.data_cells).alias("level")).distinct()
        levels = sorted(row["level"] for row in own.collect())  # at most TOP_LEVEL + 1
    right = _box_side(queries, query_axes, grid, tuning.query_cells, levels, "__qown")
    right = right.drop("__side0", "__side1")
    small = _is_small(right, tuning)
    if not small and not data.isStreaming:
        counts = key_row_counts(left, _cell_keys(2))
    met = join_on(left, right, _cell_keys(2), small=small, tuning=tuning, counts=counts)

    once = _and(
        [
            F.col("__level") == F.greatest("__own", "__qown"),
            F.col("__cell0") == _number_at(F.greatest(norm.xmin, qnorm.xmin), F.col("__side0")),
            F.col("__cell1") == _number_at(F.greatest(norm.ymin, qnorm.ymin), F.col("__side1")),
        ]
    )
    return met.filter(predicate & once)


def _data_boxes(data: DataFrame, value: str, sides: Sequence[str]) -> DataFrame:
    picked = data.select(F.col(value).alias("value"), *(F.col(s).alias(n) for s, n in zip(sides, _DATA_BOX)))
    return _usable(picked, _DATA_BOX)


def match_rects(
    data: DataFrame,
    queries: DataFrame,
    *,
    sides: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"),
    value: str = "value",
    qid: str = "qid",
    query_sides: Sequence[str] = ("qxmin", "qymin", "qxmax", "qymax"),
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every rectangle that touches or overlaps a query rectangle."""
    left = _data_boxes(data, value, sides)
    right = _usable(_query_boxes(queries, qid, query_sides), _QUERY_BOX)
    predicate = g.intersects(Box.of(*_DATA_BOX), Box.of(*_QUERY_BOX))
    return _overlap_match(left, right, predicate, tuning).select("qid", "value")


def match_rects_at_points(
    data: DataFrame,
    queries: DataFrame,
    *,
    sides: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"),
    value: str = "value",
    qid: str = "qid",
    px: str = "px",
    py: str = "py",
    tuning: JoinTuning = DEFAULT_TUNING,
) -> DataFrame:
    """``(qid, value)`` for every rectangle that contains a query point."""
    left = _data_boxes(data, value, sides)
    right = queries.select(F.col(qid).alias("qid"), *(F.col(c).alias(n) for c, n in zip((px, py, px, py), _QUERY_BOX)))
    right = _usable(right, _QUERY_BOX)
    predicate = g.contains_point(Box.of(*_DATA_BOX), "__qxmin", "__qymin")
    return _overlap_match(left, right, predicate, tuning).select("qid", "value")
