"""Query sets drawn with replacement from existing records, so every query hits.

A draw is a pseudo-random rank per query.  The data is not sorted for it: rows are
counted per slice of the value range in one aggregate, each rank is turned into
its slice, and only the rows of slices with a wanted rank are sorted.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mixing import MODULUS, mixed, mixed_unit
from ..operators.ranks import with_rank
from ..plans.runtime import broadcast_if_small

BROADCAST_DRAWS = 500_000
SIDE = 64  # slices are SIDE * SIDE


def _slice_of(data: DataFrame, column: str) -> Column:
    """Number of the slice of a value; slices are of equal width, later ones hold larger values."""
    if not isinstance(data.schema[column].dataType, T.NumericType):
        return F.lit(0)
    v = F.col(column).cast("double")
    low, high = data.agg(F.min(v), F.max(v)).first()
    if low is None or not low < high < float("inf") or low == -float("inf"):
        return F.lit(0)
    place = F.floor((v - low) / (high - low) * (SIDE * SIDE))
    return F.coalesce(F.greatest(F.least(place, F.lit(SIDE * SIDE - 1)), F.lit(0)), F.lit(0)).cast("int")


def _last_not_above(starts: list[int], rank: Column) -> Column:
    """Index of the last of the ``SIDE * SIDE`` sorted starts that is not above ``rank``, by two short searches."""
    every = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    coarse = F.split(F.lit(",".join(map(str, starts[::SIDE]))), ",").cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda s: s <= rank)) - 1
    inside = F.size(F.filter(F.slice(every, block * SIDE + 1, F.lit(SIDE)), lambda s: s <= rank)) - 1
    return (block * SIDE + inside).cast("int")


def _drawn(data: DataFrame, order_by: list[str], ids: DataFrame, seed: int) -> DataFrame:
    """``(qid, data columns)``: one row of ``data`` per id, chosen uniformly by its rank in ``order_by``."""
    number = _slice_of(data, order_by[0])
    counted = data.groupBy(number.alias("slice")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most SIDE * SIDE rows
    sizes = [0] * (SIDE * SIDE)
    for row in counted:
        sizes[row["slice"]] = row["n"]
    n_rows, starts = sum(sizes), [0, *accumulate(sizes)][:-1]
    qid = F.col("id").cast("bigint")
    # two mixed draws side by side reach every rank of a table beyond 2**31 rows
    draw = mixed(qid, seed, 11)
    if n_rows > MODULUS:
        draw = draw * MODULUS + mixed(qid, seed, 12)
    picks = ids.select(
        qid.alias("qid"), F.pmod(draw, F.lit(max(n_rows, 1)).cast("bigint")).alias("__rank")
    )
    picks = picks.withColumn("__slice", _last_not_above(starts, F.col("__rank")))
    wanted = sorted(r["__slice"] for r in picks.select("__slice").distinct().collect())
    # ranks among the rows of wanted slices: less the rows of the slices left out before
    before = list(accumulate((sizes[i] for i in wanted), initial=0))
    shift = data.sparkSession.createDataFrame(
        [(i, starts[i] - b) for i, b in zip(wanted, before)], "__slice int, __shift bigint"
    )
    kept = data if len(wanted) == len(counted) else data.filter(number.isin(wanted))
    picks = picks.join(F.broadcast(shift), "__slice").select("qid", (F.col("__rank") - F.col("__shift")).alias("__rank"))
    ranked = with_rank(kept, order_by, "__rank")
    return ranked.join(broadcast_if_small(picks, BROADCAST_DRAWS), "__rank").drop("__rank")


def sample_keys(data: DataFrame, ids: DataFrame, *, key: str = "key", value: str = "value", seed: int = 0) -> DataFrame:
    """``(qid, k)``: existing keys, one per id."""
    drawn = _drawn(data.select(key, value), [value, key], ids, seed)
    return drawn.select("qid", F.col(key).alias("k"))


def sample_points(
    data: DataFrame, ids: DataFrame, *, x: str = "x", y: str = "y", value: str = "value", seed: int = 0
) -> DataFrame:
    """``(qid, px, py)``: exact existing points, one per id."""
    drawn = _drawn(data.select(x, y, value), [value, x, y], ids, seed)
    return drawn.select("qid", F.col(x).alias("px"), F.col(y).alias("py"))


def sample_points_in_rects(
    data: DataFrame,
    ids: DataFrame,
    *,
    sides: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax"),
    value: str = "value",
    seed: int = 0,
) -> DataFrame:
    """``(qid, px, py)``: a uniform point inside a drawn rectangle, one per id."""
    xmin, ymin, xmax, ymax = sides
    drawn = _drawn(data.select(value, *sides), [value, *sides], ids, seed)
    px = F.col(xmin) + mixed_unit(F.col("qid"), seed, 13) * (F.col(xmax) - F.col(xmin))
    py = F.col(ymin) + mixed_unit(F.col("qid"), seed, 14) * (F.col(ymax) - F.col(ymin))
    # rounding may step over the far edge by one unit in the last place
    return drawn.select(
        "qid", F.least(px, F.col(xmax)).alias("px"), F.least(py, F.col(ymax)).alias("py")
    )
