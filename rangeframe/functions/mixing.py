"""Reproducible pseudo-random columns from integer arithmetic.

``rand()`` depends on partitioning and row order, so it changes when a task is
re-run.  These columns depend only on ``(id, seed, stream)``, and any SQL engine
with 64-bit integers reproduces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixer: a Mersenne prime modulus and three multipliers.
MODULUS = 2_147_483_647
MULTIPLIER_A = 48_271
MULTIPLIER_B = 69_621
MULTIPLIER_C = 40_692
SEED_STEP = 7_919
STREAM_STEP = 104_729


def mixed(id_col: Column, seed: int, stream: int) -> Column:
    """Pseudo-random BIGINT in ``[0, MODULUS)``; every product stays below 2**63."""
    offset = (seed * SEED_STEP + stream * STREAM_STEP) % MODULUS
    key = id_col.cast("bigint")
    base = F.pmod(key, F.lit(MODULUS))
    # how often the modulus went into the id; without it the draws would repeat after 2**31 - 1 ids
    turns = F.pmod(F.pmod(F.call_function("div", key - base, F.lit(MODULUS).cast("bigint")), F.lit(MODULUS)) * MULTIPLIER_B, F.lit(MODULUS))
    first = F.pmod(base * MULTIPLIER_A + turns + F.lit(offset), F.lit(MODULUS))
    squared = F.pmod(first * first, F.lit(MODULUS))
    second = F.pmod(squared + F.pmod(first * MULTIPLIER_B, F.lit(MODULUS)) + base, F.lit(MODULUS))
    return F.pmod(second * MULTIPLIER_C + F.lit(offset + stream), F.lit(MODULUS))


def mixed_int(id_col: Column, low: int, high: int, seed: int, stream: int) -> Column:
    """Integer in ``[low, high]``, both ends possible."""
    span = high - low + 1
    if span < 1:
        raise ValueError(f"empty integer range [{low}, {high}]")
    if span <= MODULUS:
        draw = mixed(id_col, seed, stream)
    else:
        # two draws side by side cover spans up to 2**62
        draw = mixed(id_col, seed, stream) * MODULUS + mixed(id_col, seed, stream + 500)
    return F.pmod(draw, F.lit(span).cast("bigint")) + F.lit(low).cast("bigint")


def mixed_unit(id_col: Column, seed: int, stream: int) -> Column:
    """DOUBLE in ``[0, 1]``."""
    return mixed(id_col, seed, stream).cast("double") / F.lit(float(MODULUS - 1))


def permutation_step(span: int) -> int:
    """A multiplier coprime to ``span``, so that ``id * step mod span`` never repeats."""
    step = max(1, int(span * 0.6180339887498949))
    while math.gcd(step, span) != 1:
        step += 1
    return step
