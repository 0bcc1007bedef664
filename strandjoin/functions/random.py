"""Seeds of reads and the generator that they start, in 32-bit arithmetic on LONGs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quality import chars
from .sequence import col

MASK = 0xFFFFFFFF
# The factors of the global seed and the generator's multiplier and increment.
FACTORS = (59, 61, 67, 71, 73, 79, 83)
MULTIPLIER, INCREMENT = 1664525, 1013904223


def _folded(codes: Column, step: int, slots: int) -> Column:
    shifted = F.transform(codes, lambda c, i: c * F.pow(F.lit(2), (i % slots) * step).cast("long"))
    return F.aggregate(shifted, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.bitwiseAND(F.lit(MASK))))


def read_seed(seq: Column | str, qual: Column | str, name: Column | str, seed: int = 0) -> Column:
    """Mixes bases (two bits each, 16 places), qualities and name (a byte each, 4 places) into the global seed."""
    start = (seed + 101) * math.prod(FACTORS) & MASK
    base = F.transform(chars(col(seq)), lambda c: (F.instr(F.lit("ACGTN"), c) - 1).cast("long"))
    code = lambda s: F.transform(chars(col(s)), lambda c: F.ascii(c).cast("long"))
    return F.lit(start).cast("long").bitwiseXOR(_folded(base, 2, 16)).bitwiseXOR(_folded(code(qual), 8, 4)).bitwiseXOR(_folded(code(name), 8, 4))


def step(state: Column) -> Column:
    return (state * MULTIPLIER + INCREMENT).bitwiseAND(F.lit(MASK))


def draw(state: Column) -> tuple[Column, Column]:
    """(value, next state): two steps, of which the first gives the low half of the bits."""
    one = step(state)
    two = step(one)
    return F.shiftrightunsigned(one, 16).bitwiseXOR(two), two
