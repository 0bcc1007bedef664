"""Quality values: scales, rounding and penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col

# Phred values of the Solexa values -10 to 9; from 10 on they are equal, under -10 they are 0.
SOLEXA = (0, 1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9, 10)
LARGEST = 93


def rounded(q: Column | str) -> Column:
    """To the nearest ten, at most 30."""
    return F.least(F.lit(30), (F.floor((col(q) + 5) / 10) * 10).cast("int"))


def penalty(q: Column | str, rounding: bool = True) -> Column:
    """What a mismatch at a base of quality q costs."""
    return rounded(q) if rounding else col(q).cast("int")


def solexa_to_phred(q: Column | str) -> Column:
    v = col(q)
    return F.when(v < -10, F.lit(0)).when(v >= 10, v).otherwise(F.element_at(F.array(*map(F.lit, SOLEXA)), (v + 11).cast("int"))).cast("int")


def decode(char: Column | str, scale: str = "phred33") -> Column:
    """A quality character as a Phred value; characters under the scale's least are errors."""
    code = F.ascii(col(char))
    if scale == "phred33":
        return F.when(code < 33, F.raise_error(F.lit("quality character under '!'"))).otherwise(code - 33).cast("int")
    if scale == "phred64":
        return F.when(code < 64, F.raise_error(F.lit("quality character under '@'"))).otherwise(code - 64).cast("int")
    if scale == "solexa64":
        return F.when(code < 59, F.raise_error(F.lit("quality character under ';'"))).otherwise(solexa_to_phred(code - 64)).cast("int")
    raise ValueError(f"unknown scale {scale}")


def encode(q: Column | str) -> Column:
    """A Phred value as a character of the Phred+33 scale."""
    return F.char(F.least(col(q), F.lit(LARGEST)) + 33)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def to_phred33(qual: Column | str, scale: str = "phred33", integers: bool = False) -> Column:
    """A quality string, or white-space separated integers, in the Phred+33 scale."""
    q = col(qual)
    if integers:
        values = F.transform(F.filter(F.split(q, r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
        values = F.transform(values, solexa_to_phred) if scale == "solexa64" else values
    elif scale == "phred33":
        return F.when(q.rlike("[^!-~]"), F.raise_error(F.lit("quality character outside '!' to '~'"))).otherwise(q).cast("string")
    else:
        values = F.transform(chars(q), lambda c: decode(c, scale))
    return F.array_join(F.transform(values, encode), "")


def default(seq: Column | str) -> Column:
    """Quality 40 for every base."""
    return F.repeat(F.lit("I"), F.length(col(seq)))


def values(qual: Column | str) -> Column:
    """Phred values of a Phred+33 string."""
    return F.transform(chars(col(qual)), lambda c: F.ascii(c) - 33)


def convert_phred_to_solexa(q: Column | str) -> Column:
    """By error probabilities: p = 10^(-q/10), then the odds' logarithm; q of at least 1."""
    p = F.pow(F.lit(10.0), -col(q) / 10)
    return F.round(-10 * F.log10(p / (1 - p))).cast("int")


def convert_solexa_to_phred(q: Column | str) -> Column:
    odds = F.pow(F.lit(10.0), -col(q) / 10)
    return F.round(-10 * F.log10(odds / (1 + odds))).cast("int")
