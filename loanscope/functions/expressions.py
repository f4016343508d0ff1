"""Column expressions shared by every operator. All of them stay inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanscope.schemas import Bands


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, digits: int) -> Column:
    """Round half to even, the rounding of numpy and pandas."""
    return F.bround(col(c), digits)


def half_away(c: str | Column, digits: int) -> Column:
    """Round half away from zero, the rounding of SQL ROUND."""
    return F.round(col(c), digits)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole as DOUBLE; null when the whole is zero."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def clip(c: str | Column, low: float, high: float) -> Column:
    """Bound a value. least/greatest skip nulls, so a null is kept null explicitly."""
    c = col(c)
    bounded = F.least(F.greatest(c, F.lit(low).cast("double")), F.lit(high).cast("double"))
    return F.when(c.isNotNull(), bounded)


def null_if_nan(c: str | Column) -> Column:
    """NaN compares greater than every number in Spark; treat it as missing instead."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def at_most(c: str | Column, bound: float) -> Column:
    """c <= bound for a fractional bound. The whole-number test is implied by it; on an integer column only that one
    can reach a file scan, since the exact test has to widen the column."""
    return (col(c) <= F.lit(math.ceil(bound))) & (col(c) <= F.lit(bound))


def below(c: str | Column, bound: float) -> Column:
    """c < bound, with the same implied test."""
    return (col(c) <= F.lit(math.ceil(bound))) & (col(c) < F.lit(bound))


def banded(c: str | Column, bands: Bands) -> Column:
    """Right-closed banding; null outside the outermost edges."""
    c = col(c)
    out = None
    for low, high, label in zip(bands.edges, bands.edges[1:], bands.labels):
        inside = (c > F.lit(low)) if high is None else (c > F.lit(low)) & (c <= F.lit(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def rank_in(c: str | Column, order) -> Column:
    """1-based position of a label in an explicit order; null for labels outside it."""
    c = col(c)
    out = None
    for i, label in enumerate(order, 1):
        out = F.when(c == F.lit(label), F.lit(i)) if out is None else out.when(c == F.lit(label), F.lit(i))
    return out


def lookup(c: str | Column, table: Mapping[str, float]) -> Column:
    """Constant-table lookup; null for keys outside the table. The table is code, so nothing is shipped or joined."""
    c = col(c)
    out = None
    for key, value in table.items():
        v = F.lit(float(value))
        out = F.when(c == F.lit(key), v) if out is None else out.when(c == F.lit(key), v)
    return out


def by_cutoffs(c: str | Column, cutoffs) -> Column:
    """Label of the first cut-off reached, for (cut-off, label) pairs from high to low; null stays null."""
    c = col(c)
    out = None
    for cutoff, label in cutoffs:
        hit = c.isNotNull() if cutoff is None else c >= F.lit(cutoff)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def decimal_text(c: str | Column, digits: int) -> Column:
    """Shortest decimal text with at least one decimal: 18.90 -> '18.9', 20.00 -> '20.0', never scientific."""
    fixed = col(c).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(fixed, f"0{{1,{digits - 1}}}$", "") if digits > 1 else fixed


def thousands(c: str | Column) -> Column:
    return F.format_number(col(c), 0)


HASH_RANGE = (0, 2**60 - 1)


def row_hash(columns) -> Column:
    """60-bit hash of a row, the same in every engine that has MD5. Missing values are spelled \\N."""
    text = F.array_join(F.array(*[col(c).cast("string") for c in columns]), "|", "\\N")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
