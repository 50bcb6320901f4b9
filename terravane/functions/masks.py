"""Masks and null rules. A masked value is NULL, never NaN, and no comparison turns it into a number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL, which least() and greatest() alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def known(x: Column, *inputs: Column) -> Column:
    """x where none of the inputs is NULL, else NULL. A CASE, least() and greatest() alone would make a number of a masked input."""
    return F.when(reduce(and_, (i.isNotNull() for i in inputs)), x)


def where_chain(first: Column, *rules: tuple[Column, object]) -> Column:
    """first, replaced by the value of the last rule that holds (a CASE lets the first one win)."""
    out = None
    for condition, value in reversed(rules):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return first if out is None else out.otherwise(first)


def clear_scl(scl: Column) -> Column:
    """Scene classes that are neither shadow, cloud nor snow."""
    return ~scl.isin(3, 8, 9, 10, 11)


def clear_qa(qa: Column) -> Column:
    """Bits 0 to 4 (fill, dilated cloud, cirrus, cloud, shadow) all clear."""
    return qa.bitwiseAND(31) == 0


def clear_thermal(qa: Column, celsius: Column, low: float = 0, high: float = 70) -> Column:
    """Cloud bits clear, not water, and a plausible temperature."""
    return (qa.bitwiseAND(26) == 0) & (qa.bitwiseAND(128) == 0) & (celsius > low) & (celsius < high)


def masked(condition: Column, bands: Sequence[str]) -> list[Column]:
    return [F.when(condition, F.col(b)).alias(b) for b in bands]


def zero_is_nodata(x: Column) -> Column:
    return F.when(x != 0, x)


def in_days(day: Column, start: str, end: str) -> Column:
    """start <= day < end."""
    return (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))


def in_months(day: Column, first: int, last: int) -> Column:
    return F.month(day).between(first, last)


# fixed values: names that stand for a missing one, alone and as a part
NO_NAMES = ("", "?", "-", "(unnamed)", "none")
NO_NAME_PARTS = ("not available", "unknown", "unnamed", "no data", "n/a")


def is_named(name: Column) -> Column:
    """Whether a name is more than a placeholder."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    named = ~low.isin(*NO_NAMES)
    for part in NO_NAME_PARTS:
        named = named & ~low.contains(part)
    return named
