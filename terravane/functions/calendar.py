"""Calendar windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column, shift: int) -> Column:
    """First of the month `shift` months on."""
    return F.trunc(F.add_months(day, shift), "month")


def same_window(start: Column, end: Column, year: Column) -> tuple[Column, Column]:
    """A window moved to another year, its end as many years after its start as before; 29 February becomes 28."""
    move = (year - F.year(start)) * 12
    return F.add_months(start, move), F.add_months(end, move)


def stamp(day: Column, hhmm: Column) -> Column:
    """UTC timestamp of a date and a time given as an integer such as 1342."""
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), F.floor(hhmm / 100).cast("int"), hhmm % 100, F.lit(0))


def week_of_month(day: Column) -> Column:
    """1 to 5: seven-day weeks from the first of the month."""
    return F.least(F.floor((F.dayofmonth(day) - 1) / 7) + 1, F.lit(5)).cast("int")
