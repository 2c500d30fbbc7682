"""Age range → birth-date range."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def years_before(day: dt.date, years: int) -> dt.date | None:
    """Same month and day ``years`` earlier; 29 February becomes 28 February
    when the target year has none; ``None`` before year 1."""
    year = day.year - years
    if year < dt.MINYEAR:
        return None
    if (day.month, day.day) == (2, 29) and not calendar.isleap(year):
        return day.replace(year=year, day=28)
    return day.replace(year=year)


def birth_date_bounds(as_of: dt.date, start_age: int, end_age: int) -> tuple[dt.date | None, dt.date]:
    """``(min_birth, max_birth)`` for people aged ``start_age``..``end_age`` on ``as_of``.

    ``min_birth = as_of - end_age years`` and ``max_birth = as_of - start_age
    years``; the filter that uses them excludes both ends. A lower bound
    before year 1 is ``None`` (open); an upper one is the first date there is.
    """
    if start_age >= end_age:
        raise ValueError(f"wrong age range: {start_age} >= {end_age}")
    return years_before(as_of, end_age), years_before(as_of, start_age) or dt.date.min


def widest_bounds(as_of: dt.date, ranges: Sequence[tuple[int, int]]) -> tuple[dt.date | None, dt.date]:
    """The birth-date bounds that hold all of the age ranges."""
    bounds = [birth_date_bounds(as_of, start, end) for start, end in ranges]
    lows = [low for low, _ in bounds]
    return None if None in lows else min(lows), max(high for _, high in bounds)


def birth_date_bounds_col(as_of: Column, start_age: Column, end_age: Column) -> tuple[Column, Column]:
    """Column form of :func:`birth_date_bounds` for a table of age ranges.

    ``add_months`` clamps to the last day of a shorter month, as the scalar
    form does for 29 February.
    """
    return F.add_months(as_of, -12 * end_age), F.add_months(as_of, -12 * start_age)
