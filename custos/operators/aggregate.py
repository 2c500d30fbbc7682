"""Averages (O19, O20) and their batch form over age ranges.

An average is weighted per measurement: every non-null value counts once.
To keep hot patients from skewing the plan, values are first reduced to a
``(sum, count)`` pair per patient (partial aggregation runs map-side, so a
patient with a third of all rows still leaves each task as one row), and
sums and counts are added up from there. The result equals ``avg`` up to the
last floating-point digit.

Many age ranges at once are an equi-join on the place of a birth date among
all their bounds. With the distinct bounds in order, a birth date's place is
the number of bounds below it plus the number of bounds not above it: odd at
a bound, even between two. A range, open at both ends, holds the places
strictly between those of its bounds. Bounds and birth dates are compared
exactly as the single-range filter compares them (text as text, timestamps
by date), so both forms agree on any column type. Partials are reduced per
birth date, then per place; each range is expanded to its places, and the
two meet there: no pairwise comparison of patients with ranges, and no limit
on the number of ranges.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.constants import BIRTH_DATE, SUBJECT_ID, VALUE
from custos.functions.columns import quoted
from custos.functions.dates import birth_date_bounds
from custos.functions.predicates import bound_literal, comparable

START_AGE = "startAge"
END_AGE = "endAge"
# Place of a birth date among the bounds of all ranges.
AGE = "_age"


def sum_name(column: str) -> str:
    return f"{column}__sum"


def count_name(column: str) -> str:
    return f"{column}__n"


def subject_partials(df: DataFrame, columns: Sequence[str], key: str = SUBJECT_ID) -> DataFrame:
    """Per-subject sum and count of non-null values of each column."""
    aggs = []
    for c in columns:
        aggs.append(F.sum(quoted(c)).alias(sum_name(c)))
        aggs.append(F.count(quoted(c)).alias(count_name(c)))
    return df.groupBy(quoted(key)).agg(*aggs)


def add_partials(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add up partial sums and counts per ``keys`` (all rows when empty)."""
    aggs = []
    for c in columns:
        aggs.append(F.sum(sum_name(c)).alias(sum_name(c)))
        aggs.append(F.sum(count_name(c)).alias(count_name(c)))
    grouped = df.groupBy(*[quoted(k) for k in keys]) if keys else df.groupBy()
    return grouped.agg(*aggs)


def mean_of(total: Column, count: Column) -> Column:
    """``total / count``; null when there is nothing to average."""
    return F.try_divide(total, count.cast(T.DoubleType()))


def average_from_partials(df: DataFrame, column: str, keys: Sequence[str] = (), name: str = VALUE) -> DataFrame:
    """``avg(column)`` per ``keys`` from per-subject partials."""
    aggs = [mean_of(F.sum(sum_name(column)), F.sum(count_name(column))).alias(name)]
    grouped = df.groupBy(*[quoted(k) for k in keys]) if keys else df.groupBy()
    return grouped.agg(*aggs)


def suppress_empty(df: DataFrame, column: str = VALUE) -> DataFrame:
    """Drop an all-null average row, leaving zero rows."""
    return df.filter(quoted(column).isNotNull())


def age_bounds(as_of: dt.date, ranges: Sequence[tuple[int, int]]) -> list[dt.date]:
    """The distinct birth-date bounds of all age ranges on ``as_of``, in order (open ones left out)."""
    return sorted({b for start, end in ranges for b in birth_date_bounds(as_of, start, end) if b is not None})


def age_partials(df: DataFrame, columns: Sequence[str], bounds: Sequence[dt.date],
                 column: str = BIRTH_DATE) -> DataFrame:
    """Add up partials per place among ``bounds`` (:func:`age_bounds`); null birth dates drop.

    There are at most ``2 * len(bounds) + 1`` places whatever the input size:
    a proven bound for broadcasting the result. Sums are made per birth date
    first, so the comparisons run once for each distinct date.
    """
    data_type = df.schema[column].dataType
    birth = comparable(quoted(column), data_type)
    sums = [f(c) for f in (sum_name, count_name) for c in columns]
    by_birth = add_partials(df.select(birth.alias(AGE), *sums).filter(F.col(AGE).isNotNull()), columns, (AGE,))
    literals = F.array(*[bound_literal(data_type, b) for b in bounds])
    below = F.size(F.filter(literals, lambda b: b < F.col(AGE)))
    not_above = F.size(F.filter(literals, lambda b: b <= F.col(AGE)))
    return add_partials(by_birth.withColumn(AGE, below + not_above), columns, (AGE,))


def age_range_frame(spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """The caller's age ranges as a table ``(startAge, endAge)``. Every range must have ``start < end``."""
    ranges = [(int(s), int(e)) for s, e in ranges]
    if not ranges:
        raise ValueError("no age ranges given")
    for start, end in ranges:
        if start >= end:
            raise ValueError(f"wrong age range: {start} >= {end}")
    return _rows(spark, [START_AGE, END_AGE], ranges)


def _rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[int]]) -> DataFrame:
    """A table of whole numbers from one JSON literal: no job to read it, and its size does not matter to the parser."""
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kind = ", ".join(f"{n}: int" for n in names)
    return spark.sql(f"SELECT inline(from_json('{text}', 'array<struct<{kind}>>'))")


def range_ages(spark: SparkSession, ranges: Sequence[tuple[int, int]], as_of: dt.date,
               bounds: Sequence[dt.date]) -> DataFrame:
    """``(startAge, endAge, place)`` for every place among ``bounds`` a range holds."""
    at = {b: i for i, b in enumerate(bounds)}
    rows = []
    for start, end in ranges:
        low, high = birth_date_bounds(as_of, start, end)
        rows.append((start, end, 0 if low is None else 2 * at[low] + 2, 2 * at[high]))
    if not rows:
        raise ValueError("no age ranges given")
    spans = _rows(spark, [START_AGE, END_AGE, "_from", "_to"], rows).filter("_from <= _to")
    return spans.select(START_AGE, END_AGE, F.explode(F.sequence("_from", "_to")).alias(AGE))


def join_age_ranges(by_age: DataFrame, places: DataFrame) -> DataFrame:
    """Pair each row of ``by_age`` with every range holding its place.

    ``by_age`` comes from :func:`age_partials` (bounded by the number of
    bounds), so it is broadcast; the expanded ranges (:func:`range_ages`) stay
    distributed however many the caller gave. Overlapping ranges each get the
    row; rows in no range drop out.
    """
    return places.join(F.broadcast(by_age), AGE).drop(AGE)
