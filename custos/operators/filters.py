"""Row filters."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.constants import BIRTH_DATE, SUBJECT_ID
from custos.functions.columns import quoted
from custos.functions.predicates import any_not_null, in_open_range, literal_like


def drop_all_null(df: DataFrame, exclude: str = SUBJECT_ID) -> DataFrame:
    """Remove rows whose columns other than ``exclude`` are all null.

    After a policy hides cells as nulls, a row with only its subject id left
    carries nothing the requester may see. With ``exclude="date"`` it drops
    rows whose value is null once the subject column is gone (O10).

    Columns are told apart by position, as in a row: when a policy answer
    repeats a name (``SELECT *`` over a join) or has names equal but for
    case, the frame is filtered under positional names and renamed back
    (both renames are plain projections that Catalyst removes, so the
    filter still reaches the scan).
    """
    names = df.columns
    if len({n.lower() for n in names}) == len(names):
        return df.filter(any_not_null(names, exclude))
    positional = [f"_c{i}" for i in range(len(names))]
    keep = [p for p, n in zip(positional, names) if n != exclude]
    cond = F.lit(True) if names == [exclude] else reduce(or_, [F.col(p).isNotNull() for p in keep], F.lit(False))
    return df.toDF(*positional).filter(cond).toDF(*names)


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where ``column`` equals ``value``.

    The value is turned into a literal of the column's type on the driver, so
    nothing is pasted into SQL text; a value that cannot be read as that type
    matches no row.
    """
    literal = literal_like(value, df.schema[column].dataType)
    if literal is None:
        return df.filter(F.lit(False))
    return df.filter(quoted(column) == literal)


def filter_birth_range(df: DataFrame, low: dt.date | None, high: dt.date, column: str = BIRTH_DATE) -> DataFrame:
    """Rows born strictly between ``low`` (``None``: open) and ``high``."""
    return df.filter(in_open_range(quoted(column), df.schema[column].dataType, low, high))
