"""Row predicates as Column expressions.

Written as expressions, not row lambdas, so Catalyst can push them into the
Parquet scan (``PushedFilters``) and keep them inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.constants import SUBJECT_ID
from custos.functions.columns import quoted


def any_not_null(columns: Sequence[str], exclude: str = SUBJECT_ID) -> Column:
    """True when any column other than ``exclude`` is non-null.

    The name test is case-sensitive. A frame whose only column is ``exclude``
    keeps every row (O9). NaN is not null, so a NaN value keeps its row.
    """
    columns = list(columns)
    if columns == [exclude]:
        return F.lit(True)
    checks = [quoted(c).isNotNull() for c in columns if c != exclude]
    return reduce(or_, checks, F.lit(False))


# Bits of a whole number's magnitude.
_INTEGER_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _decimal_literal(text: str, data_type: T.DecimalType) -> Column | None:
    """The number as exactly that decimal type; ``None`` if it does not fit."""
    with decimal.localcontext(decimal.Context(prec=200, Emax=9999, Emin=-9999)):
        try:
            number = decimal.Decimal(text)
            scaled = number.quantize(decimal.Decimal(1).scaleb(-data_type.scale))
        except decimal.InvalidOperation:
            return None
        if scaled != number or abs(scaled) >= decimal.Decimal(10) ** (data_type.precision - data_type.scale):
            return None
        return F.lit(format(scaled, "f")).cast(data_type)


def literal_like(value, data_type: T.DataType) -> Column | None:
    """A literal of ``data_type`` for a value given as text or Python object.

    Returns ``None`` when the value cannot be read as that type or lies
    outside it: comparing with it could match no row, and under ANSI mode a
    SQL cast would raise. Numbers are plain digits (no ``_``, ``nan`` or
    ``inf``).
    """
    if isinstance(data_type, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    text = str(value).strip()
    if type(data_type) in _INTEGER_BITS:
        bits = _INTEGER_BITS[type(data_type)]
        match = re.fullmatch(r"([+-]?)0*([0-9]{1,19})", text)
        number = int(match.group(1) + match.group(2)) if match else None
        if number is None or not -(1 << bits) <= number < 1 << bits:
            return None
        return F.lit(number).cast(data_type)
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
            return None
        if isinstance(data_type, T.DecimalType):
            return _decimal_literal(text, data_type)
        number = float(text)
        return F.lit(number).cast(data_type) if math.isfinite(number) else None
    if isinstance(data_type, T.DateType):
        day = as_date(value)
        return None if day is None else F.lit(day)
    return F.lit(value).cast(data_type)


def as_date(value) -> dt.date | None:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value).strip())
    except ValueError:
        return None


def in_open_range(column: Column, data_type: T.DataType, low: dt.date | None, high: dt.date) -> Column:
    """``low < column < high`` with both ends excluded (O13); ``low`` may be open.

    A string column holds ISO dates, compared as text (ISO text sorts like
    dates); a timestamp column is compared by its date. Null never matches.
    """
    column = comparable(column, data_type)
    below = column < bound_literal(data_type, high)
    return below if low is None else (column > bound_literal(data_type, low)) & below


def comparable(column: Column, data_type: T.DataType) -> Column:
    """The form in which birth dates of this type are compared with bounds."""
    return column.cast(T.DateType()) if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)) else column


def bound_literal(data_type: T.DataType, day: dt.date) -> Column:
    text = F.lit(day.isoformat())
    return text if isinstance(data_type, T.StringType) else text.cast(T.DateType())
