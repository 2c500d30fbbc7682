"""Joins on the subject id (O18) and the size checks that guard them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.constants import SUBJECT_ID
from custos.functions.columns import quoted

# A point lookup (one patient) turns its matching subject ids into literals
# when there are at most this many; beyond it the lookup stays a semi-join.
DEFAULT_MAX_LITERAL_SUBJECTS = 10_000

# Bytes of a row besides its variable-width values: a header and a slot a column.
_ROW_BYTES, _SLOT_BYTES = 16, 8
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30,
          "t": 1 << 40, "tb": 1 << 40}


def bounded_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else ``None``.

    At most ``max_rows + 1`` rows reach the driver. A filter below it may
    still read its whole table to find them.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def _bytes(text: str) -> int:
    match = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", text)
    if not match or match.group(2).lower() not in _UNITS:
        raise ValueError(f"not a byte size: {text!r}")
    return int(match.group(1)) * _UNITS[match.group(2).lower()]


def _width(field: T.StructField) -> Column | None:
    """Bytes of a variable-width value, ``None`` for a fixed-width one."""
    column = quoted(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(column)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(column)))
    return None


def measured_size(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their bytes, by one aggregation over all of it.

    Every task sends one row of sums, so nothing is moved however large the
    table is; a Parquet table is scanned in its variable-width columns only.
    """
    widths = [w for w in map(_width, df.schema.fields) if w is not None]
    sums = [F.coalesce(F.sum(F.coalesce(w, F.lit(0)).cast("long")), F.lit(0)) for w in widths]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    return row[0], row[0] * (_ROW_BYTES + _SLOT_BYTES * len(df.columns)) + sum(row[1:])


def broadcast_threshold(df: DataFrame) -> int:
    """Bytes the session allows a broadcast side to have (0: broadcasts off)."""
    return max(0, _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")))


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(df)`` if its measured size is at most ``max_bytes``, else ``df``.

    The bound defaults to the session's broadcast threshold, so what is
    broadcast never exceeds the size Spark would broadcast on its own. Beyond
    it the join is left to Spark (sort-merge, or a broadcast chosen by AQE
    from measured sizes). The measurement reads the whole side once, while
    the query is built; it matters where Spark's estimate is far off: without
    column statistics the estimated size of a join is the product of its
    inputs' sizes, so a small table derived by a join never looks small.
    """
    most = broadcast_threshold(df) if max_bytes is None else max_bytes
    if most > 0 and measured_size(df)[1] <= most:
        return F.broadcast(df)
    return df


_BROADCAST_RIGHT = ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi",
                    "left_anti", "leftanti", "anti")


def join_subject(left: DataFrame, right: DataFrame, how: str = "inner", key: str = SUBJECT_ID,
                 check_broadcast: bool = True) -> DataFrame:
    """``left JOIN right USING (patientId)``.

    One ``patientId`` column comes out and null keys never match. Columns
    other than the key must not appear on both sides: select the profile
    columns you need first. The right side (profiles) is broadcast when its
    measured size is small (:func:`broadcast_if_small`); otherwise
    Spark sort-merge joins and AQE splits skewed partitions at run time.
    """
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides of the join: {sorted(shared)}")
    if check_broadcast and how.lower() in _BROADCAST_RIGHT:
        right = broadcast_if_small(right)
    return left.join(right, key, how)


def restrict_to_subjects(df: DataFrame, subjects: DataFrame, max_literals: int = DEFAULT_MAX_LITERAL_SUBJECTS,
                         key: str = SUBJECT_ID) -> DataFrame:
    """Rows of ``df`` whose subject appears in ``subjects`` (a left semi-join).

    When ``subjects`` holds at most ``max_literals`` rows (checked), the ids
    become an ``IN`` filter: it is pushed through the policy query into the
    Parquet scan and skips row groups by their min/max statistics (and
    buckets, on tables bucketed by the key), and no shuffle or broadcast
    happens. Otherwise a semi-join runs: the ids are broadcast if their
    measured size fits, else Spark plans it (sort-merge, AQE skew split).
    Duplicated subject rows never duplicate ``df`` rows.
    """
    ids_frame = subjects.select(quoted(key))
    rows = bounded_rows(ids_frame, max_literals)
    if rows is None:
        return df.join(broadcast_if_small(ids_frame), key, "left_semi")
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return df.filter(quoted(key).isin(ids))
