"""Rows → JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custos.functions.columns import quoted


def row_json(*columns: str) -> Column:
    """One JSON object per row; null fields are left out, dates are ISO text."""
    return F.to_json(F.struct(*[quoted(c) for c in columns]))
