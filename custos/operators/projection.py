"""Projection and naming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from custos.constants import DATE, SUBJECT_ID, VALUE
from custos.functions.columns import quoted


def project_component(df: DataFrame, column: str, keys: tuple[str, ...] = (SUBJECT_ID, DATE)) -> DataFrame:
    """``SELECT patientId, date, <component column>``."""
    return df.select(*[quoted(c) for c in (*keys, column)])


def rename_to_value(df: DataFrame, column: str) -> DataFrame:
    """Rename the component column to ``value``; no-op if it is absent."""
    return df.withColumnRenamed(column, VALUE)


def drop_subject(df: DataFrame, column: str = SUBJECT_ID) -> DataFrame:
    """Drop the subject id."""
    return df.drop(column)
