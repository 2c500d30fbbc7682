"""Distinct, sort and global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.constants import DATE, VALUE
from custos.functions.columns import quoted
from custos.session import ensure_checkpoint_dir

_PART = "_part"
_ROW = "_row"
_COUNT = "_n"
_OFFSET = "_offset"


def distinct_rows(df: DataFrame) -> DataFrame:
    """Collapse equal rows (O21); partial aggregation removes copies map-side."""
    return df.distinct()


def series_order(date: str = DATE, value: str = VALUE) -> list[Column]:
    """Date ascending with nulls first, then value: a total order on a distinct series."""
    return [quoted(date).asc_nulls_first(), quoted(value).asc_nulls_first()]


def sort_series(df: DataFrame, date: str = DATE, value: str = VALUE) -> DataFrame:
    """Sort by date, nulls first (O22); ``value`` breaks ties so output repeats.

    A global sort range-partitions its input, so no task holds more than its
    share even when the series is huge. Range partitioning samples its input
    in a separate job that recomputes it: place the sort after a shuffle (for
    example the distinct's), so the sample reads shuffle output and the
    table is scanned once.
    """
    return df.orderBy(*series_order(date, value))


def with_position(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in ``order`` without a single-task window.

    ``row_number()`` over an unpartitioned window moves every row into one
    task. Instead the rows are range-sorted across partitions, each row gets
    its partition and its index inside it, and that numbered frame is
    checkpointed to the session's checkpoint folder so a lost executor
    cannot renumber it. A position is then the row count of all earlier
    partitions (a table with one row per partition, broadcast) plus the index.

    ``order`` must be total (no two rows equal on it, as for distinct rows
    ordered by all their columns): tied rows could otherwise be numbered
    differently if a task is recomputed before the checkpoint is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    numbered = (df.orderBy(*order)
                .withColumn(_PART, F.spark_partition_id())
                .withColumn(_ROW, F.monotonically_increasing_id()))
    numbered = numbered.checkpoint(eager=True)
    counts = numbered.groupBy(_PART).agg(F.count(F.lit(1)).alias(_COUNT))
    # One row per partition of the sort, so this window is small.
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum(_COUNT).over(earlier), F.lit(0)).alias(_OFFSET))
    # monotonically_increasing_id = partition index << 33 | index inside the partition
    local_index = F.col(_ROW) - F.shiftleft(F.col(_PART).cast("long"), 33)
    return (numbered.join(F.broadcast(offsets), _PART)
            .withColumn(name, F.col(_OFFSET) + local_index + F.lit(1))
            .drop(_PART, _ROW, _OFFSET))
