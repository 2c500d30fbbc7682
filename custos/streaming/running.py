"""Running averages per component and age range over a blood-test stream.

The state holds what does not depend on the day of the run: a sum and count
of every component per birth date (bounded by the date domain). Age ranges
and the date they refer to are applied when a result is written, so a stream
restarted on another day gives that day's answer from the same state.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.constants import BIRTH_DATE, PROFILES, SUBJECT_ID, VALUE
from custos.functions.columns import quoted
from custos.functions.components import value_columns
from custos.functions.predicates import comparable
from custos.operators.aggregate import (
    AGE,
    END_AGE,
    START_AGE,
    age_bounds,
    age_partials,
    count_name,
    join_age_ranges,
    mean_of,
    range_ages,
    sum_name,
    suppress_empty,
)
from custos.operators.join import join_subject
from custos.plans.clinical import COMPONENT
from custos.plans.policy import run_policy
from custos.session import ensure_checkpoint_dir
from custos.sources.catalog import TableSpec, load_table

_SUM, _COUNT = sum_name(""), count_name("")


def running_partials(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope) -> DataFrame:
    """Streaming sums and counts of every component per birth date; write it in ``complete`` mode.

    The catalog's ``blood_tests`` must be a stream. Each micro-batch is
    policy-filtered, joined with the static profiles (Spark sizes the join in
    each batch) and folded into one row per birth date; partial aggregation
    runs before the state store, and rows are not copied per component or
    range.
    """
    compliant = run_policy(spark, catalog, envelope)
    if not compliant.isStreaming:
        raise ValueError("blood_tests is not a stream in this catalog")
    columns = value_columns(compliant.columns)
    profiles = load_table(spark, catalog, PROFILES).select(SUBJECT_ID, BIRTH_DATE)
    joined = join_subject(compliant.select(SUBJECT_ID, *[quoted(c) for c in columns]), profiles, check_broadcast=False)
    birth = comparable(quoted(BIRTH_DATE), joined.schema[BIRTH_DATE].dataType)
    keyed = joined.withColumn(BIRTH_DATE, birth).filter(quoted(BIRTH_DATE).isNotNull())
    sums = [f(quoted(c)).alias(name(c)) for c in columns for f, name in ((F.sum, sum_name), (F.count, count_name))]
    return keyed.groupBy(BIRTH_DATE).agg(*sums)


def averages(partials: DataFrame, ranges: Sequence[tuple[int, int]], as_of: dt.date | None = None) -> DataFrame:
    """``(component, startAge, endAge, value)`` on ``as_of`` (default today) from sums per birth date."""
    as_of = as_of or dt.date.today()
    ranges = [(int(start), int(end)) for start, end in ranges]
    bounds = age_bounds(as_of, ranges)
    columns = [c.removesuffix(_SUM) for c in partials.columns if c.endswith(_SUM)]
    by_age = age_partials(partials, columns, bounds)
    entries = [F.struct(F.lit(c).alias(COMPONENT), quoted(sum_name(c)).alias("_sum"),
                        quoted(count_name(c)).alias("_n")) for c in columns]
    long = by_age.select(AGE, F.inline(F.array(*entries))).filter("_n > 0")
    ranged = join_age_ranges(long, range_ages(partials.sparkSession, ranges, as_of, bounds))
    out = ranged.groupBy(COMPONENT, START_AGE, END_AGE).agg(mean_of(F.sum("_sum"), F.sum("_n")).alias(VALUE))
    return suppress_empty(out)


def stream_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    """``(output, checkpoint)`` folders for one run, inside the session's
    shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{root}/streams/{name}-{uuid.uuid4().hex}"
    return f"{run}/output", f"{run}/checkpoint"


def run_available(partials: DataFrame, output: str, checkpoint: str, ranges: Sequence[tuple[int, int]],
                  as_of: dt.date | None = None) -> None:
    """Process everything available now, then stop.

    Each micro-batch writes the sums per birth date as Parquet to a folder of
    its own; a retried batch overwrites its own folder only, so readers of
    :func:`latest` never see a half-written result. A run ends by writing the
    averages of the newest sums for its ``as_of``, also when nothing new
    arrived. Progress and state live in ``checkpoint``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/sums/batch-{batch_id:012d}")

    query = (partials.writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    spark = partials.sparkSession
    newest = _newest(spark, f"{output}/sums")
    if newest is None:
        return
    runs = _complete(spark, f"{output}/averages")
    number = int(runs[-1].rsplit("-", 1)[1]) + 1 if runs else 0
    averages(spark.read.parquet(newest), ranges, as_of).write.parquet(f"{output}/averages/run-{number:012d}")


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The averages the last complete run wrote."""
    newest = _newest(spark, f"{output}/averages")
    if newest is None:
        raise ValueError(f"no complete result in {output}")
    return spark.read.parquet(newest)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Folders in ``folder`` whose write has ended, oldest first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(str(f.getPath().getParent()) for f in found)


def _newest(spark: SparkSession, folder: str) -> str | None:
    return next(reversed(_complete(spark, folder)), None)
