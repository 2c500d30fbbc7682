"""The series of all patients (B1) kept up to date while blood tests arrive.

A row is new when its ``(socialId, date, value)`` has not been seen before.
What was seen is keyed state in a RocksDB store on the executors, kept for a
bounded time after its arrival: files that come late or again within that
time add nothing, whatever dates they hold. Rows that return after it are
written a second time and collapsed when the series is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from custos.constants import DATE, PROFILES, SOCIAL_ID, SUBJECT_ID, VALUE
from custos.functions.columns import quoted
from custos.functions.components import resolve_component
from custos.operators.join import join_subject
from custos.operators.ordering import distinct_rows
from custos.plans.policy import run_policy
from custos.sources.catalog import TableSpec, load_table

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SEEN = "_seen"
DEFAULT_KEEP = "30 days"


def running_series(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope, component: str,
                   keep: str = DEFAULT_KEEP) -> DataFrame:
    """Streaming ``(socialId, date, value)``, each once within ``keep`` of its arrival.

    The catalog's ``blood_tests`` must be a stream. The time is that of
    arrival (the micro-batch's), not of the test: a policy may hide dates, and
    an old test may arrive at any time.
    """
    compliant = run_policy(spark, catalog, envelope)
    if not compliant.isStreaming:
        raise ValueError("blood_tests is not a stream in this catalog")
    sensitive = compliant.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    column = quoted(resolve_component(compliant.columns, component, sensitive))
    rows = compliant.filter(column.isNotNull()).select(SUBJECT_ID, DATE, column.alias(VALUE))
    profiles = load_table(spark, catalog, PROFILES).select(SUBJECT_ID, SOCIAL_ID)
    joined = join_subject(rows, profiles, check_broadcast=False)
    # one bit pattern for zero and for NaN, as a batch distinct compares them
    value = quoted(VALUE)
    if joined.schema[VALUE].dataType.typeName() in ("double", "float"):
        value = F.when(F.isnan(value), F.lit(float("nan"))).when(value == 0, F.lit(0.0)).otherwise(value)
    keyed = joined.select(SOCIAL_ID, DATE, value.alias(VALUE), F.current_timestamp().alias(_SEEN))
    return keyed.withWatermark(_SEEN, keep).dropDuplicatesWithinWatermark([SOCIAL_ID, DATE, VALUE]).drop(_SEEN)


def run_series(series: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Add everything that is available now to ``output``, then stop; the ended query tells its state's size."""
    session = series.sparkSession
    for key, value in ROCKSDB.items():
        session.conf.set(key, value)
    query = (series.writeStream.outputMode("append").format("parquet").option("path", output)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def state_rows(query: StreamingQuery) -> int:
    """Keys the state held after the last micro-batch."""
    progress = query.lastProgress
    return sum(op["numRowsTotal"] for op in progress["stateOperators"]) if progress else 0


def series_so_far(spark: SparkSession, output: str) -> DataFrame:
    """Distinct ``(socialId, date, value)`` of all completed micro-batches."""
    return distinct_rows(spark.read.parquet(output))
