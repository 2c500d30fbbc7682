"""Running averages that follow changes of the profiles.

:mod:`custos.streaming.running` keeps sums per birth date: small, but a
patient whose birth date is corrected stays where their tests were counted.
Here the state holds a sum and count of every component per patient, and
profiles are joined when a result is asked for: a corrected birth date moves
all of the patient's values, a new profile adds them and a removed one takes
them away, as in the batch form.

Each micro-batch writes the new sums of the patients it touched; a reader
takes the newest of each patient. After ``COMPACT_AFTER`` such folders they
are folded into one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.constants import BIRTH_DATE, PROFILES, SUBJECT_ID
from custos.functions.columns import quoted
from custos.functions.components import value_columns
from custos.functions.dates import widest_bounds
from custos.operators.aggregate import subject_partials
from custos.operators.filters import filter_birth_range
from custos.operators.join import join_subject
from custos.plans.policy import run_policy
from custos.sources.catalog import TableSpec, load_table
from custos.sources.files import delete, matching
from custos.streaming.running import averages
from custos.streaming.series import ROCKSDB

#: Change folders after which a run folds them into one.
COMPACT_AFTER = 32
_BATCH = "_batch"


def running_patients(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope) -> DataFrame:
    """Streaming sums and counts of every component per patient; write it in ``update`` mode."""
    compliant = run_policy(spark, catalog, envelope)
    if not compliant.isStreaming:
        raise ValueError("blood_tests is not a stream in this catalog")
    columns = value_columns(compliant.columns)
    rows = compliant.filter(quoted(SUBJECT_ID).isNotNull())
    return subject_partials(rows.select(SUBJECT_ID, *[quoted(c) for c in columns]), columns)


def run_patients(partials: DataFrame, folder: str, checkpoint: str, compact_after: int = COMPACT_AFTER) -> None:
    """Process everything available now, then stop; a retried batch overwrites its own folder only."""
    session = partials.sparkSession
    for key, value in ROCKSDB.items():
        session.conf.set(key, value)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(_BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/{batch_id:012d}")

    query = (partials.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    compact(session, folder, compact_after)


def compact(spark: SparkSession, folder: str, after: int = COMPACT_AFTER) -> None:
    """Fold all change folders into one once there are ``after`` of them.

    The folded rows are written to the folder of the newest batch's successor
    name (``…-folded``) before the old folders go; rows read twice meanwhile
    are equal, so a reader sees the same sums at any time.
    """
    done = _complete(spark, folder)
    if len(done) < after:
        return
    newest = done[-1].rsplit("/", 1)[1].removesuffix("-folded")
    _newest(spark, done).write.mode("overwrite").parquet(f"{folder}/changes/{newest}-folded")
    for path in done:
        if not path.endswith(f"/{newest}-folded"):
            delete(spark, path)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    return [path.rsplit("/", 1)[0] for path, _ in matching(spark, f"{folder}/changes/*/_SUCCESS")]


def _newest(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    changes = spark.read.parquet(*folders)
    own = [c for c in changes.columns if c not in (SUBJECT_ID, _BATCH)]
    newest = changes.groupBy(SUBJECT_ID).agg(F.max(_BATCH).alias(_BATCH),
                                             F.max_by(F.struct(*[quoted(c) for c in own]), _BATCH).alias("_p"))
    return newest.select(SUBJECT_ID, *[F.col("_p").getField(c).alias(c) for c in own], _BATCH)


def patients_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """Each patient's newest sums and counts."""
    done = _complete(spark, folder)
    if not done:
        raise ValueError(f"no complete batch in {folder}")
    return _newest(spark, done).drop(_BATCH)


def averages_now(spark: SparkSession, catalog: Mapping[str, TableSpec], partials: DataFrame,
                 ranges: Sequence[tuple[int, int]], as_of: dt.date | None = None) -> DataFrame:
    """``(component, startAge, endAge, value)`` from per-patient sums and the profiles as they are now."""
    as_of = as_of or dt.date.today()
    low, high = widest_bounds(as_of, [(int(a), int(b)) for a, b in ranges])
    profiles = load_table(spark, catalog, PROFILES).select(SUBJECT_ID, BIRTH_DATE)
    # the partials come out of an aggregation by patient: only profiles are shuffled
    joined = join_subject(partials, filter_birth_range(profiles, low, high), check_broadcast=False)
    sums = [c for c in partials.columns if c != SUBJECT_ID]
    return averages(joined.select(BIRTH_DATE, *[quoted(c) for c in sums]), ranges, as_of)


