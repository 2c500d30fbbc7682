"""The clinical queries (O25–O27) and their batch forms.

Every function returns a lazy DataFrame. Two things run while it is built:
the one-patient series looks up the patient's ids (one scan of the profiles,
at most a fixed number of rows to the driver), and joins that could broadcast
profiles measure them first (one aggregation over the columns used). Profiles
are joined as they are stored (only blood tests pass through the policy),
cut to the columns used.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.constants import BIRTH_DATE, DATE, PROFILES, SOCIAL_ID, SUBJECT_ID, VALUE
from custos.functions.columns import quoted
from custos.functions.components import resolve_component, value_columns
from custos.functions.dates import birth_date_bounds, widest_bounds
from custos.operators.aggregate import (
    AGE,
    END_AGE,
    START_AGE,
    age_bounds,
    age_partials,
    average_from_partials,
    count_name,
    join_age_ranges,
    mean_of,
    range_ages,
    subject_partials,
    sum_name,
    suppress_empty,
)
from custos.operators.filters import drop_all_null, filter_birth_range, filter_equals
from custos.operators.join import (
    DEFAULT_MAX_LITERAL_SUBJECTS,
    broadcast_threshold,
    join_subject,
    measured_size,
    restrict_to_subjects,
)
from custos.operators.ordering import distinct_rows, sort_series
from custos.operators.projection import drop_subject, project_component, rename_to_value
from custos.plans.parts import policy_parts
from custos.plans.policy import run_policy
from custos.sources.catalog import TableSpec, load_table

COMPONENT = "component"


def _profiles(spark: SparkSession, catalog: Mapping[str, TableSpec], columns: Sequence[str]) -> DataFrame:
    return load_table(spark, catalog, PROFILES).select(*[quoted(c) for c in (SUBJECT_ID, *columns)])


def _component(compliant: DataFrame, component: str) -> str:
    sensitive = compliant.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return resolve_component(compliant.columns, component, sensitive)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compliant_joined(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope,
                     profile_columns: Sequence[str] = (SOCIAL_ID, BIRTH_DATE)) -> DataFrame:
    """Compliant blood tests inner-joined with patient profiles."""
    return _union(join_subject(compliant, _profiles(spark, tables, profile_columns))
                  for compliant, tables in policy_parts(spark, catalog, envelope))


def component_series(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope, social_id,
                     component: str, max_literal_subjects: int = DEFAULT_MAX_LITERAL_SUBJECTS) -> DataFrame:
    """All values of one component for one patient, over time.

    Returns ``(date, value)``: distinct pairs, values non-null, sorted by
    date with nulls first (then value). The patient's ids are looked up
    first (a bounded read); they then filter the blood tests directly, so
    the join with profiles and its shuffle disappear (a semi-join is used
    when the social id has more ids than ``max_literal_subjects``).
    """
    compliant = run_policy(spark, catalog, envelope)
    column = _component(compliant, component)
    patient = filter_equals(load_table(spark, catalog, PROFILES), SOCIAL_ID, social_id)
    rows = restrict_to_subjects(project_component(compliant, column), patient, max_literal_subjects)
    rows = drop_all_null(rows, SUBJECT_ID)
    series = drop_subject(rename_to_value(rows, column))
    series = drop_all_null(series, DATE)
    # distinct first: its shuffle is what the sort's sampling job then reads
    return sort_series(distinct_rows(series))


def _average_partials(compliant: DataFrame, column: str) -> DataFrame:
    return subject_partials(compliant.filter(quoted(column).isNotNull()), [column])


def component_average(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope, component: str,
                      start_age: int, end_age: int, as_of: dt.date | None = None) -> DataFrame:
    """Average of one component over patients aged ``start_age``..``end_age``.

    Weighted per measurement, both birth-date ends excluded; one row
    ``(value)``, or zero rows when no value falls in the range. ``as_of``
    (default today) fixes the date the ages refer to. Where the ids in the
    age range measure small enough to broadcast, the values are joined with
    them as they are read and averaged at once: nothing but each task's sum
    is shuffled. Otherwise the join runs on per-patient partials, partitioned
    by ``patientId`` already (see :func:`_age_partials`); there Spark filters
    the blood tests by a Bloom filter of the ids in range
    (:func:`custos.session.runtime_filter_conf`).
    """
    low, high = birth_date_bounds(as_of or dt.date.today(), start_age, end_age)
    values = []
    for compliant, tables in policy_parts(spark, catalog, envelope):
        column = _component(compliant, component)
        in_range = filter_birth_range(_profiles(spark, tables, (BIRTH_DATE,)), low, high).select(SUBJECT_ID)
        most = broadcast_threshold(in_range)
        if most and measured_size(in_range)[1] <= most:
            shown = compliant.filter(quoted(column).isNotNull()).select(SUBJECT_ID, quoted(column))
            values.append(shown.join(F.broadcast(in_range), SUBJECT_ID).select(
                quoted(column).alias(sum_name(VALUE)), F.lit(1).cast("long").alias(count_name(VALUE))))
        else:
            joined = join_subject(_average_partials(compliant, column), in_range, check_broadcast=False)
            values.append(joined.select(quoted(sum_name(column)).alias(sum_name(VALUE)),
                                        quoted(count_name(column)).alias(count_name(VALUE))))
    return suppress_empty(average_from_partials(_union(values), VALUE))


def series_all_patients(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope,
                        component: str) -> DataFrame:
    """O26 for every patient at once (B1): distinct ``(socialId, date, value)``."""
    found = []
    for compliant, tables in policy_parts(spark, catalog, envelope):
        column = _component(compliant, component)
        rows = project_component(compliant, column).filter(quoted(column).isNotNull())
        joined = join_subject(rows, _profiles(spark, tables, (SOCIAL_ID,)))
        found.append(joined.select(SOCIAL_ID, DATE, quoted(column).alias(VALUE)))
    return distinct_rows(_union(found))


def series_all_components(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope) -> DataFrame:
    """O26 for every patient and component (B2): distinct
    ``(socialId, component, date, value)``, component named by its column."""
    found = []
    for compliant, tables in policy_parts(spark, catalog, envelope):
        columns = value_columns(compliant.columns)
        joined = join_subject(compliant.select(SUBJECT_ID, DATE, *[quoted(c) for c in columns]),
                              _profiles(spark, tables, (SOCIAL_ID,)))
        long = joined.unpivot([SOCIAL_ID, DATE], columns, COMPONENT, VALUE)
        found.append(long.filter(F.col(VALUE).isNotNull()).select(SOCIAL_ID, COMPONENT, DATE, VALUE))
    return distinct_rows(_union(found))


def _age_partials(spark: SparkSession, catalog: Mapping[str, TableSpec], partials: DataFrame,
                  columns: Sequence[str], as_of: dt.date, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Per-patient partials → partials per place among the ranges' bounds on ``as_of``.

    Profiles born outside every range are dropped first: no birth date
    outside the widest bounds of all ranges can fall in any of them, and the
    filter reaches the profile scan (or the database query). The partials
    come out of an aggregation by ``patientId`` and are already
    hash-partitioned by it, so a sort-merge join shuffles only the profile
    side, the same rows a broadcast would ship: no size check is needed, and
    Spark still broadcasts profiles it can size as small. The result has a
    row for each bound and each gap between bounds at most.
    """
    low, high = widest_bounds(as_of, ranges)
    profiles = filter_birth_range(_profiles(spark, catalog, (BIRTH_DATE,)), low, high)
    with_birth = join_subject(partials, profiles, check_broadcast=False)
    return age_partials(with_birth, columns, age_bounds(as_of, ranges))


def average_by_age_ranges(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope, component: str,
                          ranges: Sequence[tuple[int, int]], as_of: dt.date | None = None) -> DataFrame:
    """O27 for a list of age ranges in one job (B3): ``(startAge, endAge, value)``.

    Ranges may overlap and there may be any number of them; a range without
    values is absent, as O27 gives no row for it. Ranges meet the data in an
    equi-join on the places of birth dates among their bounds (see :mod:`custos.operators.aggregate`).
    """
    ranges = [(int(start), int(end)) for start, end in ranges]
    as_of = as_of or dt.date.today()
    places = range_ages(spark, ranges, as_of, age_bounds(as_of, ranges))
    parts = policy_parts(spark, catalog, envelope)
    column = _component(parts[0][0], component)
    by_age = _union(_age_partials(spark, tables, _average_partials(compliant, column), [column], as_of, ranges)
                    for compliant, tables in parts)
    ranged = join_age_ranges(by_age, places)
    return suppress_empty(average_from_partials(ranged, column, (START_AGE, END_AGE)))


def average_by_components_and_ranges(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope,
                                     ranges: Sequence[tuple[int, int]],
                                     as_of: dt.date | None = None) -> DataFrame:
    """O27 for every component and age range (B4): ``(component, startAge, endAge, value)``.

    All components are reduced in the same pass over the blood tests (one
    sum and count per component and patient); the long form is made only
    from the per-age table.
    """
    ranges = [(int(start), int(end)) for start, end in ranges]
    as_of = as_of or dt.date.today()
    places = range_ages(spark, ranges, as_of, age_bounds(as_of, ranges))
    parts = policy_parts(spark, catalog, envelope)
    columns = value_columns(parts[0][0].columns)
    by_age = _union(_age_partials(spark, tables, subject_partials(compliant, columns), columns, as_of, ranges)
                    for compliant, tables in parts)
    entries = [F.struct(F.lit(c).alias(COMPONENT), F.col(sum_name(c)).alias("_sum"),
                        F.col(count_name(c)).alias("_n")) for c in columns]
    long = by_age.select(AGE, F.inline(F.array(*entries))).filter(F.col("_n") > 0)
    ranged = join_age_ranges(long, places)  # one row a place and component
    out = ranged.groupBy(COMPONENT, START_AGE, END_AGE).agg(
        mean_of(F.sum("_sum"), F.sum("_n")).alias(VALUE))
    return suppress_empty(out)
