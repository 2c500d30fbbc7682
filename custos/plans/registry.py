"""Named queries over the driver's test tables, each with DuckDB oracle SQL.

Every query reads whole tables at the given scale directory. Averages are
rounded to 6 digits on both sides, because the sum-of-partials form may
differ from a one-pass average in the last digit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.constants import BIRTH_DATE, BLOOD_TESTS, DATE, PROFILES, SOCIAL_ID, SUBJECT_ID, VALUE
from custos.functions.columns import quoted
from custos.functions.components import resolve_component
from custos.functions.dates import birth_date_bounds, birth_date_bounds_col
from custos.operators.filters import drop_all_null, filter_birth_range, filter_equals
from custos.operators.join import join_subject
from custos.operators.ordering import distinct_rows, series_order, with_position
from custos.operators.output import json_array_elements, json_array_parts, json_lines, write_json_array
from custos.operators.projection import project_component
from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.plans.policy import policy_session, run_policy
from custos.sources.catalog import TableSpec, load_table
from custos.streaming.patients import averages_now, patients_so_far, run_patients, running_patients
from custos.streaming.running import latest, run_available, running_partials, stream_folder
from custos.streaming.series import run_series, running_series, series_so_far

Query = Callable[[SparkSession, str], DataFrame]

FIBRINOGEN = fx.COMPONENT_EXAMPLE
FIB_COL = "fibrinogen_value"
BOUNDS_AS_OF = dt.date(2024, 2, 29)


def _mask():
    return fx.clause_mask_envelope((FIB_COL,))


def _mask_all():
    return fx.clause_mask_envelope(fx.COMPONENT_COLUMNS)


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return clinical.compliant_joined(spark, fx.catalog(sf), _mask())


def _round(df: DataFrame, column: str = VALUE) -> DataFrame:
    return df.withColumn(column, F.round(F.col(column), 6))


def scan_parquet(spark, sf):
    return load_table(spark, fx.catalog(sf), "events").select("event_id", "ts", "user_id", "event_type", "value")


def register_clauses_alias(spark, sf):
    session = policy_session(spark, fx.catalog(sf), [fx.CLAUSES_TABLE])
    return session.sql("SELECT patientId, x1, x2 FROM clauses")


def policy_identity(spark, sf):
    return run_policy(spark, fx.catalog(sf), fx.identity_envelope(FIB_COL))


def policy_clause_mask(spark, sf):
    return run_policy(spark, fx.catalog(sf), _mask())


def policy_consent_semi(spark, sf):
    return run_policy(spark, fx.catalog(sf), fx.consent_envelope(FIB_COL))


def policy_column_hidden(spark, sf):
    return run_policy(spark, fx.catalog(sf), fx.hidden_column_envelope(FIB_COL))


def any_not_null_subject(spark, sf):
    bt = load_table(spark, fx.catalog(sf), BLOOD_TESTS)
    return drop_all_null(bt.select(SUBJECT_ID, "cholesterol_total_value", FIB_COL))


def any_not_null_only_subject(spark, sf):
    """A policy answer with the subject column only: every row stays, null ids too."""
    return run_policy(spark, fx.catalog(sf), fx.subject_only_envelope())


def any_not_null_date(spark, sf):
    compliant = run_policy(spark, fx.catalog(sf), _mask())
    return drop_all_null(compliant.select(DATE, FIB_COL), DATE)


def filter_social_id(spark, sf):
    return filter_equals(_joined(spark, sf), SOCIAL_ID, fx.SOCIAL_ID_EXAMPLE).select(SUBJECT_ID, DATE, FIB_COL)


def filter_birth_range_q(spark, sf):
    low, high = birth_date_bounds(fx.AS_OF, 18, 40)
    profiles = load_table(spark, fx.catalog(sf), PROFILES)
    return filter_birth_range(profiles, low, high).select(SUBJECT_ID, BIRTH_DATE)


def component_column_q(spark, sf):
    bt = load_table(spark, fx.catalog(sf), BLOOD_TESTS)
    names = ("cholesterol", "cholesterol.hdl", FIBRINOGEN)
    counts = bt.agg(*[F.count(quoted(resolve_component(bt.columns, n))).alias(f"n{i}")
                      for i, n in enumerate(names)])
    entries = [F.struct(F.lit(n).alias("component"), F.col(f"n{i}").alias("n")) for i, n in enumerate(names)]
    return counts.select(F.inline(F.array(*entries)))


def project_component_q(spark, sf):
    return project_component(_joined(spark, sf), FIB_COL)


def join_profiles(spark, sf):
    cat = fx.catalog(sf)
    bt = load_table(spark, cat, BLOOD_TESTS).select(SUBJECT_ID, DATE, FIB_COL)
    profiles = load_table(spark, cat, PROFILES).select(SUBJECT_ID, SOCIAL_ID, BIRTH_DATE)
    return join_subject(bt, profiles)


def compliant_joined_q(spark, sf):
    return _joined(spark, sf).select(SUBJECT_ID, DATE, FIB_COL, SOCIAL_ID, BIRTH_DATE)


def series_one_patient(spark, sf):
    return clinical.component_series(spark, fx.catalog(sf), _mask(), fx.SOCIAL_ID_EXAMPLE, FIBRINOGEN)


def series_distinct(spark, sf):
    pairs = _joined(spark, sf).select(DATE, F.col(FIB_COL).alias(VALUE))
    return distinct_rows(pairs.unionAll(pairs))


def series_sorted_rank(spark, sf):
    ranked = with_position(series_one_patient(spark, sf), series_order(), "pos")
    return ranked.select(F.col("pos").cast("long").alias("pos"), DATE, VALUE)


def avg_age_range(spark, sf):
    return _round(clinical.component_average(spark, fx.catalog(sf), _mask(), FIBRINOGEN, 18, 40, fx.AS_OF))


def avg_age_range_empty(spark, sf):
    avg = clinical.component_average(spark, fx.catalog(sf), _mask(), FIBRINOGEN, 3, 10, fx.AS_OF)
    return avg.agg(F.count(F.lit(1)).alias("n"))


def avg_json(spark, sf):
    avg = _round(clinical.component_average(spark, fx.catalog(sf), _mask(), FIBRINOGEN, 18, 40, fx.AS_OF))
    return json_lines(avg)


def series_all_patients(spark, sf):
    return clinical.series_all_patients(spark, fx.catalog(sf), _mask(), FIBRINOGEN)


def series_all_components(spark, sf):
    return clinical.series_all_components(spark, fx.catalog(sf), _mask_all())


def avg_age_ranges(spark, sf):
    return _round(clinical.average_by_age_ranges(spark, fx.catalog(sf), _mask(), FIBRINOGEN,
                                                 fx.AGE_RANGES, fx.AS_OF))


def avg_components_ranges(spark, sf):
    return _round(clinical.average_by_components_and_ranges(spark, fx.catalog(sf), _mask_all(),
                                                            fx.AGE_RANGES, fx.AS_OF))


def stream_avg_components_ranges(spark, sf):
    """B4 maintained over the blood tests arriving as a stream; equals the batch form."""
    stream = running_partials(spark, fx.stream_catalog(sf), _mask_all())
    output, checkpoint = stream_folder(spark, "avg_components_ranges")
    run_available(stream, output, checkpoint, fx.AGE_RANGES, fx.AS_OF)
    return _round(latest(spark, output))


def age_bounds(spark, sf):
    """O12 in column form, one age range per patient (from the customer's nation
    key), on a leap day so the 29 February clamping is exercised."""
    customer = load_table(spark, fx.catalog(sf), "customer")
    start = F.col("c_nationkey")
    end = F.col("c_nationkey") + 20
    low, high = birth_date_bounds_col(F.lit(BOUNDS_AS_OF), start, end)
    return customer.select(F.col("c_custkey").alias(SUBJECT_ID), start.alias("startAge"), end.alias("endAge"),
                           low.alias("minBirthDate"), high.alias("maxBirthDate"))


def series_json(spark, sf):
    return json_lines(series_all_patients(spark, sf).select(DATE, VALUE))


def series_json_array_one(spark, sf):
    """O24 for the one-patient series: the JSON array, in parts."""
    return json_array_parts(series_one_patient(spark, sf), series_order())


def series_json_array(spark, sf):
    """One JSON array per patient, in parts."""
    return json_array_parts(series_all_patients(spark, sf), series_order(), keys=(SOCIAL_ID,))


def series_one_patient_lookup(spark, sf):
    """O26 over a copy of the blood tests with a Bloom filter of the patient in every row group."""
    return clinical.component_series(spark, fx.lookup_catalog(spark, sf), _mask(), fx.SOCIAL_ID_EXAMPLE, FIBRINOGEN)


def compliant_joined_split(spark, sf):
    """O25 over bucketed tables whose frequent patients are kept apart."""
    joined = clinical.compliant_joined(spark, fx.split_catalog(spark, sf), _mask())
    return joined.select(SUBJECT_ID, DATE, FIB_COL, SOCIAL_ID, BIRTH_DATE)


def avg_components_ranges_split(spark, sf):
    """B4 over bucketed tables whose frequent patients are kept apart."""
    return _round(clinical.average_by_components_and_ranges(spark, fx.split_catalog(spark, sf), _mask_all(),
                                                            fx.AGE_RANGES, fx.AS_OF))


def policy_open_dates(spark, sf):
    """A policy that bounds the date, over blood tests partitioned by it."""
    return run_policy(spark, fx.by_date_catalog(spark, sf), fx.open_dates_envelope(FIB_COL))


def policy_date_rules(spark, sf):
    """A policy whose open dates stand in a table: partitions are pruned by what it holds."""
    return run_policy(spark, fx.by_date_catalog(spark, sf), fx.date_rules_envelope(FIB_COL))


def policy_new_component(spark, sf):
    """A component measured from some day on: its column exists in later files only."""
    return run_policy(spark, fx.by_date_catalog(spark, sf, new_component=FIB_COL), fx.identity_envelope(FIB_COL))


def series_array_files(spark, sf):
    """O24 as one array in ordered files: the elements of all series, read back by the manifest."""
    folder = fx.layout_folder(spark, "array")
    order = [F.col(SOCIAL_ID).asc_nulls_first(), *series_order()]
    write_json_array(series_all_patients(spark, sf), order, folder)
    return json_array_elements(spark, folder)


def stream_series_all_patients(spark, sf):
    """B1 maintained over arriving blood tests, all of which arrive twice."""
    tables = fx.stream_catalog(sf)
    tables[BLOOD_TESTS] = TableSpec.derived(
        lambda s: fx.blood_tests(s, sf, stream=True).unionAll(fx.blood_tests(s, sf, stream=True)))
    output, checkpoint = stream_folder(spark, "series_all_patients")
    run_series(running_series(spark, tables, _mask(), FIBRINOGEN), output, checkpoint)
    return series_so_far(spark, output)


def stream_avg_corrected_births(spark, sf):
    """B4 from a stream that ran while birth dates were wrong, asked for after their correction."""
    before = fx.stream_catalog(sf) | {PROFILES: TableSpec.derived(lambda s: fx.uncorrected_profiles(s, sf))}
    folder, checkpoint = stream_folder(spark, "patients")
    run_patients(running_patients(spark, before, _mask_all()), folder, checkpoint)
    return _round(averages_now(spark, fx.catalog(sf), patients_so_far(spark, folder), fx.AGE_RANGES, fx.AS_OF))


QUERIES: dict[str, Query] = {
    "scan_parquet": scan_parquet,
    "register_clauses_alias": register_clauses_alias,
    "policy_identity": policy_identity,
    "policy_clause_mask": policy_clause_mask,
    "policy_consent_semi": policy_consent_semi,
    "policy_column_hidden": policy_column_hidden,
    "any_not_null_subject": any_not_null_subject,
    "any_not_null_only_subject": any_not_null_only_subject,
    "any_not_null_date": any_not_null_date,
    "filter_social_id": filter_social_id,
    "filter_birth_range": filter_birth_range_q,
    "component_column": component_column_q,
    "project_component": project_component_q,
    "join_profiles": join_profiles,
    "compliant_joined": compliant_joined_q,
    "series_one_patient": series_one_patient,
    "series_distinct": series_distinct,
    "series_sorted_rank": series_sorted_rank,
    "avg_age_range": avg_age_range,
    "avg_age_range_empty": avg_age_range_empty,
    "avg_json": avg_json,
    "series_all_patients": series_all_patients,
    "series_all_components": series_all_components,
    "avg_age_ranges": avg_age_ranges,
    "avg_components_ranges": avg_components_ranges,
    "stream_avg_components_ranges": stream_avg_components_ranges,
    "age_bounds": age_bounds,
    "series_json": series_json,
    "series_json_array_one": series_json_array_one,
    "series_json_array": series_json_array,
    "series_one_patient_lookup": series_one_patient_lookup,
    "compliant_joined_split": compliant_joined_split,
    "avg_components_ranges_split": avg_components_ranges_split,
    "policy_open_dates": policy_open_dates,
    "policy_date_rules": policy_date_rules,
    "policy_new_component": policy_new_component,
    "series_array_files": series_array_files,
    "stream_series_all_patients": stream_series_all_patients,
    "stream_avg_corrected_births": stream_avg_corrected_births,
}

# Oracle SQL for DuckDB. The prefix maps the test tables to the clinical
# schema exactly as custos.plans.fixtures does, and applies the clause-mask
# policy; every query below is prefixed with it.
ORACLE_PREFIX = """
WITH blood_tests AS (
  SELECT user_id AS patientId, CAST(ts AS DATE) AS date,
         CASE WHEN event_type = 'click' THEN value END AS cholesterol_total_value,
         CASE WHEN event_type = 'view' THEN value END AS cholesterol_hdl_value,
         CASE WHEN event_type = 'purchase' THEN value END AS fibrinogen_value
  FROM events),
patientsProfiles AS (
  SELECT c_custkey AS patientId, c_name AS socialId, n_name AS nationality, c_mktsegment AS job,
         DATE '1940-01-01' + CAST((c_custkey * 1663) % 25000 AS INT) AS birthDate
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
clauses AS (
  SELECT c_custkey AS patientId, c_mktsegment <> 'MACHINERY' AS x1, c_custkey % 5 <> 0 AS x2 FROM customer),
rewritten AS (
  SELECT b.patientId, CASE WHEN clauses.x2 THEN b.date END AS date,
         CASE WHEN clauses.x1 THEN b.cholesterol_total_value END AS cholesterol_total_value,
         CASE WHEN clauses.x1 THEN b.cholesterol_hdl_value END AS cholesterol_hdl_value,
         CASE WHEN clauses.x1 THEN b.fibrinogen_value END AS fibrinogen_value
  FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId),
compliant AS (
  SELECT patientId, date, fibrinogen_value FROM rewritten
  WHERE date IS NOT NULL OR fibrinogen_value IS NOT NULL),
joined AS (
  SELECT c.patientId, c.date, c.fibrinogen_value, p.socialId, p.nationality, p.job, p.birthDate
  FROM compliant c JOIN patientsProfiles p ON c.patientId = p.patientId),
long_values AS (
  SELECT patientId, date, 'cholesterol_total_value' AS component, cholesterol_total_value AS value FROM rewritten
  UNION ALL SELECT patientId, date, 'cholesterol_hdl_value', cholesterol_hdl_value FROM rewritten
  UNION ALL SELECT patientId, date, 'fibrinogen_value', fibrinogen_value FROM rewritten),
long_joined AS (
  SELECT l.component, l.date, l.value, p.socialId, p.birthDate
  FROM long_values l JOIN patientsProfiles p ON l.patientId = p.patientId WHERE l.value IS NOT NULL),
ranges AS (
  SELECT 18 AS startAge, 40 AS endAge, DATE '1984-01-01' AS lo, DATE '2006-01-01' AS hi
  UNION ALL SELECT 40, 65, DATE '1959-01-01', DATE '1984-01-01'
  UNION ALL SELECT 65, 90, DATE '1934-01-01', DATE '1959-01-01'
  UNION ALL SELECT 3, 10, DATE '2014-01-01', DATE '2021-01-01')
"""

_SERIES_JSON_OBJECT = ("'{' || CASE WHEN date IS NULL THEN '' ELSE '\"date\":\"' || date || '\",' END"
                       " || '\"value\":' || value || '}'")

ORACLE_BODIES: dict[str, str] = {
    "scan_parquet": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "register_clauses_alias": "SELECT patientId, x1, x2 FROM clauses",
    "policy_identity": ("SELECT patientId, date, fibrinogen_value FROM blood_tests "
                        "WHERE date IS NOT NULL OR fibrinogen_value IS NOT NULL"),
    "policy_clause_mask": "SELECT patientId, date, fibrinogen_value FROM compliant",
    "policy_consent_semi": ("SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b WHERE EXISTS "
                            "(SELECT 1 FROM clauses c WHERE c.patientId = b.patientId AND c.x1)"),
    "policy_column_hidden": ("SELECT patientId, date, CAST(NULL AS DOUBLE) AS fibrinogen_value FROM rewritten "
                             "WHERE date IS NOT NULL"),
    "any_not_null_subject": ("SELECT patientId, cholesterol_total_value, fibrinogen_value FROM blood_tests "
                             "WHERE cholesterol_total_value IS NOT NULL OR fibrinogen_value IS NOT NULL"),
    "any_not_null_only_subject": ("SELECT CASE WHEN clauses.x1 THEN b.patientId END AS patientId "
                                  "FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId"),
    "any_not_null_date": "SELECT date, fibrinogen_value FROM compliant WHERE fibrinogen_value IS NOT NULL",
    "filter_social_id": ("SELECT patientId, date, fibrinogen_value FROM joined "
                         "WHERE socialId = 'Customer#000000009'"),
    "filter_birth_range": ("SELECT patientId, birthDate FROM patientsProfiles "
                           "WHERE birthDate > DATE '1984-01-01' AND birthDate < DATE '2006-01-01'"),
    "component_column": ("SELECT 'cholesterol' AS component, count(cholesterol_total_value) AS n FROM blood_tests "
                         "UNION ALL SELECT 'cholesterol.hdl', count(cholesterol_hdl_value) FROM blood_tests "
                         "UNION ALL SELECT 'fibrinogen', count(fibrinogen_value) FROM blood_tests"),
    "project_component": "SELECT patientId, date, fibrinogen_value FROM joined",
    "join_profiles": ("SELECT b.patientId, b.date, b.fibrinogen_value, p.socialId, p.birthDate "
                      "FROM blood_tests b JOIN patientsProfiles p ON b.patientId = p.patientId"),
    "compliant_joined": "SELECT patientId, date, fibrinogen_value, socialId, birthDate FROM joined",
    "series_one_patient": ("SELECT DISTINCT date, fibrinogen_value AS value FROM joined "
                           "WHERE socialId = 'Customer#000000009' AND fibrinogen_value IS NOT NULL"),
    "series_distinct": ("SELECT DISTINCT date, fibrinogen_value AS value FROM "
                        "(SELECT date, fibrinogen_value FROM joined UNION ALL "
                        "SELECT date, fibrinogen_value FROM joined) d"),
    "series_sorted_rank": ("SELECT row_number() OVER (ORDER BY date ASC NULLS FIRST, value ASC) AS pos, date, value "
                           "FROM (SELECT DISTINCT date, fibrinogen_value AS value FROM joined "
                           "WHERE socialId = 'Customer#000000009' AND fibrinogen_value IS NOT NULL) d"),
    "avg_age_range": ("SELECT round(avg(fibrinogen_value), 6) AS value FROM joined "
                      "WHERE birthDate > DATE '1984-01-01' AND birthDate < DATE '2006-01-01'"),
    "avg_age_range_empty": ("SELECT count(*) AS n FROM (SELECT avg(fibrinogen_value) AS value FROM joined "
                            "WHERE birthDate > DATE '2014-01-01' AND birthDate < DATE '2021-01-01') a "
                            "WHERE value IS NOT NULL"),
    "avg_json": ("SELECT '{\"value\":' || value || '}' AS json FROM (SELECT round(avg(fibrinogen_value), 6) AS value "
                 "FROM joined WHERE birthDate > DATE '1984-01-01' AND birthDate < DATE '2006-01-01') a "
                 "WHERE value IS NOT NULL"),
    "series_all_patients": ("SELECT DISTINCT socialId, date, fibrinogen_value AS value FROM joined "
                            "WHERE fibrinogen_value IS NOT NULL"),
    "series_all_components": "SELECT DISTINCT socialId, component, date, value FROM long_joined",
    "avg_age_ranges": ("SELECT startAge, endAge, round(avg(fibrinogen_value), 6) AS value FROM ranges "
                       "JOIN joined ON birthDate > lo AND birthDate < hi "
                       "WHERE fibrinogen_value IS NOT NULL GROUP BY startAge, endAge"),
    "avg_components_ranges": ("SELECT component, startAge, endAge, round(avg(value), 6) AS value FROM ranges "
                              "JOIN long_joined ON birthDate > lo AND birthDate < hi "
                              "GROUP BY component, startAge, endAge"),
    "stream_avg_components_ranges": ("SELECT component, startAge, endAge, round(avg(value), 6) AS value "
                                     "FROM ranges JOIN long_joined ON birthDate > lo AND birthDate < hi "
                                     "GROUP BY component, startAge, endAge"),
    "age_bounds": ("SELECT c_custkey AS patientId, c_nationkey AS startAge, c_nationkey + 20 AS endAge, "
                   "CAST(DATE '2024-02-29' - to_years(c_nationkey + 20) AS DATE) AS minBirthDate, "
                   "CAST(DATE '2024-02-29' - to_years(c_nationkey) AS DATE) AS maxBirthDate FROM customer"),
    "series_json": (f"SELECT {_SERIES_JSON_OBJECT} AS json FROM (SELECT DISTINCT socialId, date, "
                    "fibrinogen_value AS value FROM joined WHERE fibrinogen_value IS NOT NULL) d"),
    "series_json_array_one": (
        "SELECT part, '[' || string_agg(obj, ',' ORDER BY date ASC NULLS FIRST, value ASC) || ']' AS json "
        f"FROM (SELECT date, value, {_SERIES_JSON_OBJECT} AS obj, "
        "(row_number() OVER (ORDER BY date ASC NULLS FIRST, value ASC) - 1) // 1000 AS part "
        "FROM (SELECT DISTINCT date, fibrinogen_value AS value FROM joined "
        "WHERE socialId = 'Customer#000000009' AND fibrinogen_value IS NOT NULL) d) e GROUP BY part"),
    "series_json_array": (
        "SELECT socialId, part, '[' || string_agg(obj, ',' ORDER BY date ASC NULLS FIRST, value ASC) || ']' AS json "
        f"FROM (SELECT socialId, date, value, {_SERIES_JSON_OBJECT} AS obj, "
        "(row_number() OVER (PARTITION BY socialId ORDER BY date ASC NULLS FIRST, value ASC) - 1) // 1000 AS part "
        "FROM (SELECT DISTINCT socialId, date, fibrinogen_value AS value FROM joined "
        "WHERE fibrinogen_value IS NOT NULL) d) e GROUP BY socialId, part"),
    "policy_open_dates": ("SELECT patientId, date, fibrinogen_value FROM blood_tests "
                          "WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-12'"),
    "policy_date_rules": ("SELECT patientId, date, fibrinogen_value FROM blood_tests "
                          "WHERE day(date) % 3 = 0"),
    "policy_new_component": ("SELECT patientId, date, CASE WHEN date >= DATE '2024-01-10' THEN fibrinogen_value END "
                             "AS fibrinogen_value FROM blood_tests WHERE date IS NOT NULL"),
    "series_array_files": (
        "SELECT '{\"socialId\":\"' || socialId || '\",' || substr(obj, 2) AS json FROM ("
        f"SELECT socialId, {_SERIES_JSON_OBJECT} AS obj FROM (SELECT DISTINCT socialId, date, "
        "fibrinogen_value AS value FROM joined WHERE fibrinogen_value IS NOT NULL) d) e"),
}
# The same rows by other layouts and by streams.
ORACLE_BODIES |= {key: ORACLE_BODIES[same] for key, same in {
    "series_one_patient_lookup": "series_one_patient", "compliant_joined_split": "compliant_joined",
    "avg_components_ranges_split": "avg_components_ranges", "stream_series_all_patients": "series_all_patients",
    "stream_avg_corrected_births": "avg_components_ranges"}.items()}


def oracle_sql() -> dict[str, str]:
    return {key: ORACLE_PREFIX + body for key, body in ORACLE_BODIES.items()}
