"""The driver's test tables seen through the clinical schema.

``events`` become blood tests, ``customer`` + ``nation`` become patient
profiles, and two policy clauses are derived from ``customer``. Everything
is a Spark expression over the given Parquet tables, so the work grows with
them.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.constants import BIRTH_DATE, BLOOD_TESTS, DATE, PROFILES, SOCIAL_ID, SUBJECT_ID
from custos.plans.policy import Envelope
from custos.session import ensure_checkpoint_dir
from custos.sources.catalog import TableSpec, stream_parquet
from custos.sources.layout import write_bucketed, write_by_date, write_point_lookup, write_split

# Which event type stands for which blood-test component column.
EVENT_COMPONENTS = (
    ("click", "cholesterol_total_value"),
    ("view", "cholesterol_hdl_value"),
    ("purchase", "fibrinogen_value"),
)
COMPONENT_COLUMNS = tuple(column for _, column in EVENT_COMPONENTS)

# Birth dates are 1940-01-01 + (c_custkey * 1663) % 25000 days.
BIRTH_ORIGIN = dt.date(1940, 1, 1)
BIRTH_STEP = 1663
BIRTH_SPAN = 25000

# The request parameters the tests use.
AS_OF = dt.date(2024, 1, 1)
SOCIAL_ID_EXAMPLE = "Customer#000000009"
COMPONENT_EXAMPLE = "fibrinogen"
AGE_RANGES = ((18, 40), (40, 65), (65, 90), (3, 10))

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CLAUSES_TABLE = "blood_tests_clauses"
DATE_RULES = "date_rules"
# The dates a bounded policy opens, and the day from which a component is measured.
OPEN_FROM, OPEN_UNTIL = dt.date(2024, 1, 5), dt.date(2024, 1, 12)
NEW_COMPONENT_FROM = dt.date(2024, 1, 10)


# Schemas of the test files, inferred once per process. Spark runs a job to
# read Parquet footers on every read without a schema; the files themselves
# are still listed on every read, so new data is always seen.
_schemas: dict[str, T.StructType] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    if path in _schemas:
        return spark.read.schema(_schemas[path]).parquet(path)
    df = spark.read.parquet(path)
    _schemas[path] = df.schema
    return df


def blood_tests(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """``(patientId, date, cholesterol_total_value, cholesterol_hdl_value, fibrinogen_value)``.

    With ``stream=True`` the events file is read as a stream, so the same
    blood tests arrive through Structured Streaming. SQL expressions are
    parsed in one call on the JVM side, cheaper to build than column objects.
    """
    if stream:
        schema = raw(spark, sf_dir, "events").schema
        events = stream_parquet(spark, sf_dir, {"pathGlobFilter": "events.parquet"}, schema)
    else:
        events = raw(spark, sf_dir, "events")
    values = [f"CASE WHEN event_type = '{kind}' THEN value END AS {column}" for kind, column in EVENT_COMPONENTS]
    return events.selectExpr(f"user_id AS {SUBJECT_ID}", f"CAST(ts AS DATE) AS {DATE}", *values)


def patient_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patientId, socialId, nationality, job, birthDate)``."""
    customer = raw(spark, sf_dir, "customer")
    nation = raw(spark, sf_dir, "nation")
    birth = (f"date_add(DATE '{BIRTH_ORIGIN.isoformat()}', "
             f"CAST((c_custkey * {BIRTH_STEP}) % {BIRTH_SPAN} AS INT)) AS {BIRTH_DATE}")
    return (customer.join(nation, F.expr("c_nationkey = n_nationkey"))
            .selectExpr(f"c_custkey AS {SUBJECT_ID}", f"c_name AS {SOCIAL_ID}", "n_name AS nationality",
                        "c_mktsegment AS job", birth))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patientId, x1, x2)``: x1 lets values be shown, x2 lets dates be shown."""
    return raw(spark, sf_dir, "customer").selectExpr(
        f"c_custkey AS {SUBJECT_ID}", "c_mktsegment <> 'MACHINERY' AS x1", "c_custkey % 5 <> 0 AS x2")


def catalog(sf_dir: str) -> dict[str, TableSpec]:
    """Logical names → tables: the raw Parquet files plus the clinical views."""
    paths = {name: os.path.join(sf_dir, f"{name}.parquet") for name in RAW_TABLES}
    tables = {name: TableSpec.parquet(path, schema=_schemas.get(path)) for name, path in paths.items()}
    tables[BLOOD_TESTS] = TableSpec.derived(lambda s: blood_tests(s, sf_dir))
    tables[PROFILES] = TableSpec.derived(lambda s: patient_profiles(s, sf_dir))
    tables[CLAUSES_TABLE] = TableSpec.derived(lambda s: clauses(s, sf_dir))
    return tables


def stream_catalog(sf_dir: str) -> dict[str, TableSpec]:
    """As :func:`catalog`, with the blood tests arriving as a stream."""
    tables = catalog(sf_dir)
    tables[BLOOD_TESTS] = TableSpec.derived(lambda s: blood_tests(s, sf_dir, stream=True))
    return tables


def layout_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the session's shared checkpoint folder, for a copy in another layout."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/layouts/{name}-{uuid.uuid4().hex}"


def lookup_catalog(spark: SparkSession, sf_dir: str) -> dict[str, TableSpec]:
    """As :func:`catalog`, the blood tests (in no order) copied with a Bloom filter of the patient in every row group."""
    path = layout_folder(spark, "lookup")
    tests = blood_tests(spark, sf_dir)
    write_point_lookup(tests, path, row_group_bytes=256 << 10)
    return catalog(sf_dir) | {BLOOD_TESTS: TableSpec.parquet(path, schema=tests.schema)}


def split_catalog(spark: SparkSession, sf_dir: str, buckets: int = 8, hot_share: float = 0.002) -> dict[str, TableSpec]:
    """As :func:`catalog`, tables bucketed by patient and the blood tests of frequent patients apart."""
    folder, tag = layout_folder(spark, "split"), uuid.uuid4().hex
    write_split(blood_tests(spark, sf_dir), f"tests_{tag}", buckets, hot_share=hot_share, folder=folder)
    write_bucketed(clauses(spark, sf_dir), f"clauses_{tag}", buckets, path=f"{folder}/clauses")
    write_bucketed(patient_profiles(spark, sf_dir), f"profiles_{tag}", buckets, path=f"{folder}/profiles")
    return catalog(sf_dir) | {BLOOD_TESTS: TableSpec.split(f"tests_{tag}"), CLAUSES_TABLE: TableSpec.table(f"clauses_{tag}"),
                              PROFILES: TableSpec.table(f"profiles_{tag}")}


def by_date_catalog(spark: SparkSession, sf_dir: str, new_component: str | None = None) -> dict[str, TableSpec]:
    """As :func:`catalog`, the blood tests partitioned by date, with a table of the dates a policy opens.

    With ``new_component`` that column exists in the files from
    :data:`NEW_COMPONENT_FROM` on only: they are written later, beside the others.
    """
    path, tests = layout_folder(spark, "by-date"), blood_tests(spark, sf_dir)
    if new_component is None:
        write_by_date(tests, path)
    else:
        late = F.coalesce(F.col(DATE) >= F.lit(NEW_COMPONENT_FROM), F.lit(False))
        write_by_date(tests.filter(~late).drop(new_component), path)
        write_by_date(tests.filter(late), path, mode="append")
    rules = TableSpec.derived(lambda s: raw(s, sf_dir, "events").selectExpr(
        f"CAST(ts AS DATE) AS {DATE}").distinct().selectExpr(DATE, f"day({DATE}) % 3 = 0 AS open"))
    return catalog(sf_dir) | {BLOOD_TESTS: TableSpec.parquet(path, mergeSchema="true"), DATE_RULES: rules}


def uncorrected_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles before a correction: every third patient was recorded 9000 days later."""
    wrong = f"CASE WHEN {SUBJECT_ID} % 3 = 0 THEN date_add({BIRTH_DATE}, 9000) ELSE {BIRTH_DATE} END AS {BIRTH_DATE}"
    return patient_profiles(spark, sf_dir).selectExpr(SUBJECT_ID, SOCIAL_ID, "nationality", "job", wrong)


# The rewritten queries below stand in for the policy service's answers.

def identity_envelope(component_column: str = "fibrinogen_value") -> Envelope:
    return Envelope((BLOOD_TESTS,), f"SELECT patientId, date, {component_column} FROM blood_tests")


def clause_mask_envelope(columns: tuple[str, ...] = ("fibrinogen_value",)) -> Envelope:
    """Values hidden unless ``x1``, dates hidden unless ``x2``."""
    values = ", ".join(f"CASE WHEN clauses.x1 THEN b.{c} END AS {c}" for c in columns)
    query = ("SELECT b.patientId, CASE WHEN clauses.x2 THEN b.date END AS date, " + values +
             " FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId")
    return Envelope((BLOOD_TESTS, CLAUSES_TABLE), query)


def consent_envelope(component_column: str = "fibrinogen_value") -> Envelope:
    """Only patients whose ``x1`` clause holds, as a correlated EXISTS."""
    query = (f"SELECT b.patientId, b.date, b.{component_column} FROM blood_tests b WHERE EXISTS "
             "(SELECT 1 FROM clauses c WHERE c.patientId = b.patientId AND c.x1)")
    return Envelope((BLOOD_TESTS, CLAUSES_TABLE), query)


def subject_only_envelope() -> Envelope:
    """Only the subject column comes back, hidden unless ``x1``."""
    query = ("SELECT CASE WHEN clauses.x1 THEN b.patientId END AS patientId "
             "FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId")
    return Envelope((BLOOD_TESTS, CLAUSES_TABLE), query)


def hidden_column_envelope(component_column: str = "fibrinogen_value") -> Envelope:
    """The component is hidden for everyone; only the masked date is left."""
    query = ("SELECT b.patientId, CASE WHEN clauses.x2 THEN b.date END AS date, "
             f"CAST(NULL AS DOUBLE) AS {component_column} "
             "FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId")
    return Envelope((BLOOD_TESTS, CLAUSES_TABLE), query)


def open_dates_envelope(component_column: str = "fibrinogen_value") -> Envelope:
    """Only tests of a span of dates."""
    return Envelope((BLOOD_TESTS,), f"SELECT patientId, date, {component_column} FROM blood_tests "
                    f"WHERE date >= DATE '{OPEN_FROM.isoformat()}' AND date < DATE '{OPEN_UNTIL.isoformat()}'")


def date_rules_envelope(component_column: str = "fibrinogen_value") -> Envelope:
    """Only tests of the dates another table opens."""
    return Envelope((BLOOD_TESTS, DATE_RULES), f"SELECT b.patientId, b.date, b.{component_column} FROM blood_tests b "
                    "JOIN date_rules r ON b.date = r.date WHERE r.open")
