import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from custos.session import local_session  # noqa: E402
from custos.sources.catalog import TableSpec  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="custos-warehouse-", dir="/tmp")
    session = local_session("*", 8, app_name="custos-tests", extra={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


BT_SCHEMA = T.StructType([
    T.StructField("patientId", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("fibrinogen_value", T.DoubleType()),
])

# Hand-made blood tests: plain row, duplicate pair, all-null row, value without
# date, date without value, NaN value with a null subject.
BT_ROWS = [
    ("1", dt.date(2024, 1, 1), 1.0),
    ("1", dt.date(2024, 1, 1), 1.0),
    ("1", None, None),
    ("1", None, 2.0),
    ("2", dt.date(2024, 1, 2), None),
    (None, dt.date(2024, 1, 3), float("nan")),
]

PROFILE_SCHEMA = T.StructType([
    T.StructField("patientId", T.StringType()),
    T.StructField("socialId", T.StringType()),
    T.StructField("birthDate", T.DateType()),
])

PROFILE_ROWS = [
    ("1", "A-1", dt.date(1990, 5, 5)),
    ("2", "B-2", dt.date(1950, 1, 1)),
    ("3", "C-3", dt.date(2000, 1, 1)),
]

CLAUSE_SCHEMA = T.StructType([
    T.StructField("patientId", T.StringType()),
    T.StructField("x1", T.BooleanType()),
    T.StructField("x2", T.BooleanType()),
])


def small_catalog(clause_rows=(("1", True, True), ("2", True, True))):
    return {
        "blood_tests": TableSpec.derived(lambda s: s.createDataFrame(BT_ROWS, BT_SCHEMA)),
        "patientsProfiles": TableSpec.derived(lambda s: s.createDataFrame(PROFILE_ROWS, PROFILE_SCHEMA)),
        "blood_tests_clauses": TableSpec.derived(lambda s: s.createDataFrame(list(clause_rows), CLAUSE_SCHEMA)),
    }
