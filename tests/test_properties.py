"""Property tests against brute-force Python on small random inputs."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.functions.dates import birth_date_bounds, birth_date_bounds_col, years_before
from custos.operators.filters import drop_all_null

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=False, width=32))
# Names may repeat or differ only by case, as in a policy answer that
# selects * over a join.
names = st.lists(st.sampled_from(["patientId", "date", "a", "b", "PatientId"]), min_size=1, max_size=4)


@SLOW
@given(cols=names, data=st.data())
def test_any_not_null_matches_brute_force(spark, cols, data):
    rows = data.draw(st.lists(st.tuples(*[values for _ in cols]), max_size=12))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])
    df = spark.createDataFrame(rows, schema)
    for exclude in ("patientId", "date"):
        got = sorted(map(_key, drop_all_null(df, exclude).collect()))
        if cols == [exclude]:
            want = sorted(map(_key, rows))
        else:
            want = sorted(_key(r) for r in rows if any(v is not None for c, v in zip(cols, r) if c != exclude))
        assert got == want


def _key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in row)


@given(day=st.dates(min_value=dt.date(1904, 1, 1), max_value=dt.date(2100, 12, 31)),
       years=st.integers(min_value=0, max_value=120))
def test_years_before_keeps_month_and_clamps(day, years):
    got = years_before(day, years)
    assert got.year == day.year - years and got.month == day.month
    assert got.day == day.day or (day.month, day.day, got.day) == (2, 29, 28)


@SLOW
@given(pairs=st.lists(st.tuples(st.dates(min_value=dt.date(1904, 1, 1), max_value=dt.date(2100, 12, 31)),
                                st.integers(0, 100), st.integers(1, 50)), min_size=1, max_size=20))
def test_bounds_column_form_matches_scalar_form(spark, pairs):
    df = spark.createDataFrame([(d, s, s + w) for d, s, w in pairs], "d date, s int, e int")
    low, high = birth_date_bounds_col(F.col("d"), F.col("s"), F.col("e"))
    for r in df.select("d", "s", "e", low.alias("lo"), high.alias("hi")).collect():
        assert (r.lo, r.hi) == birth_date_bounds(r.d, r.s, r.e)
