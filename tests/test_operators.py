import datetime as dt
import json
import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.operators.aggregate import (
    age_range_frame,
    average_from_partials,
    join_age_ranges,
    subject_partials,
    suppress_empty,
)
from custos.operators.filters import drop_all_null, filter_birth_range, filter_equals
from custos.operators.join import bounded_rows, join_subject, restrict_to_subjects
from custos.operators.ordering import distinct_rows, series_order, sort_series, with_position
from custos.operators.output import json_lines
from custos.operators.projection import drop_subject, rename_to_value

from conftest import BT_ROWS, BT_SCHEMA, PROFILE_ROWS, PROFILE_SCHEMA

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def bt(spark):
    return spark.createDataFrame(BT_ROWS, BT_SCHEMA)


@pytest.fixture()
def profiles(spark):
    return spark.createDataFrame(PROFILE_ROWS, PROFILE_SCHEMA)


def _key(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in row)


def test_any_not_null_drops_only_all_null_rows(bt):
    kept = drop_all_null(bt).collect()
    assert len(kept) == 5
    assert ("1", None, None) not in [tuple(r) for r in kept]
    # NaN is not null: the NaN row with a null subject stays
    assert any(r.patientId is None and math.isnan(r.fibrinogen_value) for r in kept)


def test_any_not_null_single_subject_column_keeps_all(spark):
    df = spark.createDataFrame([("1",), (None,)], "patientId string")
    assert drop_all_null(df).count() == 2


def test_any_not_null_is_case_sensitive(spark):
    df = spark.createDataFrame([("1", None)], "PatientId string, value double")
    # "PatientId" is not the subject column, so its value keeps the row
    assert drop_all_null(df).count() == 1


def test_any_not_null_excluding_date(bt):
    rows = drop_all_null(bt.select("date", "fibrinogen_value"), "date").collect()
    assert all(r.fibrinogen_value is not None for r in rows)
    assert len(rows) == 4


def test_any_not_null_is_pushed_to_parquet(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "value", "props")
    plan = drop_all_null(df, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNotNull(value),IsNotNull(props))]" in plan


def test_filter_equals_typed_literals(spark, profiles):
    assert filter_equals(profiles, "socialId", "A-1").count() == 1
    nums = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert filter_equals(nums, "id", "2").count() == 1
    # a literal that is not a number matches nothing instead of failing under ANSI
    assert filter_equals(nums, "id", "abc").count() == 0


def test_birth_range_excludes_both_ends(spark):
    rows = [(dt.date(1984, 1, 1),), (dt.date(1984, 1, 2),), (dt.date(2005, 12, 31),), (dt.date(2006, 1, 1),),
            (None,)]
    df = spark.createDataFrame(rows, "birthDate date")
    got = [r.birthDate for r in filter_birth_range(df, dt.date(1984, 1, 1), dt.date(2006, 1, 1)).collect()]
    assert sorted(got) == [dt.date(1984, 1, 2), dt.date(2005, 12, 31)]
    # ISO text birth dates compare the same way
    text = df.select(F.col("birthDate").cast("string").alias("birthDate"))
    assert filter_birth_range(text, dt.date(1984, 1, 1), dt.date(2006, 1, 1)).count() == 2


def test_join_subject_null_keys_never_match(bt, profiles):
    joined = join_subject(bt, profiles.select("patientId", "socialId"))
    assert joined.filter(F.col("patientId").isNull()).count() == 0
    assert joined.count() == 5
    with pytest.raises(ValueError):
        join_subject(bt, bt)


def test_restrict_to_subjects_literal_and_semi_join_agree(bt, profiles):
    one = profiles.filter(F.col("socialId") == "A-1")
    by_literal = sorted((_key(r) for r in restrict_to_subjects(bt, one, max_literals=10).collect()), key=str)
    by_join = sorted((_key(r) for r in restrict_to_subjects(bt, one, max_literals=0).collect()), key=str)
    assert by_literal == by_join
    assert len(by_literal) == 4


def test_restrict_to_subjects_pushes_ids_into_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ids = spark.createDataFrame([(9,), (11,)], "user_id bigint")
    plan = restrict_to_subjects(events, ids, key="user_id")._jdf.queryExecution().executedPlan().toString()
    assert "In(user_id" in plan or "EqualTo(user_id" in plan or "Or(EqualTo(user_id" in plan


def test_bounded_rows(spark):
    df = spark.range(5)
    assert bounded_rows(df, 5) is not None
    assert bounded_rows(df, 4) is None


def test_distinct_collapses_duplicate_pairs(bt):
    series = drop_subject(rename_to_value(bt, "fibrinogen_value"))
    assert series.count() == 6
    assert distinct_rows(series).count() == 5


def test_sort_puts_null_dates_first(bt):
    series = drop_all_null(distinct_rows(drop_subject(rename_to_value(bt, "fibrinogen_value"))), "date")
    rows = sort_series(series).collect()
    assert rows[0].date is None and rows[0].value == 2.0
    assert [r.date for r in rows[1:]] == sorted(r.date for r in rows[1:])


def test_with_position_is_global_and_dense(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        (F.col("id") % 97).alias("date"), (F.col("id") * 7 % 1013).cast("double").alias("value")).distinct()
    ranked = with_position(df, series_order()).collect()
    expected = sorted((r.date, r.value) for r in df.collect())
    got = sorted(ranked, key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(1, len(expected) + 1))
    assert [(r.date, r.value) for r in got] == expected


def test_json_lines_omit_null_fields(spark):
    df = spark.createDataFrame([(None, 2.0), (dt.date(2024, 1, 1), 1.5)], "date date, value double")
    got = sorted(r.json for r in json_lines(df).collect())
    assert got == ['{"date":"2024-01-01","value":1.5}', '{"value":2.0}']
    assert json.loads(got[0]) == {"date": "2024-01-01", "value": 1.5}


def test_partials_average_equals_avg(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), ("b", 10.0), ("c", None)]
    df = spark.createDataFrame(rows, "patientId string, v double")
    avg = average_from_partials(subject_partials(df, ["v"]), "v").collect()[0].value
    assert avg == pytest.approx(14.0 / 3)


def test_empty_average_leaves_zero_rows(spark):
    df = spark.createDataFrame([("a", None)], "patientId string, v double")
    out = suppress_empty(average_from_partials(subject_partials(df, ["v"]), "v"))
    assert out.count() == 0
    none = spark.createDataFrame([], "patientId string, v double")
    assert suppress_empty(average_from_partials(subject_partials(none, ["v"]), "v")).count() == 0


def test_age_ranges_match_birth_date_bounds(spark):
    """The age equi-join puts a birth date in exactly the ranges whose open
    birth-date interval contains it (brute force over random dates, leap days
    included), for several reference dates."""
    import random

    from custos.functions.dates import birth_date_bounds
    from custos.operators.aggregate import age_bounds, age_partials, count_name, range_ages, sum_name

    rnd = random.Random(7)
    births = [dt.date(1900, 1, 1) + dt.timedelta(days=rnd.randrange(0, 365 * 124)) for _ in range(400)]
    births += [dt.date(y, m, d) for y in (1984, 1999, 2000, 2004) for m, d in ((2, 28), (2, 29), (3, 1))
               if not (m == 2 and d == 29 and y % 4)]
    ranges = [(18, 40), (30, 70), (0, 1), (40, 41), (3, 10), (20, 22), (60, 120)]
    rows = [(b, 1.0, 1) for b in births]
    df = spark.createDataFrame(rows, f"birthDate date, {sum_name('v')} double, {count_name('v')} long")
    for as_of in (dt.date(2024, 1, 1), dt.date(2024, 2, 29), dt.date(2023, 2, 28), dt.date(2024, 3, 1)):
        bounds = age_bounds(as_of, ranges)
        ranged = join_age_ranges(age_partials(df, ["v"], bounds), range_ages(spark, ranges, as_of, bounds))
        got = {(r.startAge, r.endAge): r[count_name("v")] for r in
               ranged.groupBy("startAge", "endAge").agg(F.sum(count_name("v")).alias(count_name("v"))).collect()}
        for start, end in ranges:
            low, high = birth_date_bounds(as_of, start, end)
            want = sum(1 for b in births if low < b < high)
            assert got.get((start, end), 0) == want, (as_of, start, end)


def test_age_range_frame_validation(spark):
    with pytest.raises(ValueError):
        age_range_frame(spark, [])
    with pytest.raises(ValueError):
        age_range_frame(spark, [(40, 18)])
    many = [(s, s + w) for s in range(0, 120) for w in range(1, 12)]
    assert age_range_frame(spark, many).count() == len(many)
    assert age_range_frame(spark, many[:5]).count() == 5


def test_write_json_sink(spark):
    import tempfile

    from custos.operators.output import write_json

    out = tempfile.mkdtemp(prefix="custos-json-", dir="/tmp") + "/series"
    df = spark.createDataFrame([(None, 2.0), (dt.date(2024, 1, 1), 1.5)], "date date, value double")
    write_json(df, out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == ['{"date":"2024-01-01","value":1.5}', '{"value":2.0}']


def test_measured_size(spark):
    from custos.operators.join import broadcast_if_small, broadcast_threshold, measured_size

    df = spark.range(0, 1000, numPartitions=7)
    assert measured_size(df) == (1000, 1000 * 24)
    assert measured_size(spark.range(0)) == (0, 0)
    text = df.select("id", F.repeat(F.lit("é"), 500).alias("text"), F.array(F.lit("abc")).alias("list"))
    rows, size = measured_size(text)
    assert rows == 1000 and size > 1000 * (1000 + 3)
    nulls = df.select(F.lit(None).cast("string").alias("text"))
    assert measured_size(nulls) == (1000, 1000 * 24)
    assert broadcast_threshold(df) == 10 << 20
    # long strings count with their length, not with an assumed width
    long = spark.range(0, 2000).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))
    assert broadcast_if_small(long) is long
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcast_threshold(df) == 0 and broadcast_if_small(df) is df
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measuring_moves_one_row_a_task(tmp_path):
    """On a table of many splits the check shuffles a row of sums from each task, whatever the rows
    (read from the event log of a session of its own)."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from custos.session import local_session
spark = local_session(2, 8, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{tmp_path}",
                                   "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}})
from pyspark.sql import functions as F
from custos.operators.join import measured_size
path = "file://{tmp_path}/table.parquet"
spark.range(0, 200_000, numPartitions=40).select("id", F.col("id").cast("string").alias("s")).write.parquet(path)
spark.conf.set("spark.sql.files.openCostInBytes", "64m"); spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
table = spark.read.parquet(path)
spark.sparkContext.setJobDescription("measure")
assert measured_size(table)[0] == 200_000
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    log = next(p for p in tmp_path.iterdir() if p.name.startswith(("local-", "app-")))
    events = [json.loads(line) for line in log.read_text().splitlines()]
    stages = {s for e in events if e["Event"] == "SparkListenerJobStart"
              and e["Properties"].get("spark.job.description") == "measure" for s in e["Stage IDs"]}
    tasks = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages]
    written = [t["Shuffle Write Metrics"]["Shuffle Records Written"] for t in tasks]
    assert len(tasks) > 20 and max(written) <= 1 and sum(t["Input Metrics"]["Records Read"] for t in tasks) == 200_000


def test_checked_broadcast_of_join_derived_profiles(spark):
    """Profiles built by a join look huge to the planner (the product of its
    inputs); the measured check broadcasts them anyway, and only then."""
    from custos.plans import fixtures as fx
    from custos.plans.policy import run_policy

    sf = "/root/testdata/sf0.1"
    compliant = run_policy(spark, fx.catalog(sf), fx.clause_mask_envelope(("fibrinogen_value",)))
    profiles = fx.patient_profiles(spark, sf).select("patientId", "socialId", "birthDate")
    checked = join_subject(compliant, profiles)._jdf.queryExecution().executedPlan().toString()
    unchecked = join_subject(compliant, profiles, check_broadcast=False)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [patientId" in checked
    assert "SortMergeJoin [patientId" in unchecked
    from custos.operators.join import broadcast_if_small

    big = spark.range(0, 50_000).select(F.col("id").alias("patientId"))
    assert broadcast_if_small(big, max_bytes=10_000) is big  # over the bound: left to Spark
    assert broadcast_if_small(big, max_bytes=50_000 * 24) is not big


def test_any_not_null_positional_path_still_pushes_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    colliding = df.select("user_id", "value", F.col("props").alias("Value"))
    out = drop_all_null(colliding, "user_id")
    assert out.columns == ["user_id", "value", "Value"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNotNull(value),IsNotNull(props))]" in plan
