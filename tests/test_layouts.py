"""Point lookups, hot patients apart, date partitions, runtime filters and JDBC bounds."""

import datetime as dt
import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.plans.parts import policy_parts, row_by_row
from custos.plans.policy import Envelope, run_policy
from custos.session import MOST_FILTER_BITS, runtime_filter_conf
from custos.sources.catalog import HOT_KEYS, HOT_ROWS, TableSpec, bounds_query, find_bounds, with_bounds
from custos.sources.layout import write_bucketed, write_by_date, write_point_lookup, write_split

from conftest import SF001, SF01
from plan_metrics import nodes, rows_scanned, rows_shuffled

FIB = ("fibrinogen_value",)
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture()
def conf(spark):
    """Sets session settings for one test."""
    known = []

    def use(values):
        known.extend(values)
        for key, value in values.items():
            spark.conf.set(key, value)

    yield use
    for key in known:
        spark.conf.unset(key)


def same_rows(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_a_point_lookup_reads_few_rows_of_an_unsorted_table(spark, tmp_path, kind):
    path, plain = str(tmp_path / "lookup"), str(tmp_path / "plain")
    # every patient has four tests, all far apart
    tests = spark.range(0, 500_000, 1, 4).select(
        (F.col("id") * 7919 % 125_000).cast(kind).alias("patientId"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("date"),
        (F.col("id") % 97 / 7).alias("fibrinogen_value"))
    tests.write.parquet(plain)
    write_point_lookup(tests, path, row_group_bytes=32 << 10)
    env = fx.identity_envelope()
    read = {}
    for name, folder in (("lookup", path), ("plain", plain)):
        tables = {"blood_tests": TableSpec.parquet(folder), "patientsProfiles": TableSpec.derived(
            lambda s: s.range(125_000).select(F.col("id").cast(kind).alias("patientId"), F.concat(F.lit("S"), "id").alias("socialId"),
                                             F.lit(dt.date(1990, 1, 1)).alias("birthDate")))}
        series = clinical.component_series(spark, tables, env, "S4321", "fibrinogen")
        rows = series.collect()
        read[name] = (rows, rows_scanned(series))
    assert read["lookup"][0] == read["plain"][0] and len(read["lookup"][0]) == 4
    assert read["plain"][1] == 500_000 and 4 <= read["lookup"][1] < 25_000


def test_point_lookup_layout_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "lookup")
    tests = fx.blood_tests(spark, SF001).unionAll(fx.blood_tests(spark, SF001).limit(3).withColumn("patientId", F.lit(None).cast("long")))
    write_point_lookup(tests, path)
    same_rows(spark.read.parquet(path), tests)
    write_point_lookup(tests.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        write_point_lookup(tests, str(tmp_path / "bad"), row_group_bytes=0)


HOT = 9


def _hot_tests(session, sf=SF01):
    tests = fx.blood_tests(session, sf)
    hot = F.when(F.col("date") > F.lit("2024-01-20").cast("date"), F.lit(HOT)).otherwise(F.col("patientId"))
    return tests.withColumn("patientId", hot)


@pytest.fixture(scope="module")
def split(spark):
    """Bucketed tables; a third of all blood tests belong to one patient."""
    tag = uuid.uuid4().hex[:8]
    hot = write_split(_hot_tests(spark), f"tests_{tag}", 4, hot_share=0.1)
    assert hot == [HOT]
    write_bucketed(fx.clauses(spark, SF01), f"clauses_{tag}", 4)
    write_bucketed(fx.patient_profiles(spark, SF01), f"profiles_{tag}", 4)
    return {"blood_tests": TableSpec.split(f"tests_{tag}"), "blood_tests_clauses": TableSpec.table(f"clauses_{tag}"),
            "patientsProfiles": TableSpec.table(f"profiles_{tag}")}


def _plain():
    return fx.catalog(SF01) | {"blood_tests": TableSpec.derived(_hot_tests)}


def test_the_cold_part_joins_without_exchange_and_no_task_holds_the_hot_patient(spark, split, conf):
    # only what the library measures is broadcast
    conf({"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    env = fx.clause_mask_envelope(FIB)
    parts = policy_parts(spark, split, env)
    assert len(parts) == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cold, tables = policy_parts(spark, split, env)[0]
        joined = cold.join(tables and spark.table(tables["patientsProfiles"].location), "patientId")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = clinical.compliant_joined(spark, split, env)
    same_rows(joined, clinical.compliant_joined(spark, _plain(), env))
    hot, tables = parts[1]
    assert {r.patientId for r in hot.select("patientId").distinct().collect()} == {HOT}
    from custos.operators.join import join_subject
    profiles = clinical._profiles(spark, tables, ("birthDate",))
    rows = [r["n"] for r in join_subject(hot, profiles).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    cold_rows = [r["n"] for r in spark.table(split["blood_tests"].location).groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n")).collect()]
    tasks = rows + cold_rows
    assert len(rows) == 2 and max(tasks) <= 2 * sum(tasks) / len(tasks)
    assert "BroadcastHashJoin" in hot._jdf.queryExecution().executedPlan().toString()


def test_all_queries_agree_on_split_tables(spark, split):
    env, all_env, plain = fx.clause_mask_envelope(FIB), fx.clause_mask_envelope(fx.COMPONENT_COLUMNS), _plain()
    same_rows(clinical.series_all_patients(spark, split, env, "fibrinogen"), clinical.series_all_patients(spark, plain, env, "fibrinogen"))
    same_rows(clinical.series_all_components(spark, split, all_env), clinical.series_all_components(spark, plain, all_env))
    for social in ("Customer#000000009", "Customer#000000013"):
        same_rows(clinical.component_series(spark, split, env, social, "fibrinogen"),
                  clinical.component_series(spark, plain, env, social, "fibrinogen"))
    one, want = (clinical.component_average(spark, t, env, "fibrinogen", 18, 90, fx.AS_OF).first().value for t in (split, plain))
    assert one == pytest.approx(want, rel=1e-12)
    for f, e in ((lambda t: clinical.average_by_age_ranges(spark, t, env, "fibrinogen", fx.AGE_RANGES, fx.AS_OF), env),
                 (lambda t: clinical.average_by_components_and_ranges(spark, t, all_env, fx.AGE_RANGES, fx.AS_OF), all_env)):
        got, want = ({tuple(r)[:-1]: r.value for r in f(t).collect()} for t in (split, plain))
        assert got == pytest.approx(want, rel=1e-12) and got


ROW_BY_ROW = {
    "SELECT patientId, date, fibrinogen_value FROM blood_tests WHERE date > DATE '2024-01-02'": True,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b JOIN clauses c ON c.patientId = b.patientId AND c.x1": True,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b LEFT SEMI JOIN clauses c ON b.patientId = c.patientId": True,
    "SELECT DISTINCT patientId, date, fibrinogen_value FROM blood_tests": False,
    "SELECT patientId, max(date) AS date, max(fibrinogen_value) AS fibrinogen_value FROM blood_tests GROUP BY patientId": False,
    "SELECT patientId, date, max(fibrinogen_value) OVER (PARTITION BY date) AS fibrinogen_value FROM blood_tests": False,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b JOIN clauses c ON c.patientId > b.patientId": False,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM clauses c LEFT JOIN blood_tests b ON c.patientId = b.patientId": False,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b CROSS JOIN clauses": False,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b JOIN blood_tests c ON c.patientId = b.patientId": False,
    "SELECT * FROM (SELECT patientId, date, fibrinogen_value FROM blood_tests) x ORDER BY date LIMIT 3": False,
    "SELECT b.patientId, b.date, b.fibrinogen_value FROM blood_tests b WHERE EXISTS (SELECT 1 FROM clauses c WHERE c.patientId = b.patientId)": False,
    "SELECT patientId, date, fibrinogen_value FROM blood_tests UNION ALL SELECT patientId, date, fibrinogen_value FROM blood_tests": False,
}


@pytest.mark.parametrize("query", sorted(ROW_BY_ROW))
def test_only_row_by_row_queries_are_worked_on_in_parts(spark, split, query):
    env = Envelope(("blood_tests", "blood_tests_clauses"), query)
    assert row_by_row(run_policy(spark, split, env)) == ROW_BY_ROW[query]
    assert len(policy_parts(spark, split, env)) == 1 + ROW_BY_ROW[query]
    if "SEMI" in query or "OVER" in query:
        same_rows(clinical.compliant_joined(spark, split, env), clinical.compliant_joined(spark, _plain(), env))


def test_split_tables_hold_every_row(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    rows = [(None, i) for i in range(40)] + [(1, i) for i in range(50)] + [(i, i) for i in range(2, 40)]
    df = spark.createDataFrame(rows, "patientId long, v int")
    assert write_split(df, f"odd_{tag}", 3, hot_share=0.2, folder=str(tmp_path)) == [1]
    same_rows(spark.table(f"odd_{tag}").unionByName(spark.table(f"odd_{tag}{HOT_ROWS}")), df)
    assert [r[0] for r in spark.table(f"odd_{tag}{HOT_KEYS}").collect()] == [1]
    assert os.listdir(tmp_path)
    # nothing is hot, and nothing is there
    for name, part in ((f"even_{tag}", df.filter("patientId > 1")), (f"none_{tag}", df.limit(0))):
        assert write_split(part, name, 2, hot_share=0.2) == []
        same_rows(spark.table(name).unionByName(spark.table(name + HOT_ROWS)), part)
    with pytest.raises(ValueError):
        write_split(df, "never", 2, hot_share=0)


def test_ids_out_of_range_are_filtered_while_blood_tests_are_read(spark, tmp_path, conf):
    conf(NO_BROADCAST)
    fx.blood_tests(spark, SF01).write.parquet(str(tmp_path / "tests"))
    fx.patient_profiles(spark, SF01).write.parquet(str(tmp_path / "profiles"))
    tables = {"blood_tests": TableSpec.parquet(str(tmp_path / "tests")), "patientsProfiles": TableSpec.parquet(str(tmp_path / "profiles")),
              "blood_tests_clauses": fx.catalog(SF01)["blood_tests_clauses"]}
    for env in (fx.identity_envelope(), fx.clause_mask_envelope(FIB)):
        shuffled, values = [], []
        for filtered in (False, True):
            conf(runtime_filter_conf(10_000, 1 << 30, 0) if filtered else {"spark.sql.optimizer.runtime.bloomFilter.enabled": "false"})
            avg = clinical.component_average(spark, tables, env, "fibrinogen", 40, 48, fx.AS_OF)
            values.append(avg.first().value)
            rows = avg.collect()
            shuffled.append(rows_shuffled(avg))
            plan = avg._jdf.queryExecution().executedPlan().toString()
            assert ("might_contain" in plan) == filtered and "BroadcastHashJoin" not in plan and rows[0].value == values[-1]
        assert values[0] == pytest.approx(values[1], rel=1e-12)
        assert shuffled[1] < 0.7 * shuffled[0]


def test_the_runtime_filter_is_bounded():
    for ids in (0, 1, 10**6, 10**12):
        conf = runtime_filter_conf(ids, 1 << 50)
        prefix = "spark.sql.optimizer.runtime.bloomFilter."
        assert 0 < int(conf[prefix + "numBits"]) <= int(conf[prefix + "maxNumBits"]) <= MOST_FILTER_BITS
        assert 0 < int(conf[prefix + "expectedNumItems"]) <= int(conf[prefix + "maxNumItems"])


def _scans(df):
    df.collect()
    return [node.toString() for kind, node in nodes(df) if kind == "FileSourceScanExec"]


def test_date_bounds_and_date_tables_prune_partitions(spark):
    tables = fx.by_date_catalog(spark, SF01)
    plain = fx.catalog(SF01) | {"date_rules": tables["date_rules"]}
    total = spark.read.parquet(tables["blood_tests"].location).count()
    for env, marker in ((fx.open_dates_envelope(), "PartitionFilters: [isnotnull(date"), (fx.date_rules_envelope(), "dynamicpruningexpression(date")):
        answer = run_policy(spark, tables, env)
        scans = _scans(answer)
        assert any(marker in s for s in scans), scans
        same_rows(answer, run_policy(spark, plain, env))
        by_date = [n for k, n in nodes(answer) if k == "FileSourceScanExec" and "date" in str(n.relation().location().partitionSchema())]
        assert by_date and all(n.metrics().apply("numOutputRows").value() < total / 2 for n in by_date)


def test_a_component_that_appears_later(spark):
    tables = fx.by_date_catalog(spark, SF01, new_component="fibrinogen_value")
    folder = tables["blood_tests"].location.removeprefix("file:")
    first = sorted(glob.glob(f"{folder}/date=2024-01-0?/*.parquet"))[0]
    assert "fibrinogen_value" not in spark.read.parquet(first).columns
    series = clinical.series_all_patients(spark, tables, fx.identity_envelope(), "fibrinogen")
    want = clinical.series_all_patients(spark, fx.catalog(SF01), fx.identity_envelope(), "fibrinogen")
    same_rows(series, want.filter(F.col("date") >= F.lit(fx.NEW_COMPONENT_FROM)))
    assert series.count() > 0


def test_null_dates_and_crowded_dates(spark, tmp_path, conf):
    conf({"spark.sql.adaptive.coalescePartitions.enabled": "false"})
    tests = fx.blood_tests(spark, SF001)
    tests = tests.withColumn("date", F.when(F.col("patientId") % 2 == 0, F.col("date")))
    write_by_date(tests, str(tmp_path / "t"), files_per_date=3)
    same_rows(spark.read.parquet(str(tmp_path / "t")), tests)
    assert len(glob.glob(str(tmp_path / "t" / "date=__HIVE_DEFAULT_PARTITION__" / "*.parquet"))) > 1
    with pytest.raises(ValueError):
        write_by_date(tests, str(tmp_path / "u"), files_per_date=0)


def test_jdbc_bounds(monkeypatch):
    spec = TableSpec.jdbc("db.patient", "jdbc:mysql://h/db", user="u", password="p", fetchsize="7")
    assert bounds_query(spec, "patientId") == "(SELECT MIN(patientId) AS lo, MAX(patientId) AS hi FROM db.patient) custos_bounds"
    for bad in ("a b", "x;drop", "1a", ""):
        with pytest.raises(ValueError):
            bounds_query(spec, bad)
    split = with_bounds(spec, "patientId", 5, 99, 8)
    assert split.options == {**spec.options, "partitionColumn": "patientId", "lowerBound": "5", "upperBound": "100", "numPartitions": "8"}
    dates = with_bounds(spec, "day", dt.date(2024, 1, 1), dt.date(2024, 1, 31), 4)
    assert (dates.options["lowerBound"], dates.options["upperBound"]) == ("2024-01-01", "2024-02-01")
    assert with_bounds(spec, "patientId", None, None, 8) is spec
    with pytest.raises(ValueError):
        with_bounds(spec, "patientId", 1, 2, 0)

    class Reader:
        def format(self, kind):
            assert kind == "jdbc"
            return self

        def options(self, **options):
            self.asked = options
            return self

        def load(self):
            return self

        def first(self):
            return (3, 12)

    class Session:
        read = Reader()

    found = find_bounds(Session, split, "patientId", 2)
    assert Session.read.asked["dbtable"] == bounds_query(spec, "patientId") and "partitionColumn" not in Session.read.asked
    assert Session.read.asked["user"] == "u" and found.options["lowerBound"] == "3" and found.options["upperBound"] == "13"
