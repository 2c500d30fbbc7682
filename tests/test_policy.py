import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from custos.plans import clinical
from custos.plans.policy import Envelope, base_query, policy_session, run_policy

from conftest import small_catalog

MASK = ("SELECT b.patientId, CASE WHEN clauses.x2 THEN b.date END AS date, "
        "CASE WHEN clauses.x1 THEN b.fibrinogen_value END AS fibrinogen_value "
        "FROM blood_tests b LEFT JOIN clauses ON b.patientId = clauses.patientId")


def envelope(query=MASK, tables=("blood_tests", "blood_tests_clauses")):
    return json.dumps({"tables": [{"name": t} for t in tables], "rewrittenQuery": query})


def test_envelope_parse_and_errors():
    env = Envelope.parse(envelope())
    assert env.tables == ("blood_tests", "blood_tests_clauses")
    assert Envelope.parse(env.to_json()) == env
    with pytest.raises(ValueError):
        Envelope.parse({"tables": []})
    with pytest.raises(ValueError):
        Envelope.parse({"tables": [], "rewrittenQuery": " "})


def test_base_query():
    assert base_query("fibrinogen") == "SELECT patientId, date, fibrinogen_value FROM blood_tests"
    assert base_query("cholesterol") == "SELECT patientId, date, cholesterol_total_value FROM blood_tests"


def test_identity_policy_drops_all_null_rows(spark):
    env = envelope(base_query("fibrinogen"), ("blood_tests",))
    assert run_policy(spark, small_catalog(), env).count() == 5


def test_clause_mask_hides_cells(spark):
    cat = small_catalog((("1", False, True), ("2", True, False)))
    rows = run_policy(spark, cat, envelope()).collect()
    # patient 1: values hidden, dates kept -> rows with a null date fall out;
    # patient 2: date hidden and value null -> nothing left; no clause row -> all hidden
    assert sorted((r.patientId, r.date, r.fibrinogen_value) for r in rows) == [
        ("1", dt.date(2024, 1, 1), None), ("1", dt.date(2024, 1, 1), None)]


def test_child_session_holds_only_listed_tables(spark):
    child = policy_session(spark, small_catalog(), ["blood_tests"])
    assert child.catalog.tableExists("blood_tests")
    assert not child.catalog.tableExists("clauses")
    assert not spark.catalog.tableExists("blood_tests")


def test_child_session_copies_runtime_settings(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        child = policy_session(spark, small_catalog(), ["blood_tests"])
        assert child.conf.get("spark.sql.session.timeZone") == "America/Chicago"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_interleaved_envelopes_are_isolated(spark):
    """Two requests with different clauses tables, built and run interleaved,
    give the same results as one at a time."""
    open_cat = small_catalog((("1", True, True), ("2", True, True)))
    closed_cat = small_catalog((("1", False, False), ("2", False, False)))
    alone_open = sorted(map(tuple, run_policy(spark, open_cat, envelope()).collect()), key=str)
    alone_closed = run_policy(spark, closed_cat, envelope()).collect()
    a = run_policy(spark, open_cat, envelope())
    b = run_policy(spark, closed_cat, envelope())
    assert run_policy(spark, closed_cat, envelope()).count() == 0
    assert sorted(map(tuple, a.collect()), key=str) == alone_open
    assert b.collect() == alone_closed == []


def test_series_and_average_on_hand_made_rows(spark):
    cat = small_catalog()
    env = envelope()
    series = clinical.component_series(spark, cat, env, "A-1", "fibrinogen").collect()
    assert [(r.date, r.value) for r in series] == [(None, 2.0), (dt.date(2024, 1, 1), 1.0)]
    assert clinical.component_series(spark, cat, env, "nobody", "fibrinogen").count() == 0
    with pytest.raises(ValueError):
        clinical.component_series(spark, cat, env, "A-1", "glucose")
    # patient 1 born 1990-05-05 is 33 on 2024-01-01: values 1.0, 1.0, 2.0
    avg = clinical.component_average(spark, cat, env, "fibrinogen", 18, 40, dt.date(2024, 1, 1)).collect()
    assert avg[0].value == pytest.approx(4.0 / 3)
    # patient 2 (born 1950) has no value -> zero rows, not a null row
    assert clinical.component_average(spark, cat, env, "fibrinogen", 65, 90, dt.date(2024, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        clinical.component_average(spark, cat, env, "fibrinogen", 40, 18, dt.date(2024, 1, 1))


def test_semi_join_fallback_gives_same_series(spark):
    cat = small_catalog()
    a = clinical.component_series(spark, cat, envelope(), "A-1", "fibrinogen", max_literal_subjects=0)
    b = clinical.component_series(spark, cat, envelope(), "A-1", "fibrinogen")
    assert a.collect() == b.collect()


@pytest.mark.parametrize("birth_type", ["string", "timestamp"])
def test_averages_with_text_or_timestamp_birth_dates(spark, birth_type):
    """Profiles may keep birthDate as ISO text or as a timestamp; the single
    and batch averages give the same values as with a date column."""
    from conftest import PROFILE_ROWS, PROFILE_SCHEMA
    from custos.sources.catalog import TableSpec

    def profiles(s):
        df = s.createDataFrame(PROFILE_ROWS, PROFILE_SCHEMA)
        return df.withColumn("birthDate", F.col("birthDate").cast(birth_type))

    cat = small_catalog()
    other = dict(cat, patientsProfiles=TableSpec.derived(profiles))
    env = envelope()
    as_of = dt.date(2024, 1, 1)
    ranges = [(18, 40), (30, 80), (65, 90)]
    for start, end in ranges:
        a = clinical.component_average(spark, cat, env, "fibrinogen", start, end, as_of).collect()
        b = clinical.component_average(spark, other, env, "fibrinogen", start, end, as_of).collect()
        assert [r.value for r in a] == pytest.approx([r.value for r in b])
    a = clinical.average_by_age_ranges(spark, cat, env, "fibrinogen", ranges, as_of).collect()
    b = clinical.average_by_age_ranges(spark, other, env, "fibrinogen", ranges, as_of).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 2


def test_concurrent_requests_do_not_see_each_others_clauses(spark):
    """The original registers fixed view names in one shared session, so two
    parallel requests could read each other's clauses; here each runs in its
    own child session."""
    from concurrent.futures import ThreadPoolExecutor

    open_cat = small_catalog((("1", True, True), ("2", True, True)))
    closed_cat = small_catalog((("1", False, False), ("2", False, False)))
    expected_open = sorted(map(tuple, run_policy(spark, open_cat, envelope()).collect()), key=str)

    def request(cat):
        return sorted(map(tuple, run_policy(spark, cat, envelope()).collect()), key=str)

    with ThreadPoolExecutor(max_workers=4) as pool:
        futures = [pool.submit(request, open_cat if i % 2 == 0 else closed_cat) for i in range(8)]
        results = [f.result() for f in futures]
    for i, got in enumerate(results):
        assert got == (expected_open if i % 2 == 0 else [])


def test_policy_request():
    from custos.plans.policy import policy_request

    req = policy_request("cholesterol", "Research")
    assert req == {"query": "SELECT patientId, date, cholesterol_total_value FROM blood_tests",
                   "purpose": "Research", "access": "read", "requester": "", "blueprintId": "",
                   "requesterId": ""}
    assert policy_request("fibrinogen", "MedicalTreatment", "doc-1")["requesterId"] == "doc-1"


def test_envelope_from_bytes_and_mapping():
    raw = envelope().encode()
    assert Envelope.parse(raw) == Envelope.parse(json.loads(raw)) == Envelope.parse(envelope())
    with pytest.raises(ValueError):
        Envelope.parse({"tables": [{"nom": "x"}], "rewrittenQuery": "SELECT 1"})


def test_base_query_over_several_components(spark):
    from custos.plans.policy import policy_request

    query = base_query(["fibrinogen", "cholesterol", "fibrinogen"])
    assert query == "SELECT patientId, date, fibrinogen_value, cholesterol_total_value FROM blood_tests"
    assert policy_request(["fibrinogen"], "Research")["query"] == base_query("fibrinogen")
    with pytest.raises(ValueError):
        base_query([])
    # the answer to such a query is what the batch forms over all components read
    from custos.plans import fixtures as fx
    from conftest import SF001

    several = envelope(base_query(["cholesterol", "cholesterol.hdl".replace(".", "_"), "fibrinogen"]), ("blood_tests",))
    whole = Envelope(("blood_tests",), base_query(["cholesterol", "cholesterol_hdl", "fibrinogen"]))
    cat = fx.catalog(SF001)
    got = clinical.series_all_components(spark, cat, several)
    assert {r.component for r in got.select("component").distinct().collect()} == set(fx.COMPONENT_COLUMNS)
    averages = clinical.average_by_components_and_ranges(spark, cat, whole, fx.AGE_RANGES, fx.AS_OF).collect()
    for component, column in (("cholesterol", "cholesterol_total_value"), ("fibrinogen", "fibrinogen_value")):
        one = clinical.component_average(spark, cat, whole, component, 18, 40, fx.AS_OF).collect()
        assert [r.value for r in averages if r.component == column and r.startAge == 18] == pytest.approx([r.value for r in one])


REFUSED = {
    "metastore table": "SELECT patientId, date, fibrinogen_value FROM secret_tab",
    "qualified table": "SELECT patientId, date, fibrinogen_value FROM default.blood_tests",
    "global view": "SELECT * FROM global_temp.secret_view",
    "file path": "SELECT * FROM parquet.`/root/testdata/sf0.001/customer.parquet`",
    "command": "DROP TABLE secret_tab",
    "insert": "INSERT INTO secret_tab SELECT patientId, date, fibrinogen_value FROM blood_tests",
    "create": "CREATE TABLE copy AS SELECT * FROM blood_tests",
    "set": "SET spark.sql.ansi.enabled=false",
    "show": "SHOW TABLES",
    "subquery": "SELECT patientId, date, fibrinogen_value FROM blood_tests WHERE patientId IN (SELECT patientId FROM secret_tab)",
    "scalar subquery": "SELECT patientId, date, (SELECT max(fibrinogen_value) FROM secret_tab) AS fibrinogen_value FROM blood_tests",
    "inside a cte": "WITH a AS (SELECT * FROM secret_tab) SELECT * FROM a",
    "named like its cte": "WITH secret_tab AS (SELECT * FROM secret_tab) SELECT * FROM secret_tab",
    "identifier clause": "SELECT * FROM IDENTIFIER('secret_tab')",
    "join": "SELECT b.patientId, b.date, s.fibrinogen_value FROM blood_tests b JOIN secret_tab s USING (patientId)",
    "union": "SELECT * FROM blood_tests UNION ALL SELECT * FROM secret_tab",
    "unlisted clauses": "SELECT * FROM clauses",
    "script": "SELECT TRANSFORM(patientId, date) USING 'cat' AS (patientId, date) FROM blood_tests",
    "time travel": "SELECT * FROM blood_tests VERSION AS OF 1",
}
JAVA = "reflect('java.lang.System', 'getenv', 'PATH')"
REFUSED |= {f"function {kind}": query for kind, query in {
    "reflect": f"SELECT {JAVA} AS patientId FROM blood_tests",
    "java_method": "SELECT Java_Method('java.lang.System', 'getenv', 'PATH') AS patientId FROM blood_tests",
    "try_reflect": "SELECT try_reflect('java.lang.System', 'getenv', 'PATH') AS patientId FROM blood_tests",
    "qualified": "SELECT system.builtin.reflect('java.lang.System', 'getenv', 'PATH') AS patientId FROM blood_tests",
    "nested": f"SELECT patientId, date, length(concat('x', {JAVA})) AS fibrinogen_value FROM blood_tests",
    "in a filter": f"SELECT * FROM blood_tests WHERE {JAVA} IS NOT NULL",
    "in a subquery": f"SELECT * FROM blood_tests WHERE patientId IN (SELECT {JAVA})",
    "in a scalar subquery": f"SELECT (SELECT max({JAVA})) AS patientId FROM blood_tests",
    "in a cte": f"WITH a AS (SELECT {JAVA} AS patientId) SELECT * FROM a",
    "in a join": f"SELECT a.* FROM blood_tests a JOIN blood_tests b ON a.patientId = {JAVA}",
    "in a sort": f"SELECT * FROM blood_tests ORDER BY {JAVA}",
    "in having": f"SELECT patientId FROM blood_tests GROUP BY patientId HAVING max({JAVA}) > ''",
    "in grouping": f"SELECT count(*) AS fibrinogen_value FROM blood_tests GROUP BY {JAVA}",
    "in a window": f"SELECT max(patientId) OVER (PARTITION BY {JAVA}) AS patientId FROM blood_tests",
    "in a named window": f"SELECT max(patientId) OVER w AS patientId FROM blood_tests WINDOW w AS (PARTITION BY {JAVA})",
    "in a lambda": f"SELECT transform(array(1), x -> {JAVA}) AS patientId FROM blood_tests",
    "in a lateral view": f"SELECT y AS patientId FROM blood_tests LATERAL VIEW explode(array({JAVA})) e AS y",
    "in inline values": f"SELECT * FROM VALUES ({JAVA}) AS t(patientId)",
    "in a table function": f"SELECT * FROM explode(array({JAVA})) AS t(patientId)",
    "in a pivot": f"SELECT * FROM blood_tests PIVOT (max({JAVA}) FOR patientId IN ('1'))",
    "in a pipe": f"FROM blood_tests |> WHERE {JAVA} = '1'",
    "by identifier": "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getenv', 'PATH') AS patientId FROM blood_tests",
    "unknown": "SELECT leaked(patientId) AS patientId FROM blood_tests",
    "metastore": "SELECT default.leaked(patientId) AS patientId FROM blood_tests",
    "unknown generator": "SELECT y AS patientId FROM blood_tests LATERAL VIEW leaked(patientId) e AS y",
    "file name": "SELECT input_file_name() AS patientId FROM blood_tests",
    "avro schema file": "SELECT from_avro(patientId, 'x', map('avroSchemaUrl', '/etc/passwd')) AS patientId FROM blood_tests",
    "protobuf file": "SELECT from_protobuf(patientId, 'x', '/etc/passwd') AS patientId FROM blood_tests",
    "user": "SELECT current_user() AS patientId FROM blood_tests",
    "user without parentheses": "SELECT current_user AS patientId FROM blood_tests",
    "schema without parentheses in a subquery": "SELECT (SELECT max(session_user)) AS patientId FROM blood_tests",
}.items()}


@pytest.fixture(scope="module")
def secrets(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS secret_tab AS SELECT '9' AS patientId, DATE '2024-01-01' AS date, 9.0D AS fibrinogen_value")
    spark.sql("SELECT 1 AS patientId").createOrReplaceGlobalTempView("secret_view")
    yield
    spark.sql("DROP TABLE IF EXISTS secret_tab")
    spark.catalog.dropGlobalTempView("secret_view")


@pytest.mark.parametrize("kind", sorted(REFUSED))
def test_only_listed_tables_can_be_read(spark, secrets, kind):
    from custos.plans import PolicyViolation

    with pytest.raises(PolicyViolation):
        run_policy(spark, small_catalog(), envelope(REFUSED[kind], ("blood_tests",)))
    assert spark.table("secret_tab").count() == 1


def test_registered_functions_are_refused_and_nothing_ran(spark, tmp_path):
    """A function the session knows is not built in; a refused query has not touched anything."""
    from custos.plans import PolicyViolation

    mark = tmp_path / "ran"
    spark.udf.register("leaked", lambda x: str(mark.write_text("x")))
    try:
        with pytest.raises(PolicyViolation, match="leaked"):
            run_policy(spark, small_catalog(), envelope("SELECT leaked(patientId) AS patientId FROM blood_tests", ("blood_tests",)))
        with pytest.raises(PolicyViolation, match="ScriptTransformation"):
            run_policy(spark, small_catalog(), envelope(
                f"SELECT TRANSFORM(patientId) USING 'touch {mark}' AS (patientId) FROM blood_tests", ("blood_tests",))).collect()
    finally:
        spark.sql("DROP TEMPORARY FUNCTION IF EXISTS leaked")
    assert not mark.exists()


def test_functions_of_a_tables_own_definition_are_its_own(spark):
    """What the catalog's tables are made of is the operator's business, not the query's."""
    from custos.sources.catalog import TableSpec

    cat = small_catalog() | {"blood_tests": TableSpec.derived(
        lambda s: small_catalog()["blood_tests"].build(s).selectExpr("*", "current_user() AS who"))}
    rows = run_policy(spark, cat, envelope("SELECT patientId, who FROM blood_tests", ("blood_tests",)))
    assert rows.count() > 0


def test_builtin_functions_pass(spark):
    for query in ("SELECT patientId, date, coalesce(sum(fibrinogen_value) OVER w, 0D) AS fibrinogen_value FROM blood_tests "
                  "WINDOW w AS (PARTITION BY patientId ORDER BY date)",
                  "SELECT patientId, max(date) AS date FROM blood_tests GROUP BY patientId HAVING count(*) > 0 ORDER BY 1 LIMIT 5",
                  "SELECT DISTINCT patientId, element_at(transform(array(date), x -> date_add(x, 1)), 1) AS date FROM blood_tests",
                  "SELECT sha2(patientId, 256) AS patientId, extract(YEAR FROM date) AS year, "
                  "CASE WHEN date BETWEEN DATE '2024-01-01' AND current_date() THEN CAST(fibrinogen_value AS INT) END AS v "
                  "FROM blood_tests WHERE patientId LIKE '%' AND patientId IN ('1', '2')",
                  "SELECT * FROM (SELECT patientId, date FROM blood_tests) a INTERSECT SELECT patientId, date FROM blood_tests",
                  "SELECT /*+ REPARTITION(3) */ * FROM blood_tests TABLESAMPLE (100 PERCENT)",
                  "FROM blood_tests |> WHERE patientId = '1' |> SELECT patientId, date"):
        assert run_policy(spark, small_catalog(), envelope(query)).count() > 0, query


def test_two_queries_are_refused(spark, secrets):
    from pyspark.errors import ParseException

    with pytest.raises(ParseException):
        run_policy(spark, small_catalog(), envelope("SELECT * FROM blood_tests; DROP TABLE secret_tab", ("blood_tests",)))
    assert spark.table("secret_tab").count() == 1


def test_queries_over_listed_tables_pass(spark):
    for query in ("WITH a AS (SELECT * FROM Blood_Tests), b AS (SELECT * FROM a) SELECT * FROM b",
                  "SELECT b.* FROM blood_tests b WHERE EXISTS (SELECT 1 FROM clauses c WHERE c.patientId = b.patientId)",
                  "SELECT * FROM blood_tests UNION ALL SELECT * FROM VALUES ('1', DATE '2024-01-01', 1.0D)",
                  "SELECT b.* FROM blood_tests b LATERAL VIEW explode(array(1)) x AS y"):
        assert run_policy(spark, small_catalog(), envelope(query)).count() > 0


ODD_BIRTHS = ["1984-01-01", "1984-01-01T00:00:00", "1990-13-45", "1990-05-05", "2005-12-31", "2006-01-01", "", "x", None,
              "0001-01-01", "1959-01-01 12:00:00", "19900505", "9999-12-31"]


@pytest.mark.parametrize("birth_type", ["string", "date", "timestamp"])
def test_batch_averages_equal_single_averages_on_every_birth_date_type(spark, birth_type):
    from custos.sources.catalog import TableSpec

    rows = [(str(i), f"S-{i}", b) for i, b in enumerate(ODD_BIRTHS)]
    values = [(str(i), dt.date(2024, 1, 1), float(3 ** i)) for i in range(len(ODD_BIRTHS))]
    raw = "patientId string, socialId string, birthDate string"

    def profiles(s):
        df = s.createDataFrame(rows, raw)
        return df.withColumn("birthDate", F.expr(f"try_cast(birthDate AS {birth_type})"))

    cat = {"blood_tests": TableSpec.derived(lambda s: s.createDataFrame(values, "patientId string, date date, fibrinogen_value double")),
           "patientsProfiles": TableSpec.derived(profiles)}
    env = envelope(base_query("fibrinogen"), ("blood_tests",))
    as_of = dt.date(2024, 1, 1)
    ranges = [(18, 40), (40, 65), (18, 3000), (0, 2023), (2500, 3000), (33, 34), (0, 1), (39, 41)]
    singles = {r: clinical.component_average(spark, cat, env, "fibrinogen", *r, as_of).collect() for r in ranges}
    want = {r: v[0].value for r, v in singles.items() if v}
    by_range = clinical.average_by_age_ranges(spark, cat, env, "fibrinogen", ranges, as_of).collect()
    by_both = clinical.average_by_components_and_ranges(spark, cat, env, ranges, as_of).collect()
    assert {(r.startAge, r.endAge): r.value for r in by_range} == pytest.approx(want)
    assert {(r.startAge, r.endAge): r.value for r in by_both} == pytest.approx(want)
    assert (18, 3000) in want and len(want) >= 4


def test_narrow_average_filters_blood_tests_first(spark):
    """Where the ids in range are few, the blood tests are joined with them as they are read and no sums per
    patient are made; repeated profile rows still count each time."""
    from custos.plans import fixtures as fx
    from custos.sources.catalog import TableSpec
    from conftest import SF001

    cat = fx.catalog(SF001)
    cat["patientsProfiles"] = TableSpec.derived(
        lambda s: fx.patient_profiles(s, SF001).unionAll(fx.patient_profiles(s, SF001).filter("patientId % 3 = 0")))
    env = fx.clause_mask_envelope(("fibrinogen_value",))
    early = clinical.component_average(spark, cat, env, "fibrinogen", 18, 40, fx.AS_OF)
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "keys=[patientId" not in plan and plan.index("partial_sum(value__sum") < plan.index("BroadcastHashJoin")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        late = clinical.component_average(spark, cat, env, "fibrinogen", 18, 40, fx.AS_OF)
        assert "keys=[patientId" in late._jdf.queryExecution().executedPlan().toString()
        assert late.collect()[0].value == pytest.approx(early.collect()[0].value, rel=1e-12)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
