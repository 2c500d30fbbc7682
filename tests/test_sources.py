import pytest

from custos.sources.catalog import TableSpec, jdbc_options, load_table, register_tables, view_name


def test_table_spec_validation():
    with pytest.raises(ValueError):
        TableSpec("s3a", "x")
    with pytest.raises(ValueError):
        TableSpec("derived")
    with pytest.raises(ValueError):
        TableSpec("parquet", "")


def test_parquet_scan_by_logical_name(spark):
    cat = {"events": TableSpec.parquet("/root/testdata/sf0.001/events.parquet")}
    assert load_table(spark, cat, "events").count() == 1000
    with pytest.raises(ValueError):
        load_table(spark, cat, "missing")


def test_jdbc_options_plain_and_partitioned():
    spec = TableSpec.jdbc("patient", "jdbc:mysql://db/x", user="u", password="p")
    assert jdbc_options(spec) == {"dbtable": "patient", "fetchsize": "10000", "url": "jdbc:mysql://db/x",
                                  "user": "u", "password": "p"}
    assert jdbc_options(TableSpec.jdbc("patient", "jdbc:mysql://db/x", fetchsize="500"))["fetchsize"] == "500"
    parallel = TableSpec.jdbc("patient", "jdbc:mysql://db/x", partitionColumn="patientId", lowerBound="0",
                              upperBound="1000000", numPartitions="64")
    opts = jdbc_options(parallel)
    assert opts["numPartitions"] == "64" and opts["partitionColumn"] == "patientId"
    with pytest.raises(ValueError):
        jdbc_options(TableSpec.jdbc("patient", "jdbc:mysql://db/x", partitionColumn="patientId"))
    with pytest.raises(ValueError):
        jdbc_options(TableSpec.parquet("/x"))


def test_clauses_alias():
    assert view_name("blood_tests_clauses") == "clauses"
    assert view_name("patientsProfiles_clauses") == "clauses"
    assert view_name("blood_tests") == "blood_tests"


def test_two_clauses_tables_in_one_envelope_raise(spark):
    spec = TableSpec.derived(lambda s: s.range(1))
    cat = {"a_clauses": spec, "b_clauses": spec}
    with pytest.raises(ValueError):
        register_tables(spark.newSession(), cat, ["a_clauses", "b_clauses"])


def test_builder_must_use_given_session(spark):
    other = spark.newSession()
    cat = {"t": TableSpec.derived(lambda s: other.range(1))}
    with pytest.raises(ValueError):
        register_tables(spark.newSession(), cat, ["t"])


def test_catalog_from_flat_settings(spark):
    from custos.sources.settings import catalog_from_settings, table_from_settings

    settings = {
        "db.mysql.url": "jdbc:mysql://db/example", "db.mysql.username": "u", "db.mysql.password": "p",
        "blood_tests": "/root/testdata/sf0.001/events.parquet", "blood_tests_type": "s3a",
        "patientsProfiles": "patient", "patientsProfiles_type": "jdbc",
        "spark.sql.shuffle.partitions": "2", "debug.mode": "true",
    }
    cat = catalog_from_settings(settings, jdbc_options={"partitionColumn": "patientId", "lowerBound": "0",
                                                        "upperBound": "10000", "numPartitions": "8"})
    assert set(cat) == {"blood_tests", "patientsProfiles"}
    assert load_table(spark, cat, "blood_tests").count() == 1000
    opts = jdbc_options(cat["patientsProfiles"])
    assert opts["dbtable"] == "patient" and opts["url"] == "jdbc:mysql://db/example"
    assert opts["user"] == "u" and opts["numPartitions"] == "8"
    # a table's own options go before the shared ones
    own = catalog_from_settings(settings | {"patientsProfiles_jdbc.numPartitions": "64", "other_jdbc.x": "y"},
                                jdbc_options={"partitionColumn": "patientId", "lowerBound": "0", "upperBound": "10000",
                                              "numPartitions": "8"})
    assert jdbc_options(own["patientsProfiles"])["numPartitions"] == "64" and "x" not in own["patientsProfiles"].options
    # a bad or unrelated entry does not keep the other tables from being read
    mixed = catalog_from_settings(settings | {"x": "loc", "x_type": "csv", "mime_type": "json", "y_type": "s3a"})
    assert set(mixed) == {"blood_tests", "patientsProfiles"}
    for bad in ({"x": "loc", "x_type": "csv"}, {"x_type": "s3a"}, {"x": "loc"}, {"x": "t", "x_type": "jdbc"}):
        with pytest.raises(ValueError):
            table_from_settings(bad, "x")


def test_credentials_are_not_printed():
    assert "secret" not in repr(TableSpec.jdbc("patient", "jdbc:mysql://db/x", user="u", password="secret"))


def test_a_table_listed_twice_is_registered_once(spark):
    spec = TableSpec.derived(lambda s: s.range(3))
    session = spark.newSession()
    assert register_tables(session, {"t": spec, "a_clauses": spec}, ["t", "a_clauses", "t", "a_clauses"]) == {
        "t": "t", "clauses": "a_clauses"}
    assert session.table("t").count() == 3
    with pytest.raises(ValueError):
        register_tables(spark.newSession(), {"t": spec, "T": spec}, ["t", "T"])
