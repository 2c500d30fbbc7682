import pytest

from custos.plans import fixtures as fx
from custos.streaming.running import latest, run_available, running_partials, stream_folder

from conftest import SF001


def test_stream_requires_a_streaming_blood_tests_table(spark):
    with pytest.raises(ValueError):
        running_partials(spark, fx.catalog(SF001), fx.clause_mask_envelope(fx.COMPONENT_COLUMNS))


def test_stream_equals_batch_and_restarts_from_checkpoint(spark):
    from custos.plans import clinical

    env = fx.clause_mask_envelope(fx.COMPONENT_COLUMNS)
    stream = running_partials(spark, fx.stream_catalog(SF001), env)
    assert stream.isStreaming
    output, checkpoint = stream_folder(spark, "test")
    run_available(stream, output, checkpoint, fx.AGE_RANGES, fx.AS_OF)
    got = {(r.component, r.startAge, r.endAge): r.value for r in latest(spark, output).collect()}
    batch = clinical.average_by_components_and_ranges(spark, fx.catalog(SF001), env, fx.AGE_RANGES, fx.AS_OF)
    want = {(r.component, r.startAge, r.endAge): r.value for r in batch.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    # a restart with the same checkpoint finds no new files and keeps the result
    run_available(running_partials(spark, fx.stream_catalog(SF001), env),
                  output, checkpoint, fx.AGE_RANGES, fx.AS_OF)
    again = {(r.component, r.startAge, r.endAge): r.value for r in latest(spark, output).collect()}
    assert again == got


def test_stream_state_accumulates_across_batches(spark):
    """Blood tests landing in two files, processed in two runs from one
    checkpoint, give the batch answer over both files."""
    import os
    import tempfile

    from pyspark.sql import functions as F

    from custos.plans import clinical
    from custos.sources.catalog import TableSpec

    root = tempfile.mkdtemp(prefix="custos-stream-", dir="/tmp")
    incoming = os.path.join(root, "blood_tests")
    bt = fx.blood_tests(spark, SF001)
    first, second = bt.filter(F.col("date") <= F.lit("2024-01-15").cast("date")), \
        bt.filter(F.col("date") > F.lit("2024-01-15").cast("date"))
    first.write.parquet(os.path.join(incoming, "part=1"))
    env = fx.clause_mask_envelope(fx.COMPONENT_COLUMNS)
    schema = bt.schema

    def stream_catalog():
        cat = fx.catalog(SF001)
        cat["blood_tests"] = TableSpec.stream(incoming, schema=schema, recursiveFileLookup="true")
        return cat

    output, checkpoint = stream_folder(spark, "two-batches")
    run_available(running_partials(spark, stream_catalog(), env), output, checkpoint, fx.AGE_RANGES, fx.AS_OF)
    partial = {(r.component, r.startAge, r.endAge): r.value for r in latest(spark, output).collect()}
    second.write.parquet(os.path.join(incoming, "part=2"))
    run_available(running_partials(spark, stream_catalog(), env), output, checkpoint, fx.AGE_RANGES, fx.AS_OF)
    got = {(r.component, r.startAge, r.endAge): r.value for r in latest(spark, output).collect()}
    want = {(r.component, r.startAge, r.endAge): r.value for r in clinical.average_by_components_and_ranges(
        spark, fx.catalog(SF001), env, fx.AGE_RANGES, fx.AS_OF).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    assert partial != got  # the second file changed the running averages


def test_restart_on_another_day_gives_that_days_ages(spark):
    """A patient born 1984-06-01 turns 40 between two runs from one checkpoint: the second run's
    averages equal the batch form on its own day."""
    import datetime as dt
    import os
    import tempfile

    from custos.plans import clinical
    from custos.sources.catalog import TableSpec

    root = tempfile.mkdtemp(prefix="custos-stream-", dir="/tmp")
    incoming = os.path.join(root, "blood_tests")
    schema = "patientId string, date date, fibrinogen_value double"
    day = dt.date(2023, 12, 1)
    profiles = spark.createDataFrame([("1", "A", dt.date(1984, 6, 1)), ("2", "B", dt.date(2000, 1, 1))],
                                     "patientId string, socialId string, birthDate date")
    cat = {"blood_tests": TableSpec.stream(incoming, schema=schema, recursiveFileLookup="true"),
           "patientsProfiles": TableSpec.derived(lambda s: profiles)}
    still = dict(cat, blood_tests=TableSpec.parquet(incoming, schema=schema, recursiveFileLookup="true"))
    env = {"tables": [{"name": "blood_tests"}], "rewrittenQuery": "SELECT patientId, date, fibrinogen_value FROM blood_tests"}
    ranges = [(18, 40), (40, 65)]
    output, checkpoint = stream_folder(spark, "two-days")
    for i, (as_of, rows) in enumerate(((dt.date(2024, 1, 1), [("1", day, 10.0)]), (dt.date(2024, 12, 1), [("1", day, 30.0)]),
                                       (dt.date(2019, 1, 1), []))):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(incoming, f"part={i}"))
        run_available(running_partials(spark, cat, env), output, checkpoint, ranges, as_of)
        got = sorted((r.startAge, r.endAge, r.value) for r in latest(spark, output).collect())
        batch = clinical.average_by_components_and_ranges(spark, still, env, ranges, as_of)
        assert got == sorted((r.startAge, r.endAge, r.value) for r in batch.collect())
        assert got == [[(18, 40, 10.0)], [(40, 65, 20.0)], [(18, 40, 20.0)]][i]
