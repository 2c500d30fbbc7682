"""Bucketed tables: the policy join and the profile join need no exchange."""

import uuid

import pytest

from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.sources.catalog import TableSpec
from custos.sources.layout import write_bucketed

from conftest import SF001


def test_bucketed_tables_make_subject_joins_shuffle_free(spark):
    suffix = uuid.uuid4().hex[:8]
    names = {"blood_tests": f"bt_{suffix}", "blood_tests_clauses": f"cl_{suffix}",
             "patientsProfiles": f"pp_{suffix}"}
    write_bucketed(fx.blood_tests(spark, SF001), names["blood_tests"], 4)
    write_bucketed(fx.clauses(spark, SF001), names["blood_tests_clauses"], 4)
    write_bucketed(fx.patient_profiles(spark, SF001), names["patientsProfiles"], 4)
    catalog = {logical: TableSpec.table(table) for logical, table in names.items()}
    env = fx.clause_mask_envelope(("fibrinogen_value",))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = clinical.compliant_joined(spark, catalog, env)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2
        assert "Exchange" not in plan
        # same rows as the unbucketed fixture tables
        plain = clinical.compliant_joined(spark, fx.catalog(SF001), env)
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        # the average: clauses join, per-patient partials and profile join all
        # run inside the buckets; the only exchange gathers the final partials
        avg = clinical.component_average(spark, catalog, env, "fibrinogen", 18, 90, fx.AS_OF)
        avg_plan = avg._jdf.queryExecution().executedPlan().toString()
        assert avg_plan.count("Exchange") == 1 and "Exchange SinglePartition" in avg_plan
        want_avg = clinical.component_average(spark, fx.catalog(SF001), env, "fibrinogen", 18, 90, fx.AS_OF)
        assert avg.collect()[0].value == pytest.approx(want_avg.collect()[0].value, rel=1e-12)
        # the one-patient series reads only the patient's bucket of each table
        series = clinical.component_series(spark, catalog, env, fx.SOCIAL_ID_EXAMPLE, "fibrinogen")
        plan = series._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SelectedBucketsCount: 1 out of 4") == 2
        want = clinical.component_series(spark, fx.catalog(SF001), env, fx.SOCIAL_ID_EXAMPLE, "fibrinogen")
        assert series.collect() == want.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_write_bucketed_rejects_bad_bucket_count(spark):
    with pytest.raises(ValueError):
        write_bucketed(spark.range(3), "never_written", 0)
    with pytest.raises(ValueError):
        write_bucketed(spark.range(3), "never_written", 100_001)


def test_one_file_a_bucket(spark):
    import os

    name = f"one_{uuid.uuid4().hex[:8]}"
    write_bucketed(fx.blood_tests(spark, SF001).repartition(8), name, 4)
    files = [f for f in spark.table(name).inputFiles() if os.path.basename(f).startswith("part-")]
    assert len(files) == 4


def test_hot_patients_are_kept_out_of_buckets(spark):
    from pyspark.sql import functions as F

    from custos.sources.layout import largest_key_share

    hot = spark.range(300).select(F.when(F.col("id") % 3 == 0, 9).otherwise(F.col("id")).alias("patientId"))
    assert largest_key_share(hot) == pytest.approx(101 / 300, abs=0.01)
    assert largest_key_share(spark.range(0).select(F.col("id").alias("patientId"))) == 0
    with pytest.raises(ValueError, match="unbucketed"):
        write_bucketed(hot, "never_written", 4, largest_share=0.1)


def test_only_a_local_session_gets_a_local_checkpoint_folder():
    """Without spark.checkpoint.dir a cluster session raises instead of using a machine's own folder."""
    from types import SimpleNamespace

    from custos.session import ensure_checkpoint_dir, is_local

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: {})
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))

    assert [is_local(session(m)) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,1024]", "yarn", "spark://h:7077")] \
        == [True, True, True, False, False, False]
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master), allow_local=is_local(session(master)))
