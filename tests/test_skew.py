"""A patient holding a third of all blood tests is split across tasks."""

import pytest
from pyspark.sql import functions as F

from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.sources.catalog import TableSpec

from conftest import SF01

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}
HOT = 9


def hot_blood_tests(spark):
    # Every test after 2024-01-20 (about a third) belongs to one patient. The
    # round-robin repartition stands in for the many scan tasks of a large
    # table: a skewed partition is split along map outputs.
    bt = fx.blood_tests(spark, SF01)
    hot = F.when(F.col("date") > F.lit("2024-01-20").cast("date"), F.lit(HOT)).otherwise(F.col("patientId"))
    return bt.withColumn("patientId", hot).repartition(8)


@pytest.fixture()
def skewed(spark):
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    catalog = fx.catalog(SF01)
    catalog["blood_tests"] = TableSpec.derived(hot_blood_tests)
    yield catalog
    for k in SKEW_CONF:
        spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_patient_average_is_split_and_exact(spark, skewed):
    env = fx.clause_mask_envelope(("fibrinogen_value",))
    avg = clinical.component_average(spark, skewed, env, "fibrinogen", 18, 90, fx.AS_OF)
    assert "skew=true" in final_plan(avg)
    joined = clinical.compliant_joined(spark, skewed, env)
    from custos.functions.dates import birth_date_bounds
    low, high = birth_date_bounds(fx.AS_OF, 18, 90)
    expected = joined.filter((F.col("birthDate") > F.lit(low)) & (F.col("birthDate") < F.lit(high))) \
        .agg(F.avg("fibrinogen_value").alias("value")).collect()[0].value
    assert avg.collect()[0].value == pytest.approx(expected, rel=1e-12)


def test_hot_patient_series_is_split(spark, skewed):
    env = fx.clause_mask_envelope(("fibrinogen_value",))
    series = clinical.series_all_patients(spark, skewed, env, "fibrinogen")
    assert "skew=true" in final_plan(series)


def test_hot_patient_json_array_is_split_and_complete(spark):
    """Half of the rows under one key: the join that ranks them is split, and its parts are built by many tasks."""
    from custos.operators.output import json_array_parts

    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 6000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                         F.col("id").alias("v"))
        parts = json_array_parts(df, [F.col("v")], keys=("k",), part_size=50)
        rows = parts.collect()
        plan = parts._jdf.queryExecution().executedPlan().toString()
        tasks = parts.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k in [*SKEW_CONF, "spark.sql.adaptive.coalescePartitions.enabled"]:
            spark.conf.unset(k)
    assert "skew=true" in plan
    import json
    hot = [r for r in sorted(rows, key=lambda r: r["part"]) if r["k"] == "hot"]
    assert [r["part"] for r in hot] == list(range(60))
    assert [x["v"] for r in hot for x in json.loads(r["json"])] == list(range(0, 6000, 2))
    assert tasks > 1


def test_null_keys_form_arrays(spark):
    from custos.operators.output import json_array_parts

    df = spark.createDataFrame([(None, 2), ("a", 1), (None, 1), ("a", None)], "k string, v int")
    rows = {r["k"]: r["json"] for r in json_array_parts(df, [F.col("v").asc_nulls_first()], keys=("k",)).collect()}
    assert rows == {None: '[{"v":1},{"v":2}]', "a": '[{},{"v":1}]'}
