"""Physical-plan checks: no Python in any plan, filters
reach the scan, averages pre-aggregate per patient, positions use no
data-wide single-partition window."""

import re

import pytest

import __spark_entry__ as entry
from custos.plans import registry

from conftest import SF001

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_of(spark, key):
    df = entry.queries()[key](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_python_in_plan(spark, key):
    plan = plan_of(spark, key)
    assert not [n for n in PYTHON_NODES if n in plan]


def test_one_patient_ids_reach_the_blood_test_scan(spark):
    plan = plan_of(spark, "series_one_patient")
    scans = [line for line in plan.splitlines() if "events.parquet" in line]
    assert scans and all(re.search(r"PushedFilters: \[.*(EqualTo\(user_id,\d+\)|In\(user_id)", s) for s in scans)
    # ...and through the policy join into the clauses scan
    clause_scans = [line for line in plan.splitlines() if "customer.parquet" in line]
    assert clause_scans and all(re.search(r"(EqualTo\(c_custkey,\d+\)|In\(c_custkey)", s) for s in clause_scans)


def test_average_pre_aggregates_per_patient(spark, monkeypatch):
    """Where the ids in range are too many to be broadcast."""
    monkeypatch.setattr("custos.plans.clinical.broadcast_threshold", lambda _: 0)
    plan = plan_of(spark, "avg_age_range")
    lines = plan.splitlines()
    partial = [i for i, line in enumerate(lines) if "partial_count(fibrinogen_value" in line]
    exchange = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(patientId" in line]
    assert partial and exchange and exchange[0] < partial[0]  # the shuffle sits above the map-side partials


def test_a_small_age_range_is_one_join_and_shuffles_sums_only(spark):
    plan = plan_of(spark, "avg_age_range")
    # the profiles in range are joined once, and each task sends one sum
    assert "LeftSemi" not in plan
    assert "partial_sum(value__sum" in plan
    above = plan[:plan.index("partial_sum(value__sum")]
    assert "Exchange SinglePartition" in above and "hashpartitioning(patientId" not in plan.split("LeftOuter")[0]


def test_position_window_only_over_partition_counts(spark):
    plan = plan_of(spark, "series_sorted_rank")
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows and all("_part" in w and "_n" in w for w in windows)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_no_nested_loop_or_cartesian_join(spark, key):
    plan = plan_of(spark, key)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_age_ranges_meet_data_in_an_equi_join(spark):
    plan = plan_of(spark, "avg_components_ranges")
    assert re.search(r"BroadcastHashJoin \[_age", plan)
