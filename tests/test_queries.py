"""Each registered query against its DuckDB oracle, and batch forms against
the single-request forms (SURVEY §5 items 2 and 3)."""


import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.plans import registry
from tools.compare import compare

from conftest import SF001, SF01

KEYS = sorted(registry.QUERIES)


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.QUERIES)
    assert set(KEYS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "value"]
    assert df.count() >= 0


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF01, [key])[key]
    assert res["cols_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["values_match"], res


def _mask():
    return fx.clause_mask_envelope(("fibrinogen_value",))


def test_batch_series_equals_single_patient(spark):
    cat = fx.catalog(SF001)
    batch = clinical.series_all_patients(spark, cat, _mask(), "fibrinogen")
    long = clinical.series_all_components(spark, cat, fx.clause_mask_envelope(fx.COMPONENT_COLUMNS))
    for social_id in ("Customer#000000009", "Customer#000000042", "Customer#000000077"):
        one = {tuple(r) for r in clinical.component_series(spark, cat, _mask(), social_id, "fibrinogen").collect()}
        from_batch = {tuple(r) for r in batch.filter(F.col("socialId") == social_id).select("date", "value").collect()}
        from_long = {tuple(r) for r in long.filter((F.col("socialId") == social_id)
                                                    & (F.col("component") == "fibrinogen_value"))
                     .select("date", "value").collect()}
        assert one == from_batch == from_long


def test_batch_averages_equal_single_range(spark):
    cat = fx.catalog(SF001)
    ranges = [(18, 40), (40, 65), (65, 90), (3, 10), (20, 70)]
    batch = {(r.startAge, r.endAge): r.value for r in
             clinical.average_by_age_ranges(spark, cat, _mask(), "fibrinogen", ranges, fx.AS_OF).collect()}
    wide = clinical.average_by_components_and_ranges(
        spark, cat, fx.clause_mask_envelope(fx.COMPONENT_COLUMNS), ranges, fx.AS_OF)
    by_component = {(r.startAge, r.endAge): r.value for r in
                    wide.filter(F.col("component") == "fibrinogen_value").collect()}
    for start, end in ranges:
        single = clinical.component_average(spark, cat, _mask(), "fibrinogen", start, end, fx.AS_OF).collect()
        if not single:
            assert (start, end) not in batch and (start, end) not in by_component
            continue
        assert batch[(start, end)] == pytest.approx(single[0].value, rel=1e-12)
        assert by_component[(start, end)] == pytest.approx(single[0].value, rel=1e-12)


def test_batch_json_arrays_equal_single_patient(spark):
    from custos.operators.ordering import series_order
    from custos.operators.output import json_array_parts

    cat = fx.catalog(SF001)
    batch = json_array_parts(clinical.series_all_patients(spark, cat, _mask(), "fibrinogen"), series_order(),
                             keys=("socialId",), part_size=7)
    sizes = batch.groupBy("socialId").count().orderBy(F.desc("count"), "socialId").collect()
    assert sizes[0]["count"] > 1  # the largest series spans several parts
    for social_id in (sizes[0].socialId, sizes[-1].socialId, "Customer#000000009"):
        one = json_array_parts(clinical.component_series(spark, cat, _mask(), social_id, "fibrinogen"),
                               series_order(), part_size=7)
        want = sorted((r.part, r.json) for r in one.collect())
        got = sorted((r.part, r.json) for r in batch.filter(F.col("socialId") == social_id).collect())
        assert got == want and got


def test_batch_averages_accept_any_iterable_of_ranges(spark):
    cat = fx.catalog(SF001)
    listed = clinical.average_by_age_ranges(spark, cat, _mask(), "fibrinogen", [(18, 40), (40, 65)], fx.AS_OF)
    generated = clinical.average_by_age_ranges(spark, cat, _mask(), "fibrinogen",
                                               ((s, e) for s, e in [(18, 40), (40, 65)]), fx.AS_OF)
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, generated.collect()))
