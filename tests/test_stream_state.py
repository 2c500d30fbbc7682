"""Streams that keep state: the deduplicated series, and averages that follow the profiles."""

import glob
import os

import pytest

from custos.plans import clinical
from custos.plans import fixtures as fx
from custos.sources.catalog import TableSpec
from custos.streaming.patients import averages_now, compact, patients_so_far, run_patients, running_patients
from custos.streaming.series import run_series, running_series, series_so_far, state_rows

from conftest import SF001

MASK = fx.clause_mask_envelope(("fibrinogen_value",))
ALL = fx.clause_mask_envelope(fx.COMPONENT_COLUMNS)


def arriving(spark, folder):
    schema = fx.blood_tests(spark, SF001).schema
    return fx.catalog(SF001) | {"blood_tests": TableSpec.stream(folder, schema=schema)}


def arrive(spark, folder, part, parts=3):
    fx.blood_tests(spark, SF001).filter(f"patientId % {parts} = {part}").coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_late_and_repeated_files_give_the_batch_rows(spark, tmp_path):
    folder, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    want = rows(clinical.series_all_patients(spark, fx.catalog(SF001), MASK, "fibrinogen"))
    states = []
    # files come in any order of their dates, twice, and also twice in one run
    for parts in ((2, 2), (0, 2), (1, 0, 1)):
        for part in parts:
            arrive(spark, folder, part)
        query = run_series(running_series(spark, arriving(spark, folder), MASK, "fibrinogen"), output, checkpoint)
        states.append(state_rows(query))
    assert rows(series_so_far(spark, output)) == want
    # nothing was written twice, and the state holds each row once
    assert rows(spark.read.parquet(output)) == want and states[-1] == len(want)
    assert states == sorted(states)


def test_state_is_bounded_in_time(spark, tmp_path):
    folder, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    want = rows(clinical.series_all_patients(spark, fx.catalog(SF001), MASK, "fibrinogen"))
    held = []
    for part in (0, 1, 2, 0):
        arrive(spark, folder, part)
        series = running_series(spark, arriving(spark, folder), MASK, "fibrinogen", keep="1 millisecond")
        held.append(state_rows(run_series(series, output, checkpoint)))
    # each run ends with the state of its own time only; rows that came back collapse when read
    assert max(held) < len(want)
    assert rows(series_so_far(spark, output)) == want
    assert spark.read.parquet(output).count() > len(want)


def test_series_needs_a_stream(spark):
    for make in (lambda: running_series(spark, fx.catalog(SF001), MASK, "fibrinogen"),
                 lambda: running_patients(spark, fx.catalog(SF001), ALL)):
        with pytest.raises(ValueError, match="not a stream"):
            make()


def averages(df):
    return {tuple(r)[:-1]: r.value for r in df.collect()}


def test_averages_follow_changed_profiles(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    before = {"patientsProfiles": TableSpec.derived(lambda s: fx.uncorrected_profiles(s, SF001))}
    fewer = {"patientsProfiles": TableSpec.derived(lambda s: fx.patient_profiles(s, SF001).filter("patientId % 5 <> 1"))}
    for part in (0, 1, 2):
        arrive(spark, folder, part)
        run_patients(running_patients(spark, arriving(spark, folder) | before, ALL), out, checkpoint, compact_after=2)
    partials = patients_so_far(spark, out)
    for profiles in (before, {}, fewer):
        tables = fx.catalog(SF001) | profiles
        want = averages(clinical.average_by_components_and_ranges(spark, tables, ALL, fx.AGE_RANGES, fx.AS_OF))
        assert averages(averages_now(spark, tables, partials, fx.AGE_RANGES, fx.AS_OF)) == pytest.approx(want, rel=1e-12)
    # three runs and a compaction left few folders; another changes nothing
    folders = glob.glob(os.path.join(out, "changes", "*"))
    assert len(folders) <= 2
    had = rows(patients_so_far(spark, out))
    compact(spark, out, 1)
    assert len(glob.glob(os.path.join(out, "changes", "*"))) == 1 and rows(patients_so_far(spark, out)) == had


def test_a_patient_who_comes_back_is_counted_on(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for day in ("<", ">="):
        fx.blood_tests(spark, SF001).filter(f"date {day} DATE '2024-01-10'").coalesce(1).write.mode("append").parquet(folder)
        run_patients(running_patients(spark, arriving(spark, folder), ALL), out, checkpoint)
    want = averages(clinical.average_by_components_and_ranges(spark, fx.catalog(SF001), ALL, fx.AGE_RANGES, fx.AS_OF))
    got = averages_now(spark, fx.catalog(SF001), patients_so_far(spark, out), fx.AGE_RANGES, fx.AS_OF)
    assert averages(got) == pytest.approx(want, rel=1e-12)
