"""custos: policy-compliant clinical queries on Spark.

Blood tests and patient profiles are read as DataFrames, a policy-rewritten
SQL query runs over them in an isolated child session, rows the policy left
empty are removed, and the rest answers two questions: the time series of one
blood-test component for one patient, and the average of a component over an
age range. Batch forms answer them for every patient, component and age range
in one Spark job.

Layout:
  sources/    table catalog and readers (Parquet, JDBC, metastore tables)
  functions/  column expressions and small driver-side helpers
  operators/  DataFrame -> DataFrame building blocks
  plans/      policy execution and the clinical queries built from operators
  streaming/  the compliant series over a stream of blood tests
"""

from custos.constants import CLAUSES, DATE, SUBJECT_ID, VALUE
from custos.plans.clinical import (
    average_by_age_ranges,
    average_by_components_and_ranges,
    component_average,
    component_series,
    compliant_joined,
    series_all_components,
    series_all_patients,
)
from custos.plans.policy import Envelope, base_query, policy_request, run_policy
from custos.session import recommended_conf
from custos.sources.catalog import TableSpec
from custos.sources.settings import catalog_from_settings

__all__ = [
    "CLAUSES",
    "DATE",
    "SUBJECT_ID",
    "VALUE",
    "Envelope",
    "TableSpec",
    "average_by_age_ranges",
    "average_by_components_and_ranges",
    "base_query",
    "catalog_from_settings",
    "compliant_joined",
    "component_average",
    "component_series",
    "policy_request",
    "recommended_conf",
    "run_policy",
    "series_all_components",
    "series_all_patients",
]
