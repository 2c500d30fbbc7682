"""Policy execution and the clinical queries."""

from custos.plans.clinical import (
    average_by_age_ranges,
    average_by_components_and_ranges,
    component_average,
    component_series,
    compliant_joined,
    series_all_components,
    series_all_patients,
)
from custos.plans.isolation import PolicyViolation, check_query
from custos.plans.policy import Envelope, base_query, policy_request, policy_session, run_policy

__all__ = [
    "Envelope",
    "PolicyViolation",
    "average_by_age_ranges",
    "average_by_components_and_ranges",
    "base_query",
    "check_query",
    "component_average",
    "component_series",
    "compliant_joined",
    "policy_request",
    "policy_session",
    "run_policy",
    "series_all_components",
    "series_all_patients",
]
