"""DataFrame → DataFrame building blocks of the clinical queries."""

from custos.operators.aggregate import (
    age_bounds,
    age_partials,
    age_range_frame,
    average_from_partials,
    join_age_ranges,
    range_ages,
    subject_partials,
    suppress_empty,
)
from custos.operators.filters import drop_all_null, filter_birth_range, filter_equals
from custos.operators.join import bounded_rows, broadcast_if_small, join_subject, measured_size, restrict_to_subjects
from custos.operators.ordering import distinct_rows, sort_series, with_position
from custos.operators.output import json_lines
from custos.operators.projection import drop_subject, project_component, rename_to_value

__all__ = [
    "age_bounds",
    "age_partials",
    "age_range_frame",
    "average_from_partials",
    "bounded_rows",
    "broadcast_if_small",
    "distinct_rows",
    "drop_all_null",
    "drop_subject",
    "filter_birth_range",
    "filter_equals",
    "join_age_ranges",
    "join_subject",
    "json_lines",
    "measured_size",
    "project_component",
    "range_ages",
    "rename_to_value",
    "restrict_to_subjects",
    "sort_series",
    "subject_partials",
    "suppress_empty",
    "with_position",
]
