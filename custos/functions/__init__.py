"""Column expressions and small driver-side helpers."""

from custos.functions.columns import quoted
from custos.functions.components import (
    component_column,
    policy_component_column,
    resolve_component,
    value_columns,
)
from custos.functions.dates import birth_date_bounds, birth_date_bounds_col, years_before
from custos.functions.json import row_json
from custos.functions.predicates import any_not_null, in_open_range, literal_like

__all__ = [
    "any_not_null",
    "birth_date_bounds",
    "birth_date_bounds_col",
    "component_column",
    "in_open_range",
    "literal_like",
    "policy_component_column",
    "quoted",
    "resolve_component",
    "row_json",
    "value_columns",
    "years_before",
]
