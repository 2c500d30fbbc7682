"""Blood-test component names → columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

# The naming rule of the blood_tests table.
# "cholesterol" is stored as "cholesterol_total_value"; every other component
# is stored as "<component>_value", with "." written as "_" in the column.
CHOLESTEROL = "cholesterol"
CHOLESTEROL_COLUMN = "cholesterol_total_value"
VALUE_SUFFIX = "_value"
# Component names are letters, digits, "_" and "." (as in "cholesterol.hdl", "17_oh_progesterone"),
# so a name can never change the meaning of the query text it is put in.
_NAME = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*")


def policy_component_column(component: str) -> str:
    """Column name as written in the query sent to the policy engine (dots kept)."""
    if not component or not _NAME.fullmatch(component):
        raise ValueError(f"not a component name: {component!r}")
    if component == CHOLESTEROL:
        return CHOLESTEROL_COLUMN
    return component + VALUE_SUFFIX


def component_column(component: str) -> str:
    """Column name of a component in the compliant data (dots become ``_``)."""
    return policy_component_column(component).replace(".", "_")


def resolve_component(columns: Sequence[str], component: str, case_sensitive: bool = False) -> str:
    """The component's column in the frame's own spelling.

    Names are compared as Spark SQL compares them: without case unless
    ``spark.sql.caseSensitive`` is on (then pass ``case_sensitive``). An
    exact match goes first.
    """
    name = component_column(component)
    if name in columns:
        return name
    found = [] if case_sensitive else [c for c in columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"component {component!r} has no single column {name!r}; columns are {list(columns)}")
    return found[0]


def value_columns(columns: Sequence[str]) -> list[str]:
    """All component columns of a wide blood-test frame, in frame order."""
    return [c for c in columns if c.endswith(VALUE_SUFFIX)]
