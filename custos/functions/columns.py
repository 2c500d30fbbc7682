"""Column references by name, safe for dots and backticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """``F.col`` for a plain column name that may contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")
