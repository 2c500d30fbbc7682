"""Table sources: a catalog of logical names and the readers behind it."""

from custos.sources.catalog import (
    TableSpec,
    find_bounds,
    jdbc_options,
    load_table,
    register_tables,
    view_name,
)
from custos.sources.layout import write_bucketed, write_by_date, write_point_lookup, write_split
from custos.sources.settings import catalog_from_settings

__all__ = ["TableSpec", "catalog_from_settings", "find_bounds", "jdbc_options", "load_table", "register_tables", "view_name",
           "write_bucketed", "write_by_date", "write_point_lookup", "write_split"]
