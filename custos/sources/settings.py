"""A catalog from flat settings, in the layout the original service reads.

Each table is two entries: ``<name>`` holds its location (a Parquet path or
URI, or a JDBC table name) and ``<name>_type`` how to read it. JDBC tables
share one database connection given by three more entries. Parse the
configuration file with any HOCON/properties reader and pass the flat
mapping in.
"""

from __future__ import annotations

from collections.abc import Mapping

from custos.sources.catalog import TableSpec

# Setting names and table types of the original configuration.
TYPE_SUFFIX = "_type"
PARQUET_TYPES = ("s3a",)
JDBC_TYPES = ("jdbc",)
JDBC_URL = "db.mysql.url"
JDBC_USER = "db.mysql.username"
JDBC_PASSWORD = "db.mysql.password"
# Our own: reader options of one JDBC table, as <name>_jdbc.<option>.
JDBC_PREFIX = "_jdbc."


def catalog_from_settings(settings: Mapping[str, str], parquet_types: tuple[str, ...] = ("parquet",),
                          jdbc_options: Mapping[str, str] | None = None) -> dict[str, TableSpec]:
    """``{logical name: TableSpec}`` for every ``<name>`` with a ``<name>_type``.

    ``s3a`` (and any of ``parquet_types``) reads the location as Parquet
    through whatever Hadoop file system its URI names; ``jdbc`` reads the
    location as ``dbtable`` with the shared connection settings, plus
    ``jdbc_options`` and the table's own ``<name>_jdbc.<option>`` entries (for
    example ``patientsProfiles_jdbc.partitionColumn``, ``.lowerBound``,
    ``.upperBound`` and ``.numPartitions`` to read in parallel).

    Entries that describe no table are left alone: an unrelated ``*_type``
    setting, a type without a location, or a table whose connection is
    missing does not keep the other tables from being read. Such a name is
    absent from the catalog, so reading it raises; :func:`table_from_settings`
    says why.
    """
    catalog: dict[str, TableSpec] = {}
    for key in settings:
        if key.endswith(TYPE_SUFFIX):
            name = key[: -len(TYPE_SUFFIX)]
            try:
                catalog[name] = table_from_settings(settings, name, parquet_types, jdbc_options)
            except ValueError:
                continue
    return catalog


def table_from_settings(settings: Mapping[str, str], name: str, parquet_types: tuple[str, ...] = ("parquet",),
                        jdbc_options: Mapping[str, str] | None = None) -> TableSpec:
    """The table ``name``; ``ValueError`` if the settings do not say where it is and how to read it."""
    for key in (name, name + TYPE_SUFFIX):
        if key not in settings:
            raise ValueError(f"table {name}: {key} is not set")
    kind, location = str(settings[name + TYPE_SUFFIX]).strip(), str(settings[name]).strip()
    if kind in PARQUET_TYPES or kind in parquet_types:
        return TableSpec.parquet(location)
    if kind not in JDBC_TYPES:
        raise ValueError(f"unrecognized table type {kind!r} for {name}")
    missing = [k for k in (JDBC_URL, JDBC_USER, JDBC_PASSWORD) if k not in settings]
    if missing:
        raise ValueError(f"jdbc table {name} needs {missing}")
    prefix = name + JDBC_PREFIX
    own = {k[len(prefix):]: str(v) for k, v in settings.items() if k.startswith(prefix)}
    return TableSpec.jdbc(location, settings[JDBC_URL], user=settings[JDBC_USER], password=settings[JDBC_PASSWORD],
                          **{**dict(jdbc_options or {}), **own})
