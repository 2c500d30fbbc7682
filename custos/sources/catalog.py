"""Logical table names → DataFrames.

A catalog is a plain mapping ``name -> TableSpec`` handed to each call; there
is no global configuration. Every reader is lazy: nothing is read until an
action, and Catalyst pushes filters and column pruning into the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from custos.constants import CLAUSES

PARQUET = "parquet"
JDBC = "jdbc"
TABLE = "table"
DERIVED = "derived"
STREAM = "stream"
SPLIT = "split"
KINDS = (PARQUET, JDBC, TABLE, DERIVED, STREAM, SPLIT)
# Metastore tables of a split table besides the bucketed one, which has its name.
HOT_ROWS = "_hot"
HOT_KEYS = "_hot_keys"

# JDBC options that split one table scan into parallel range scans.
_JDBC_PARTITION_KEYS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
# Rows per round trip when none is given: bounded memory per read task.
DEFAULT_JDBC_FETCHSIZE = "10000"


@dataclass(frozen=True)
class TableSpec:
    """Where a logical table lives.

    kind:
      ``parquet``  location is any Hadoop URI (``s3a://``, ``hdfs://``, a path)
      ``jdbc``     location is the ``dbtable``; ``options`` carry ``url``,
                   ``user``, ``password`` and, to read in parallel,
                   ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``
      ``table``    location is a metastore table name (for example a table
                   bucketed by ``patientId``, which makes the joins on it
                   shuffle-free)
      ``derived``  ``build(session)`` returns the DataFrame, for tables that
                   Spark computes from other tables
      ``stream``   location is a folder of Parquet files read as a stream
                   (new files are picked up as they land); ``options`` go to
                   the stream reader (``pathGlobFilter``, ``maxFilesPerTrigger``)
      ``split``    location is a table written by
                   :func:`custos.sources.layout.write_split`: bucketed, its hot
                   keys in a table of their own; read as one table
    """

    kind: str
    location: str = ""
    # Not shown in repr: they may hold credentials.
    options: Mapping[str, str] = field(default_factory=dict, repr=False)
    build: Callable[[SparkSession], DataFrame] | None = None
    # Known schema of a parquet or stream table (DDL text or StructType):
    # skips the footer-reading job Spark otherwise runs on every read.
    schema: str | T.StructType | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown table kind {self.kind!r}; expected one of {KINDS}")
        if self.kind == DERIVED and self.build is None:
            raise ValueError("a derived table needs a build function")
        if self.kind != DERIVED and not self.location:
            raise ValueError(f"a {self.kind} table needs a location")

    @classmethod
    def parquet(cls, location: str, schema: str | T.StructType | None = None, **options: str) -> TableSpec:
        return cls(PARQUET, location, dict(options), schema=schema)

    @classmethod
    def jdbc(cls, dbtable: str, url: str, user: str | None = None,
             password: str | None = None, **options: str) -> TableSpec:
        opts = {"url": url, **options}
        if user is not None:
            opts["user"] = user
        if password is not None:
            opts["password"] = password
        return cls(JDBC, dbtable, opts)

    @classmethod
    def table(cls, name: str) -> TableSpec:
        return cls(TABLE, name)

    @classmethod
    def split(cls, name: str) -> TableSpec:
        return cls(SPLIT, name)

    @classmethod
    def derived(cls, build: Callable[[SparkSession], DataFrame]) -> TableSpec:
        return cls(DERIVED, build=build)

    @classmethod
    def stream(cls, folder: str, schema: str | T.StructType | None = None, **options: str) -> TableSpec:
        return cls(STREAM, folder, dict(options), schema=schema)


def jdbc_options(spec: TableSpec) -> dict[str, str]:
    """Reader options for a JDBC table (O2).

    Without partition options Spark reads the table in one task; with them it
    issues ``numPartitions`` range queries on ``partitionColumn``. The four
    options must come together. ``fetchsize`` defaults to 10 000 rows per
    round trip. Filters on the table (a social id, a birth-date range) are
    pushed into the database query.
    """
    if spec.kind != JDBC:
        raise ValueError(f"not a jdbc table: {spec.kind}")
    if "url" not in spec.options:
        raise ValueError("a jdbc table needs a url option")
    given = [k for k in _JDBC_PARTITION_KEYS if k in spec.options]
    if given and len(given) != len(_JDBC_PARTITION_KEYS):
        missing = sorted(set(_JDBC_PARTITION_KEYS) - set(given))
        raise ValueError(f"jdbc partitioned read needs all of {_JDBC_PARTITION_KEYS}; missing {missing}")
    return {"dbtable": spec.location, "fetchsize": DEFAULT_JDBC_FETCHSIZE,
            **{k: str(v) for k, v in spec.options.items()}}


def bounds_query(spec: TableSpec, column: str) -> str:
    """The database query for the least and largest value of ``column`` (a plain name) in a JDBC table."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column):
        raise ValueError(f"not a plain column name: {column!r}")
    return f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {spec.location}) custos_bounds"


def with_bounds(spec: TableSpec, column: str, low, high, partitions: int) -> TableSpec:
    """``spec`` read by ``partitions`` range queries on ``column`` between the bounds found.

    Without rows (null bounds) the table stays one query. Bounds only deal
    rows to the queries: values beyond them, and nulls, are read too.
    """
    if partitions < 1:
        raise ValueError("partitions must be positive")
    if low is None or high is None:
        return spec
    upper = high + 1 if isinstance(high, int) else high + dt.timedelta(days=1) if type(high) is dt.date else high
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(upper), "numPartitions": str(partitions)}
    return replace(spec, options={**spec.options, **bounds})


def find_bounds(spark: SparkSession, spec: TableSpec, column: str, partitions: int) -> TableSpec:
    """:func:`with_bounds` with the bounds the database holds now: one query that returns one row."""
    query = TableSpec(JDBC, bounds_query(spec, column),
                      {k: v for k, v in spec.options.items() if k not in _JDBC_PARTITION_KEYS})
    row = spark.read.format("jdbc").options(**jdbc_options(query)).load().first()
    return with_bounds(spec, column, row[0], row[1], partitions)


def load_table(spark: SparkSession, catalog: Mapping[str, TableSpec], name: str) -> DataFrame:
    """Read one logical table (O1–O3); raise on an unknown name."""
    try:
        spec = catalog[name]
    except KeyError:
        raise ValueError(f"table {name!r} is not in the catalog") from None
    if spec.kind == PARQUET:
        reader = spark.read if spec.schema is None else spark.read.schema(spec.schema)
        for key, value in spec.options.items():
            reader = reader.option(key, value)
        return reader.parquet(spec.location)
    if spec.kind == JDBC:
        return spark.read.format("jdbc").options(**jdbc_options(spec)).load()
    if spec.kind == TABLE:
        return spark.table(spec.location)
    if spec.kind == SPLIT:
        return spark.table(spec.location).unionByName(spark.table(spec.location + HOT_ROWS))
    if spec.kind == STREAM:
        return stream_parquet(spark, spec.location, spec.options, spec.schema)
    return spec.build(spark)


def stream_parquet(spark: SparkSession, folder: str, options: Mapping[str, str] | None = None,
                   schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet folder as a stream. File streams need a schema up front;
    unless given, it is read from the files already there, as the batch
    reader would."""
    options = dict(options or {})
    if schema is None:
        batch = spark.read
        for key in ("pathGlobFilter", "recursiveFileLookup"):
            if key in options:
                batch = batch.option(key, options[key])
        schema = batch.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(folder)


def view_name(name: str) -> str:
    """View a logical table is registered under.

    Any name that contains ``clauses`` is registered as ``clauses``: rewritten
    policy queries refer to ``clauses.<column>`` whatever table the clauses
    came from.
    """
    return CLAUSES if CLAUSES in name else name


def register_tables(session: SparkSession, catalog: Mapping[str, TableSpec],
                    names: Iterable[str]) -> dict[str, str]:
    """Register each named table as a temp view in ``session``.

    Returns ``{view: logical name}``. A name listed again is registered once.
    Two different tables mapping to one view (two clauses tables, or names
    equal but for case, as Spark compares view names) raise instead of
    silently keeping the last one.
    """
    registered: dict[str, str] = {}
    taken: dict[str, str] = {}
    for name in dict.fromkeys(names):
        view = view_name(name)
        other = taken.setdefault(view.lower(), name)
        if other != name:
            raise ValueError(f"tables {other!r} and {name!r} would both be registered as {view!r}")
        df = load_table(session, catalog, name)
        # A view lands in the session that built the DataFrame: a builder that
        # ignores the session it is given would leak the view elsewhere.
        if df.sparkSession is not session:
            raise ValueError(f"table {name!r} was not built in the session it was loaded for")
        df.createOrReplaceTempView(view)
        registered[view] = name
    return registered
