"""Table layouts: joins without a shuffle, hot patients apart, point lookups and date ranges that skip files.

**Bucketed.** Blood tests, clauses and profiles are all joined on
``patientId``. Written as metastore tables bucketed (and sorted) by it with
the same bucket count, Spark reads matching buckets into the same task, and
both the policy's clauses join and the profile join run as sort-merge joins
without an exchange, which removes the largest shuffle of every query.
Register them in a catalog with ``TableSpec.table(name)``. Spark allows
``spark.sql.sources.bucketing.maxBuckets`` buckets (100 000 unless raised),
so buckets of a 100 TB table hold about 1 GB at least.

**Split.** A patient's rows share one bucket, and a plan without an exchange
gives AQE nothing to split: one patient with a third of the rows is one task
with a third of the rows. :func:`write_split` keeps patients above a share of
the rows in an unbucketed table of their own (there are at most ``1 / share``
of them); ``TableSpec.split(name)`` reads both as one, and the queries over
joined patients run the cold part by bucket and the hot part with the few
matching rows of the other tables (:mod:`custos.plans.parts`).

**Point lookup.** A table that arrives in no order has every patient's range
in every row group, so minimum and maximum skip nothing.
:func:`write_point_lookup` writes small row groups with a Bloom filter of the
key each; reading one patient opens only the row groups that may hold it.

**By date.** :func:`write_by_date` partitions by the date of the test; a
policy that bounds the date reads those partitions only, and one that joins a
table of dates prunes by what that table holds when the query runs. New
component columns may appear in later files: read with
``TableSpec.parquet(path, mergeSchema="true")``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.constants import DATE, SUBJECT_ID
from custos.functions.columns import quoted
from custos.sources.catalog import HOT_KEYS, HOT_ROWS

def largest_key_share(df: DataFrame, key: str = SUBJECT_ID) -> float:
    """Share of all rows that the most frequent non-null key holds (0 for an empty table).

    One count per key, combined before the shuffle; one row reaches the driver.
    """
    counts = df.groupBy(quoted(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.sum("_n"), F.max(F.when(F.col("_key").isNotNull(), F.col("_n")))).first()
    return (row[1] or 0) / row[0] if row[0] else 0.0


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = SUBJECT_ID, mode: str = "errorifexists",
                   path: str | None = None, largest_share: float | None = None) -> None:
    """Save ``df`` as a table bucketed and sorted by ``key``, one file a bucket.

    Rows are first dealt to the buckets by one shuffle, so each bucket is
    written by one task; without it every task would write a file for every
    bucket. Use one bucket count for all tables joined together. With
    ``largest_share`` the table is refused when one key holds a larger share
    of the rows: such a key makes a bucket that no plan can split.
    """
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    if not 1 <= buckets <= most:
        raise ValueError(f"buckets must be between 1 and {most} (spark.sql.sources.bucketing.maxBuckets)")
    if largest_share is not None and (share := largest_key_share(df, key)) > largest_share:
        raise ValueError(f"one {key} holds {share:.1%} of the rows: keep the table unbucketed, so its joins can be split")
    writer = df.repartition(buckets, quoted(key)).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_split(df: DataFrame, table: str, buckets: int, key: str = SUBJECT_ID, hot_share: float = 1e-4,
                mode: str = "errorifexists", hot_partitions: int | None = None, folder: str | None = None) -> list:
    """Save ``df`` bucketed by ``key``, with the keys that hold more than ``hot_share`` of the rows apart.

    Three metastore tables: ``table`` (bucketed, one file a bucket),
    ``table_hot`` (rows of the hot keys, dealt evenly to ``hot_partitions``
    files, as many as the share of the rows asks for unless given) and
    ``table_hot_keys``. Rows without a key are never joined and go to the
    evenly dealt part when they are many. Files go to the warehouse, or under
    ``folder``. Returns the hot keys: at most ``1 / hot_share``, since each
    holds more than that share.
    """
    if not 0 < hot_share < 1:
        raise ValueError("hot_share must lie between 0 and 1")
    spark = df.sparkSession
    counts = df.groupBy(quoted(key).alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    found = counts.filter(F.col("_n") > total * hot_share).collect() if total else []
    hot = [r[key] for r in found if r[key] is not None]
    many_null = any(r[key] is None for r in found)
    is_hot = F.coalesce(quoted(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    if many_null:
        is_hot = is_hot | quoted(key).isNull()
    def save(rows: DataFrame, name: str) -> None:
        writer = rows.write.mode(mode)
        if folder is not None:
            writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
        writer.saveAsTable(name)

    write_bucketed(df.filter(~is_hot), table, buckets, key, mode, None if folder is None else f"{folder.rstrip('/')}/{table}")
    parts = hot_partitions or max(1, -(-buckets * sum(r["_n"] for r in found) // max(1, total)))
    save(df.filter(is_hot).repartition(parts), table + HOT_ROWS)
    save(spark.createDataFrame([(k,) for k in hot], df.select(quoted(key).alias(key)).schema).coalesce(1), table + HOT_KEYS)
    return hot


def write_point_lookup(df: DataFrame, path: str, key: str = SUBJECT_ID, row_group_bytes: int = 8 << 20,
                       mode: str = "errorifexists") -> None:
    """Save ``df`` as Parquet with small row groups and a Bloom filter of ``key`` in each; rows stay in their order.

    An equality filter on ``key`` (or an ``IN`` of up to
    ``spark.sql.parquet.pushdown.inFilterThreshold`` values) reads the row
    groups whose filter may hold it: those that do, and about one in a
    hundred others. Filters take about 10 bits a distinct key of the group;
    a group in which the key repeats a lot keeps a dictionary instead, which
    Spark looks into the same way.
    """
    if row_group_bytes < 1:
        raise ValueError("row_group_bytes must be positive")
    (df.write.mode(mode).option("parquet.block.size", str(row_group_bytes))
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.bloom.filter.max.bytes", str(max(1024, row_group_bytes >> 2)))
     .option("parquet.page.size", str(max(1024, min(1 << 20, row_group_bytes >> 3))))
     .option("parquet.block.size.row.check.min", "100").option("parquet.block.size.row.check.max", "1000")
     .parquet(path))


def write_by_date(df: DataFrame, path: str, date: str = DATE, mode: str = "errorifexists", files_per_date: int = 1) -> None:
    """Save ``df`` as Parquet partitioned by ``date``; a null date has a partition of its own.

    A date's rows are dealt to ``files_per_date`` tasks by hash of the row, so
    a date with very many rows (null dates, say) is not one task's; equal rows
    meet in one. With ``mode="append"`` new files join the old ones, also with
    columns the old ones lack.
    """
    if files_per_date < 1:
        raise ValueError("files_per_date must be positive")
    hashable = [quoted(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    deal = F.pmod(F.xxhash64(*hashable), F.lit(files_per_date))
    df.repartition(quoted(date), deal).write.mode(mode).partitionBy(date).parquet(path)
