"""Session settings and the lineage-cutting folder.

The library never builds its own session in production: the caller owns it.
``recommended_conf`` lists the settings the plans are designed for; tests,
the benchmark and the driver entry use ``local_session``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def recommended_conf() -> dict[str, str]:
    """Settings the plans assume on a cluster.

    AQE re-plans joins at run time (broadcast when a shuffle stage turns out
    small, split skewed partitions of sort-merge joins) and coalesces small
    shuffle partitions, so ``spark.sql.shuffle.partitions`` can be sized for
    the largest stage instead of being fixed per query.

    ``forceOptimizeSkewedJoin``: the policy's clauses join is followed, in
    the same stage, by an aggregation or a second join on ``patientId``.
    Splitting a hot patient's partition breaks that clustering, so AQE only
    splits it when allowed to add an exchange; the exchange it adds sits
    after the map-side partial aggregation and carries one row per patient
    and split task.

    ``cleanCheckpoints``: global positions checkpoint their numbered rows;
    the files are removed once that DataFrame is no longer referenced, so a
    long-running service does not fill the shared folder.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


#: Largest runtime filter, in bits: 64 MB a task.
MOST_FILTER_BITS = 1 << 29


def runtime_filter_conf(ids: int, profile_bytes: int, least_scan_bytes: int = 10 << 30) -> dict[str, str]:
    """Settings with which Spark filters blood tests by the ids of an age range while scanning them.

    Beyond the broadcast threshold the averages join per-patient partials
    with the profiles in range. Spark then builds a Bloom filter of those
    ids (one more scan of the profiles' two columns) and applies it where
    blood tests of ``least_scan_bytes`` or more are read, below the policy's
    joins, so rows out of range are neither joined nor shuffled. ``ids`` is
    the number of ids expected in a range and ``profile_bytes`` the size of
    the profiles. The filter has 8 bits an id and :data:`MOST_FILTER_BITS`
    at most, whatever the data; with more ids than that allows it lets more
    rows through, and the join decides as before.
    """
    items = max(1, min(ids, MOST_FILTER_BITS >> 3))
    bits = min(MOST_FILTER_BITS, max(1 << 20, 8 * items))
    prefix = "spark.sql.optimizer.runtime.bloomFilter"
    return {
        f"{prefix}.enabled": "true",
        f"{prefix}.creationSideThreshold": str(profile_bytes),
        f"{prefix}.applicationSideScanSizeThreshold": str(least_scan_bytes),
        f"{prefix}.expectedNumItems": str(items),
        f"{prefix}.maxNumItems": str(max(items, 4_000_000)),
        f"{prefix}.numBits": str(bits),
        f"{prefix}.maxNumBits": str(max(bits, 67_108_864)),
    }


def sizing_conf(input_bytes: int, total_cores: int, shuffle_bytes_per_partition: int = 1 << 30) -> dict[str, str]:
    """Shuffle settings for a run reading ``input_bytes`` on ``total_cores`` cores.

    The queries shuffle projected columns, per-patient partials or distinct
    rows, well under their input, so the initial partition count assumes
    about 1 GB of input per shuffle partition, at least two per core; AQE
    then coalesces toward 256 MB partitions. Scan splits stay at 128 MB so a
    task's input fits in executor memory.
    """
    partitions = max(2 * total_cores, -(-input_bytes // shuffle_bytes_per_partition))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "custos", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = recommended_conf()
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (``local[...]``), so a local folder is shared."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return spark.sparkContext.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; the
    library only reads it. ``allow_local`` is for tests and local runs, where
    an unset folder is replaced by a fresh one under ``/tmp``.
    """
    found = checkpoint_dir(spark)
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not allow_local:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; set it to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="custos-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the session's checkpoint folder and read back: lineage is cut, nothing is recomputed."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
