"""Small files of any Hadoop file system: lists, and text that appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of what a glob pattern matches, in path order."""
    path = _path(spark, pattern)
    found = _system(spark, path).globStatus(path) or []
    return sorted((str(f.getPath()), f.getLen()) for f in found)


def read_text(spark: SparkSession, path: str) -> str:
    at = _path(spark, path)
    stream = _system(spark, at).open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it there: readers see all of it or nothing."""
    aside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    system = _system(spark, aside)
    out = system.create(aside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(aside, _path(spark, path)):
        raise OSError(f"could not publish {path}")


def delete(spark: SparkSession, path: str) -> None:
    at = _path(spark, path)
    _system(spark, at).delete(at, True)
