"""Results → JSON text (O23) and sinks."""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.functions.columns import quoted
from custos.functions.json import row_json
from custos.operators.ordering import with_position
from custos.session import written
from custos.sources.files import matching, publish_text, read_text

JSON = "json"
PART = "part"
# Elements per JSON array part: the largest group any task assembles.
DEFAULT_PART_SIZE = 1000
_RANK = "_rank"
_FIRST = "_first"
_ELEMENT = "_element"


def json_lines(df: DataFrame, name: str = JSON) -> DataFrame:
    """One JSON object per row, as a string column; stays distributed."""
    return df.select(row_json(*df.columns).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as JSON lines (one object per row, null fields left out)."""
    df.write.mode(mode).json(path)


def json_array_parts(df: DataFrame, order: list, keys: tuple[str, ...] = (), part_size: int = DEFAULT_PART_SIZE,
                     name: str = JSON) -> DataFrame:
    """JSON arrays of ``df``'s rows per ``keys``, in order, split into parts.

    Returns ``(*keys, part, json)``: ``json`` is the JSON array of elements
    ``part * part_size`` up to ``part * part_size + part_size - 1`` of the
    key's rows in ``order`` (one object per row, key columns left out, null
    fields omitted). Concatenating the parts' elements in ``part`` order gives
    the whole array; a key with at most ``part_size`` rows has one part that
    is the whole array.

    No group is larger than ``part_size``: ranks come from a global range
    sort (:func:`custos.operators.ordering.with_position`), and the rank
    inside a key is the global position minus the key's first position. Keys
    are matched null-safely, so rows with a null key form arrays too. First
    positions are written out before they are joined back, so both sides of
    that join are plain shuffles, which AQE splits where one key is hot; rows
    are then dealt by key and part, so a hot key's parts are built by many
    tasks. The JSON text is made last.
    """
    if part_size < 1:
        raise ValueError("part_size must be positive")
    values = [c for c in df.columns if c not in keys]
    ranked = with_position(df, [*(quoted(k).asc_nulls_first() for k in keys), *order], _RANK)
    if keys:
        named = {k: f"_key{i}" for i, k in enumerate(keys)}
        first = ranked.groupBy(*[quoted(k).alias(n) for k, n in named.items()]).agg(F.min(_RANK).alias(_FIRST))
        first = written(first, "first-positions")
        same = reduce(and_, [quoted(k).eqNullSafe(F.col(n)) for k, n in named.items()])
        ranked = ranked.join(first, same).withColumn(_RANK, F.col(_RANK) - F.col(_FIRST)).drop(_FIRST, *named.values())
    else:
        ranked = ranked.withColumn(_RANK, F.col(_RANK) - F.lit(1))
    parts = ranked.withColumn(PART, F.expr(f"{_RANK} div {int(part_size)}"))
    by = [*(quoted(k) for k in keys), F.col(PART)]
    items = F.struct(F.col(_RANK), F.struct(*[quoted(c) for c in values]).alias(_ELEMENT))
    grouped = parts.repartition(*by).groupBy(*by).agg(F.array_sort(F.collect_list(items)).alias("_items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda item: F.to_json(item[_ELEMENT])), ","), F.lit("]"))
    return grouped.select(*by, text.alias(name))


def write_json_array(df: DataFrame, order: list, folder: str) -> dict:
    """Write ``df`` as one JSON array of any size: files in order, and a manifest that names them.

    One element a line; the first line begins with ``[``, all others with a
    comma, the last ends with ``]`` (``[]`` alone for no rows), so the files
    put together in the manifest's order are the array. Rows are ordered by a
    range sort and every task writes its stretch: no task holds more.

    A run writes into a folder of its own and publishes its manifest last, by
    renaming it into place. Until then readers see the array before it; a run
    that is broken off is never seen. ``order`` must be total. Returns the
    manifest: ``files`` (relative to ``folder``, with bytes) and ``elements``.
    """
    spark = df.sparkSession
    folder = folder.rstrip("/")
    ranked = with_position(df, order, _RANK)
    total = ranked.count()
    run = f"run-{uuid.uuid4().hex}"
    if total:
        head = F.when(F.col(_RANK) == 1, F.lit("[")).otherwise(F.lit(","))
        tail = F.when(F.col(_RANK) == total, F.lit("]")).otherwise(F.lit(""))
        lines = ranked.select(_RANK, F.concat(head, row_json(*df.columns), tail).alias("line"))
        lines.sortWithinPartitions(_RANK).select("line").write.text(f"{folder}/{run}")
    else:
        spark.range(1).select(F.lit("[]")).coalesce(1).write.text(f"{folder}/{run}")
    files = sorted(matching(spark, f"{folder}/{run}/part-*"), key=lambda f: _task_order(f[0]))
    files = [{"path": f"{run}/{os.path.basename(path)}", "bytes": size} for path, size in files if size]
    manifest = {"elements": total, "files": files}
    number = 1 + max((int(m.group(1)) for m in map(_MANIFEST.search, _manifests(spark, folder)) if m), default=-1)
    publish_text(spark, f"{folder}/manifest-{number:012d}.json", json.dumps(manifest))
    return manifest


_MANIFEST = re.compile(r"manifest-(\d+)\.json$")


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    return [path for path, _ in matching(spark, f"{folder}/manifest-*.json")]


def _task_order(path: str) -> tuple[int, ...]:
    """A part file's task and number in it, as numbers: names are padded to five digits only."""
    name = os.path.basename(path)
    task = re.match(r"part-(\d+)", name)
    number = re.search(r"-c(\d+)", name)
    return int(task.group(1)), int(number.group(1)) if number else 0


def json_array_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest published last in ``folder``; its ``files`` in order are the array."""
    found = _manifests(spark, folder.rstrip("/"))
    if not found:
        raise ValueError(f"no array published in {folder}")
    return json.loads(read_text(spark, found[-1]))


def json_array_elements(spark: SparkSession, folder: str, name: str = JSON) -> DataFrame:
    """The elements of the array published last, one a row (in no order)."""
    files = [f"{folder.rstrip('/')}/{f['path']}" for f in json_array_manifest(spark, folder)["files"]]
    line = F.regexp_replace("value", r"^[\[,]", "")
    # a ] that ends the array follows the } of its last element
    return spark.read.text(files).select(F.regexp_replace(line, r"(^|\})\]$", "$1").alias(name)).filter(F.col(name) != "")
