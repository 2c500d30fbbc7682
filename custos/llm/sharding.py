"""Resharding by minimum-cost flow.

Old shards hold some bytes, new shards may take some: the flow with the
fewest moved bytes says how many bytes go from each old shard to each new
one (keeping a byte in the shard of the same number is free). The flow runs
on the driver over shard sizes only (``old + new`` nodes). Documents are laid
out per old shard in blocks of one size class, largest first, so the cuts
between transfers fall among small documents; a document goes where its
middle byte goes. New shards differ from their capacity by about one
document at each cut.

Nulls and odd rows: a null text has no bytes; a null id belongs to old shard
0; repeated rows are separate documents; equal rows may change places with
each other. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import discard, packed, stored

ROW_OVERHEAD = 8
# Documents aimed at per block of an old shard.
BLOCK_ROWS = 1_000_000
LEAST_BUCKETS = 8


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def equal_capacities(total: int, n: int) -> list[int]:
    """``n`` capacities that add up to ``total``, at most one apart."""
    return [total // n + (i < total % n) for i in range(n)]


def min_cost_transfers(old: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int, int]]:
    """``(old, new, bytes)`` moving all bytes within the capacities at least cost.

    Successive shortest paths with potentials on the bipartite graph; a byte
    costs 1, or nothing where old and new shard have the same number.
    """
    if sum(capacities) < sum(old):
        raise ValueError("the new shards cannot hold all bytes")
    n_old, n_new = len(old), len(capacities)
    source, sink = n_old + n_new, n_old + n_new + 1
    arcs: list[list[int]] = []  # target, room, cost; the reverse of arc k is k ^ 1
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    for i, size in enumerate(old):
        arc(source, i, size, 0)
        for j in range(n_new):
            arc(i, n_old + j, size, int(i != j))
    for j, room in enumerate(capacities):
        arc(n_old + j, sink, room, 0)
    potential = [0] * (sink + 1)
    left = sum(old)
    while left:
        best: list[int | None] = [None] * (sink + 1)
        came = [-1] * (sink + 1)
        best[source] = 0
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > best[x]:
                continue
            for k in out[x]:
                y, room, cost = arcs[k]
                to = d + cost + potential[x] - potential[y]
                if room and (best[y] is None or to < best[y]):
                    best[y], came[y] = to, k
                    heapq.heappush(queue, (to, y))
        for x, d in enumerate(best):
            potential[x] += best[sink] if d is None or d > best[sink] else d
        step, x = left, sink
        while x != source:
            step = min(step, arcs[came[x]][1])
            x = arcs[came[x] ^ 1][0]
        x = sink
        while x != source:
            arcs[came[x]][1] -= step
            arcs[came[x] ^ 1][1] += step
            x = arcs[came[x] ^ 1][0]
        left -= step
    moved = []
    for i in range(n_old):
        for k in out[i]:
            if k % 2 == 0 and arcs[k ^ 1][1]:
                moved.append((i, arcs[k][0] - n_old, arcs[k ^ 1][1]))
    return moved


def old_shard_by_id(doc_id: Column, n_old: int) -> Column:
    """The shard a hash layout with ``n_old`` shards left a document in."""
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(n_old)).cast("int")


def reshard(docs: DataFrame, doc_id: Column, text: Column, old_shard: Column, n_old: int, n_new: int,
            capacities: Sequence[int] | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """Place every row of ``docs`` in one of ``n_new`` shards, moving the fewest bytes.

    Returns ``doc`` (a struct of the columns of ``docs``, or of those in
    ``carry``), ``size``, ``text_crc32`` (null for a null text),
    ``old_shard``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``moved``. ``capacities`` default to equal shares of all bytes.
    """
    crc = F.crc32(text.cast("binary"))
    sized = docs.select(packed(docs, carry), byte_size(text).alias("size"), crc.alias("text_crc32"),
                        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
                        F.xxhash64(doc_id.cast("string"), crc).alias("_h"))
    per_old = {r["old_shard"]: (r["size"], r["n"]) for r in
               sized.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 <= i < n_old for i in per_old):
        raise ValueError(f"old shards must lie in 0..{n_old - 1}")
    sizes = [per_old.get(i, (0, 0))[0] for i in range(n_old)]
    rows = sum(n for _, n in per_old.values())
    flow = min_cost_transfers(sizes, capacities or equal_capacities(sum(sizes), n_new))
    spans, at = [], 0
    for i in range(n_old):
        at = 0
        # what stays comes first: the largest documents
        for j, amount in sorted(((j, b) for o, j, b in flow if o == i), key=lambda x: (x[0] != i, x[0])):
            spans.append((i, j, 2 * at, 2 * (at + amount)))
            at += amount
    buckets = max(LEAST_BUCKETS, -(-rows // (n_old * BLOCK_ROWS)))
    block = ["old_shard", "_class", "_bucket"]
    laid = sized.withColumns({"_class": F.length(F.bin("size")),
                              "_bucket": F.pmod(F.col("_h"), F.lit(buckets)).cast("int")})
    within = Window.partitionBy(*block).orderBy("_h", "size")
    laid = laid.withColumns({"_rn": F.row_number().over(within).cast("long"),
                             "_end": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    laid = stored(laid, "reshard-blocks")
    blocks = laid.groupBy(*block).agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old_shard").orderBy(F.desc("_class"), "_bucket")
    blocks = blocks.withColumn("_start", F.sum("_bytes").over(before) - F.col("_bytes")).drop("_bytes")
    # twice the place of the middle byte, so halves stay whole numbers
    placed = laid.join(blocks, block).withColumn(
        "_middle", 2 * (F.col("_start") + F.col("_end")) - F.col("size"))
    plan = docs.sparkSession.createDataFrame(spans or [(0, 0, 0, 0)], "old_shard int, shard int, _lo long, _hi long")
    # at most n_old + n_new spans: the transfers of a basic flow
    placed = placed.join(F.broadcast(plan), "old_shard").filter(
        (F.col("_middle") >= F.col("_lo")) & (F.col("_middle") < F.col("_hi")))
    piece = [*block, "shard"]
    pieces = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_rn").alias("_first"))
    order = Window.partitionBy("shard").orderBy(*block)
    pieces = pieces.withColumn("_offset", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    return placed.join(pieces, piece).select(
        "doc", "size", "text_crc32", "old_shard", "shard", (F.col("_offset") + F.col("_rn") - F.col("_first")).alias("slot"),
        (F.col("old_shard") != F.col("shard")).alias("moved"))


def affected_shards(resharded: DataFrame) -> DataFrame:
    """Shards whose set of rows changes: those that lose or gain a document."""
    moved = resharded.filter("moved")
    return moved.select("shard").union(moved.select("old_shard")).distinct()


def rewrite_affected(resharded: DataFrame, path: str) -> None:
    """Replace the files of the affected shards under ``path`` (one folder ``shard=N`` each), rows in slot order.

    Files of all other shards stay as they are. ``path`` may hold the old
    layout the plan reads: the new rows are written aside first, so nothing
    is read from a folder once it is replaced. Only folders of shards with
    new rows are overwritten; folders of shards that have become empty are
    removed last. A run that is broken off leaves every document in the old
    folders or in the rows written aside, and can be repeated from the
    ``resharded`` it was given as long as that can still be read. Columns
    named ``shard`` or ``slot`` are replaced by the new ones; a ``slot`` keeps
    its type, so old and new files can be read together.
    """
    spark = resharded.sparkSession
    affected = [r["shard"] for r in affected_shards(resharded).collect()]  # at most old + new shards
    if not affected:
        return
    docs = resharded.select("doc.*").schema
    own = [f.name for f in docs if f.name.lower() not in ("shard", "slot")]
    # files of one folder keep one schema
    slot_type = next((f.dataType for f in docs if f.name.lower() == "slot"), "long")
    changed = resharded.filter(F.col("shard").isin(affected)).select(
        "shard", F.col("slot").cast(slot_type).alias("slot"), *[F.col("doc").getField(c).alias(c) for c in own])
    changed = stored(changed, "resharded")
    (changed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))
    filled = {r["shard"] for r in changed.select("shard").distinct().collect()}
    for shard in set(affected) - filled:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={shard}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    discard(changed)
