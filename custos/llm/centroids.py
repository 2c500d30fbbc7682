"""Exact centroid clustering (Lloyd's rounds) with heap-ordered bounds.

A vector scanned against all centroids has a gap: the distance to the second
nearest minus that to its own. Each round the gap shrinks by at most what its
own centroid and the farthest-moving other one moved, so a cluster needs one
number for all its vectors, its accumulated drift, and a heap of the drifts
at which the vectors' gaps run out. A round pops the vectors whose time has
come and scans exactly those again; nobody else is looked at. Arithmetic is
on whole numbers; bounds are rounded towards scanning once too often, so the
result is that of scanning everything.

Vectors travel once: they are cut into blocks of bounded size and dealt to
partitions that are kept on the executors' disks (rebuilt from the stored
blocks if one is lost). A round moves only heaps (about 12 bytes a vector) to
their blocks and brings back, per block, what its moved vectors change in the
centroids' sums; the driver holds sums and centroids only. Heaps are written
to the shared folder each round, so a lost executor repeats one round at most.

Nulls and odd rows: vectors that are null, of another length, or hold null or
non-finite components take no part; a null id takes part but starts no
centroid while there are others; repeated rows are separate vectors; with
fewer vectors than centroids every vector starts one; a component beyond
:data:`LARGEST` after scaling raises, because a distance could pass 64 bits;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custos.llm.common import discard, stored

BLOCK_VECTORS = 4096
#: Largest scaled component: 64 squared differences of such components stay below 2**63.
LARGEST = 1 << 27
# Below this, squared distances of 64 components are whole numbers in double precision.
_EXACT = 1 << 22
_SLACK = 1e-9


def whole_vectors(vectors: DataFrame, vec_id: Column, embedding: Column, scale: int, dims: int) -> DataFrame:
    """``(vec_id, x)``: vectors of ``dims`` finite components, each as ``floor(scale * component)``."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    def whole(x: Column) -> Column:
        v = F.floor(x.cast("double") * scale)
        return F.when(F.abs(v) <= LARGEST, v).otherwise(
            F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}"))).cast("int")

    rows = vectors.select(vec_id.cast("long").alias("vec_id"), embedding.alias("e"))
    return rows.filter((F.size("e") == dims) & F.forall("e", finite)).select("vec_id", F.transform("e", whole).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    named = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [list(r["x"]) for r in named.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def vector_blocks(vectors: DataFrame, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """``(block, ids, x)`` with at most ``block_vectors`` vectors a row; ``x`` holds 32-bit components."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held, rows = [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, rows, number
            part = pa.Table.from_batches(held).combine_chunks()
            ids = part.column("vec_id").combine_chunks()
            x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            held, rows, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()])],
                names=["block", "ids", "x"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_vectors - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == block_vectors:
                    yield block()
        if rows:
            yield block()

    return vectors.mapInArrow(build, "block long, ids array<long>, x binary")


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centers."""
    if not x.size or max(np.abs(x).max(), np.abs(centers).max()) < _EXACT:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


class Members:
    """The vectors of one block: their cluster, and a heap a cluster of (drift at which the gap runs out, vector)."""

    def __init__(self, n: int, k: int) -> None:
        self.cluster = np.full(n, -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        self.scanned = 0

    def dump(self) -> bytes:
        heaps = [(np.array([key for key, _ in h]), np.array([i for _, i in h], np.int32)) for h in self.heaps]
        return pickle.dumps((self.cluster, heaps))

    @classmethod
    def load(cls, state: bytes) -> Members:
        cluster, heaps = pickle.loads(state)
        out = cls(0, 0)
        out.cluster, out.heaps = cluster, [list(zip(keys.tolist(), at.tolist())) for keys, at in heaps]
        return out

    def settle(self, x: np.ndarray, centers: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Scan the vectors whose gap has run out; return the change of every cluster's sums and count."""
        due = np.flatnonzero(self.cluster < 0).tolist()
        for heap, moved in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] <= moved:
                due.append(heapq.heappop(heap)[1])
        self.scanned = len(due)
        k = len(centers)
        change = np.zeros((k, centers.shape[1] + 1), np.int64)
        if not due:
            return change
        due = np.array(due)
        far = squared_distances(x[due], centers)
        near = far.argmin(1).astype(np.int32)  # ties: the smaller number
        upper = np.sqrt(far[np.arange(len(due)), near].astype(np.float64))
        far[np.arange(len(due)), near] = np.iinfo(np.int64).max
        lower = np.sqrt(far.min(1).astype(np.float64)) if k > 1 else np.full(len(due), np.inf)
        keys = drift[near] + (lower - upper)
        if k > 1:
            keys -= _SLACK * (1 + lower + drift[near])
        for key, c, i in zip(keys.tolist(), near.tolist(), due.tolist()):
            heapq.heappush(self.heaps[c], (key, i))
        old = self.cluster[due]
        ones = np.concatenate([x[due], np.ones((len(due), 1), np.int64)], 1)
        moved = old != near
        np.add.at(change, near[moved], ones[moved])
        gone = moved & (old >= 0)
        np.subtract.at(change, old[gone], ones[gone])
        self.cluster[due] = near
        return change


def moved_by(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much each cluster's gaps may shrink: its own centroid's way plus the longest way of another."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + _SLACK)
    others = [max(np.delete(way, c), default=0.0) for c in range(len(way))]
    return way + np.array(others)


def cluster(vectors: DataFrame, vec_id: Column, embedding: Column, k: int = 8, rounds: int = 10, scale: int = 1024,
            dims: int = 64, seed: int = 3, block_vectors: int = BLOCK_VECTORS) -> tuple[DataFrame, list[list[int]], list[int]]:
    """``(assigned, centroids, scanned)``.

    ``assigned`` has ``(vec_id, cluster, distance)`` for every whole vector
    (squared distance to its final centroid); ``scanned`` says how many
    vectors each round scanned.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, vec_id, embedding, scale, dims)
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [], []
    kept = stored(vector_blocks(whole, block_vectors), "vector-blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = kept.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    k = len(centroids)
    sums = [[0] * (dims + 1) for _ in range(k)]
    centers, drift = np.array(centroids, np.int64), np.zeros(k)
    state, scanned = None, []
    for _ in range(rounds + 1):
        before, state = state, stored(_settled(blocks, state, centers, drift, dims), "heaps")
        if before is not None:
            discard(before)
        # one row a cluster and dimension, and one for the number scanned
        changes = state.filter("change is not null").select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(
            F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        changes = {r["at"]: int(r["v"]) for r in changes}
        scanned.append(changes.pop(k * (dims + 1), 0))
        if len(scanned) > rounds:
            break
        for at, v in changes.items():
            sums[at // (dims + 1)][at % (dims + 1)] += v
        centroids = [[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids)]
        new = np.array(centroids, np.int64)
        drift, centers = drift + moved_by(centers, new), new
    assigned = stored(_assigned(blocks, state, centers, dims), "assigned")
    blocks.unpersist()
    discard(state, kept)
    return assigned, centroids, scanned


def _settled(blocks: DataFrame, state: DataFrame | None, centers: np.ndarray, drift: np.ndarray, dims: int) -> DataFrame:
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, held in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64)
                members = Members(len(x), len(centers)) if held is None else Members.load(held)
                change = members.settle(x, centers, drift)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([members.dump()]),
                     pa.array([[*change.ravel().tolist(), members.scanned] if members.scanned else None],
                              pa.list_(pa.int64()))],
                    names=["block", "state", "change"])

    return _with_state(blocks.select("block", "x"), state).mapInArrow(
        settle, "block long, state binary, change array<long>")


def _assigned(blocks: DataFrame, state: DataFrame, centers: np.ndarray, dims: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, held in zip(*(c.to_pylist() for c in batch.select(["ids", "x", "state"]).columns)):
                x, own = np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64), Members.load(held).cluster
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(own), pa.array(((x - centers[own]) ** 2).sum(1))],
                    names=["vec_id", "cluster", "distance"])

    return _with_state(blocks.select("block", "ids", "x"), state).mapInArrow(
        assign, "vec_id long, cluster int, distance long")


def _with_state(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.withColumn("state", F.lit(None).cast("binary"))
    # the blocks stay where they are: only the state side is shuffled, and built into a table by task
    return blocks.join(state.select("block", "state").hint("shuffle_hash"), "block")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    # one row a cluster
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                           T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    rows = [(c, sums.get(c, 0), sum(sums.values()), centroid_digest(x)) for c, x in enumerate(centroids)]
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(rows, schema)), "cluster")
