"""Exact top-k inner-product search with KD-trees per shard.

Vectors are dealt to shards of bounded size; each shard builds a KD-tree of
median splits along its widest dimension, with tight bounding boxes. For a
query, a box bounds the inner product of everything inside from above; nodes
are taken best bound first, and the search of a shard ends when the best
bound left is below the query's k-th score. Queries travel in blocks: a
block searches one shard first, and the k-th scores found there prune its
search of all others. The lists of all shards are merged by rank.

The query set is a stated part of the rows; it meets the rows block by
shard, so work grows with both, and nothing is broadcast.

Nulls and odd rows: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; repeated rows (same id and
vector) count once; a query never finds rows of its own id; ties go to the
smaller id; only vectors of the query's dimension are found; scores beyond
64 bits are cut to them; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF = 256
#: Inner products up to here are whole numbers in double precision.
EXACT = 1 << 53


@dataclass(frozen=True)
class Tree:
    """Vectors in leaf order and nodes with tight boxes; a leaf has no children (-1)."""

    ids: np.ndarray
    vectors: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.lexsort((ids,))
        nodes: list[list] = []  # begin, end, left, right, low, high
        todo = [(0, len(ids), None, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            part = vectors[order[begin:end]]
            low, high = part.min(0), part.max(0)
            if parent is not None:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([begin, end, -1, -1, low, high])
            spread = high - low
            widest = int(np.argmax(spread))
            if end - begin > leaf and spread[widest] > 0:
                half = (end - begin) // 2
                by = np.argsort(part[:, widest], kind="stable")
                order[begin:end] = order[begin:end][by]
                me = len(nodes) - 1
                todo += [(begin, begin + half, me, 0), (begin + half, end, me, 1)]
        begin, end, left, right, low, high = (np.array(x) for x in zip(*nodes))
        return cls(ids[order], vectors[order], begin, end, left, right, low, high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product each node's box allows with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, ids)`` of at most ``k`` vectors that score ``kth`` or more, best first; ties to smaller ids."""
        scores, ids = self.vectors[:0, 0], self.ids[:0]
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], int(child)))
                continue
            part = slice(self.begin[node], self.end[node])
            found = self.vectors[part] @ query
            good = np.flatnonzero((found >= kth) & (self.ids[part] != own))
            if len(good):
                scores = np.concatenate([scores, found[good]])
                ids = np.concatenate([ids, self.ids[part][good]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
        return scores, ids


def quantized(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: doubles where every inner product is exact in them, else Python integers."""
    out = np.floor(values.astype(np.float64) * scale)
    if len(out) and np.abs(out).max() ** 2 * out.shape[1] >= EXACT:
        # products of huge doubles may overflow: scale exactly
        return np.array([[int(x) for x in row] for row in out.tolist()], dtype=object)
    return out


def _packed(rows: DataFrame, keys: list[str], tree: bool, scale: int) -> DataFrame:
    """One row per ``keys`` with all its vectors: a pickled tree, or ids and vectors of a query block."""

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy().astype(np.int64)
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = quantized(flat.reshape(len(ids), -1), scale)
        data = Tree.of(ids, vectors) if tree else (ids, vectors)
        return pa.table({k: group.column(k).slice(0, 1) for k in keys} | {"data": pa.array([pickle.dumps(data)], pa.binary())})

    schema = ", ".join(f"{k} int" for k in keys) + ", data binary"
    return rows.groupBy(*keys).applyInArrow(pack, schema)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Every (block, shard) row searched: ``dim, block, found`` with the pickled ``(query row, scores, ids)``.

    ``pairs`` has ``dim, block, shard, queries, tree`` and the k-th scores known so far (``kth``, may be null).
    """

    def run(group: pa.Table) -> pa.Table:
        tree: Tree = pickle.loads(group.column("tree")[0].as_py())
        own, queries = pickle.loads(group.column("queries")[0].as_py())
        known = group.column("kth")[0].as_py()
        kth = pickle.loads(known) if known else np.full(len(own), -np.inf)
        if tree.vectors.dtype == object or queries.dtype == object or \
                float(np.abs(tree.vectors).max()) * float(np.abs(queries).max()) * queries.shape[1] >= EXACT:
            queries = np.array([[int(x) for x in row] for row in queries.tolist()], dtype=object)
            whole = lambda a: np.array([[int(x) for x in row] for row in a.tolist()], dtype=object)
            tree = Tree(tree.ids, whole(tree.vectors), tree.begin, tree.end, tree.left, tree.right, whole(tree.low),
                        whole(tree.high))
        bounds = tree.bounds(queries)
        at, all_scores, all_ids, best = [], [], [], kth.copy()
        for i in range(len(own)):
            scores, ids = tree.search(queries[i], own[i], bounds[i], k, kth[i])
            at += [i] * len(ids)
            all_scores += [int(s) for s in scores]
            all_ids += ids.tolist()
            if len(ids) == k:
                best[i] = max(best[i], scores[-1])
        found = pickle.dumps((np.array(at, np.int64), all_scores, np.array(all_ids, np.int64), best))
        return pa.table({"dim": group.column("dim").slice(0, 1), "block": group.column("block").slice(0, 1),
                         "found": pa.array([found], pa.binary())})

    return pairs.groupBy("dim", "block", "shard").applyInArrow(run, "dim int, block int, found binary")


def top_k(rows: DataFrame, vec_id: Column, vector: Column, is_query: Column, k: int = 20, scale: int = 64,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the highest inner products of each query row.

    Components are quantized to ``floor(scale * x)``; scores are whole numbers.
    """
    values = rows.select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v"),
                         F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = values.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    values = values.groupBy("vec_id", "v").agg(F.max("asks").alias("asks")).withColumn("dim", F.size("v"))
    values = stored(values, "vectors")
    n = values.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("queries")).first()
    shards, blocks = max(1, -(-n["rows"] // shard_rows)), max(1, -(-n["queries"] // block_queries))
    spread = F.xxhash64("vec_id", "v")
    trees = stored(_packed(values.select("dim", F.pmod(spread, F.lit(shards)).cast("int").alias("shard"), "vec_id", "v"),
                           ["dim", "shard"], True, scale).withColumnRenamed("data", "tree"), "trees")
    asked = values.filter("asks").select("dim", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    asked = stored(_packed(asked, ["dim", "block"], False, scale).withColumnRenamed("data", "queries"), "query-blocks")
    home = F.pmod(F.col("block"), F.lit(shards))
    first = asked.withColumns({"shard": home, "kth": F.lit(None).cast("binary")}).join(trees, ["dim", "shard"])
    first = stored(_search(first, k), "home-shards")

    @F.arrow_udf("binary")
    def kth_scores(found: pa.Array) -> pa.Array:
        return pa.array([pickle.dumps(pickle.loads(x.as_py())[3]) if x.is_valid else None for x in found], pa.binary())

    known = asked.join(first.select("dim", "block", kth_scores("found").alias("kth")), ["dim", "block"], "left")
    others = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
    rest = stored(_search(others.join(trees, ["dim", "shard"]), k), "other-shards")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, found in zip(batch.column(0), batch.column(1)):
                own, _ = pickle.loads(queries.as_py())
                at, scores, ids, _ = pickle.loads(found.as_py())
                limit = (1 << 63) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array(ids), pa.array([min(max(s, -limit - 1), limit) for s in scores], pa.int64())],
                    names=["query_id", "vec_id", "score"])

    lists = first.union(rest).join(asked, ["dim", "block"]).select("queries", "found")
    lists = lists.mapInArrow(unpack, "query_id long, vec_id long, score long")
    # a query has at most k rows a shard
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
