import numpy as np
import pytest

from custos.llm import topk
from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


def brute(rows, k, scale=64):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[(i, tuple(int(np.floor(np.float64(x) * scale)) for x in v))] = True
    out = []
    for i, q in good:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(df, k=3, **kw):
    got = topk.top_k(df, df["vec_id"], df["embedding"], df["vec_id"] % 20 == 0, k=k, **kw)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


SCHEMA = "vec_id long, embedding array<float>, dim int, v string, block int, shard int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3, 0.5) for i, v in rows], SCHEMA)


def test_whole_table_against_sql(spark, duck):
    wanted = duck.sql(ORACLE_SQL["op6_kd_tree_top_k"]).fetchall()
    got = QUERIES["op6_kd_tree_top_k"](spark, SF001)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(wanted)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_shards_blocks_and_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-2, 3, 4) / 64 * (1 if seed == 1 else 9)).astype(np.float32).tolist()) for i in range(160)]
    assert run(frame(spark, rows), k=5, shard_rows=23, block_queries=3) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []),
            (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [-1.0, -0.001]), (40, [1.0, 1.0, 1.0]), (60, [1.0, 1.0, 2.0])]
    df = frame(spark, rows)
    assert run(df, k=20) == brute(rows, 20)
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(20, [1.0])])) == []


def test_scores_beyond_double_precision(spark):
    rows = [(i, [float(2 ** 27 + i), 1.0 + i, -float(2 ** 26)]) for i in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df["vec_id"], df["embedding"], df["vec_id"] % 20 == 0, k=4, scale=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 1)


def test_tree_boxes_are_tight_and_prune():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(size=(1000, 2)) * 100)
    tree = topk.Tree.of(np.arange(1000), vectors, leaf=16)
    for node in range(len(tree.begin)):
        part = tree.vectors[tree.begin[node]:tree.end[node]]
        assert (part.min(0) == tree.low[node]).all() and (part.max(0) == tree.high[node]).all()
    query = np.array([3.0, -1.0])
    scores, ids = tree.search(query, -1, tree.bounds(query[None])[0], 5, -np.inf)
    order = np.lexsort((np.arange(1000), -(vectors @ query)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (vectors @ query)[order].tolist()
