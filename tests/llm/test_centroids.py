import hashlib
import random

import numpy as np
import pytest

from custos.llm import centroids
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001

SCHEMA = "vec_id long, embedding array<double>, cluster int, block long, x string"


def brute(rows, k=8, rounds=10, scale=1024, dims=64, seed=3):
    """Everything scanned against everything, in Python's whole numbers."""
    kept = [(i, [int(np.floor(c * scale)) for c in e]) for i, e in rows
            if e is not None and len(e) == dims and all(c is not None and np.isfinite(c) for c in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [x for _, x in order[:k]]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centers] for _, x in kept]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        own = nearest()
        for c in range(len(centers)):
            mine = [x for (_, x), (o, _) in zip(kept, own) if o == c]
            if mine:
                centers[c] = [sum(v) // len(mine) for v in zip(*mine)]
    own = nearest()
    inertia = [sum(d for o, d in own if o == c) for c in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, o, d, inertia[o], sum(inertia), digest[o]) for (i, _), (o, d) in zip(kept, own)), key=str)


def run(df, **options):
    assigned, centers, scanned = centroids.cluster(df, df["vec_id"], df["embedding"], **options)
    rows = centroids.with_inertia(assigned, centers).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str), scanned


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_heap_centroids"](spark, SF001).collect()), key=str)
    assert got == brute([(i, [float(np.float32(c)) for c in e]) for i, e in rows])


def test_small_blocks_ties_and_empty_clusters(spark):
    rng = random.Random(5)
    # a coarse grid: many equal distances, many equal vectors
    rows = [(i % 90, [float(rng.randrange(-2, 3)) for _ in range(3)], 1, 2, "y") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, _ = run(df, k=12, rounds=4, scale=2, dims=3, block_vectors=7)
    assert got == brute([r[:2] for r in rows], k=12, rounds=4, scale=2, dims=3)


def test_settled_vectors_are_not_scanned_again(spark):
    rng = random.Random(6)
    rows = [(i, [(i % 4) * 100.0 + rng.random(), (i % 3) * 50.0 + rng.random()], 0, 0, "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, scanned = run(df, k=12, rounds=8, scale=16, dims=2, block_vectors=50)
    assert got == brute([r[:2] for r in rows], k=12, rounds=8, scale=16, dims=2)
    assert scanned[0] == 600 and scanned[-1] < 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, nan]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (None, [5.0, 5.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [-0.3, 4.0]), (11, [120000.5, -9.0])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    for k in (2, 20):
        assert run(df, k=k, rounds=3, dims=2)[0] == brute(rows, k=k, rounds=3, dims=2)
    assert run(df.filter("vec_id < 0"), dims=2) == ([], [])
    with pytest.raises(Exception, match="beyond"):
        run(spark.createDataFrame([(1, [1e30, 0.0], 1, 2, "x")], SCHEMA), dims=2)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-centroids.LARGEST, centroids.LARGEST, (20, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x[:5]] for p in x]
    assert centroids.squared_distances(x, x[:5]).tolist() == want
    small = x >> 8
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in small[:5]] for p in small]
    assert centroids.squared_distances(small, small[:5]).tolist() == want


def test_discarded_tables_are_gone(spark):
    import os

    from custos.llm.common import discard, stored

    kept = stored(spark.range(3).toDF("a"), "tmp")
    assert os.path.exists(kept._stored_in.removeprefix("file:"))
    discard(kept)
    assert not os.path.exists(kept._stored_in.removeprefix("file:"))
