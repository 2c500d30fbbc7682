import random
import zlib

import pytest
from pyspark.sql import functions as F

from custos.llm import sharding
from tests.llm.conftest import SF001


@pytest.mark.parametrize("seed", range(20))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    old = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 7))]
    if seed % 2:
        capacities = sharding.equal_capacities(sum(old), rng.randrange(1, 9))
    else:
        capacities = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 7))] + [sum(old)]
    flow = sharding.min_cost_transfers(old, capacities)
    assert [sum(b for o, _, b in flow if o == i) for i in range(len(old))] == old
    assert all(sum(b for _, n, b in flow if n == j) <= c for j, c in enumerate(capacities))
    moved = sum(b for o, n, b in flow if o != n)
    least = sum(max(0, size - (capacities[i] if i < len(capacities) else 0)) for i, size in enumerate(old))
    assert moved == least


def test_flow_needs_room():
    with pytest.raises(ValueError):
        sharding.min_cost_transfers([5], [4])


def placed(docs, n_old=4, n_new=6, **kw):
    return sharding.reshard(docs, docs["doc_id"], docs["text"], sharding.old_shard_by_id(docs["doc_id"], n_old), n_old,
                            n_new, **kw)


def test_reshard_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = placed(docs, 5, 7).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc"]["doc_id"] for r in rows) == sorted(texts)
    sizes, slots = {}, {}
    for r in rows:
        raw = texts[r["doc"]["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["old_shard"] == zlib.crc32(str(r["doc"]["doc_id"]).encode()) % 5
        assert r["moved"] == (r["old_shard"] != r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 7
    assert max(abs(s - mean) for s in sizes.values()) <= max(r["size"] for r in rows)
    again = placed(docs, 5, 7).collect()
    assert sorted((r["doc"]["doc_id"], r["shard"], r["slot"]) for r in rows) == \
        sorted((r["doc"]["doc_id"], r["shard"], r["slot"]) for r in again)


def test_odd_rows(odd, none):
    rows = placed(odd).collect()
    assert len(rows) == odd.count()
    null = next(r for r in rows if r["doc"]["doc_id"] == 2)
    assert null["size"] == 8 and null["text_crc32"] is None
    assert next(r for r in rows if r["doc"]["doc_id"] is None)["old_shard"] == 0
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert placed(odd).select("doc.*").columns == odd.columns
    assert placed(none).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 92) for i in range(40)], "doc_id long, text string")
    old = (docs["doc_id"] % 4).cast("int")
    resharded = sharding.reshard(docs, docs["doc_id"], docs["text"], old, 4, 5, capacities=[1000, 1000, 1000, 600, 400])
    assert {r["shard"] for r in sharding.affected_shards(resharded).collect()} == {3, 4}
    sharding.rewrite_affected(resharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect() == [(3, 6), (4, 4)]


def test_rewriting_in_place_loses_nothing(spark, tmp_path):
    """All old shards in one folder, read by the plan and replaced where they change; one shard becomes empty."""
    import os

    path = str(tmp_path / "layout")
    docs = spark.createDataFrame([(i, "x" * 92, 7) for i in range(40)], "doc_id long, text string, slot int")
    docs.withColumn("shard", (docs["doc_id"] % 4).cast("int")).write.partitionBy("shard").parquet(path)
    layout = spark.read.parquet(path)
    for capacities, affected in (([1000, 1000, 1000, 600, 400], {3, 4}), ([1400, 1300, 1300, 0, 0], {0, 1, 2, 3, 4})):
        before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("shard=")}
        layout = spark.read.parquet(path)
        resharded = sharding.reshard(layout, layout["doc_id"], layout["text"], layout["shard"], 5, 5, capacities=capacities)
        want = {(r["doc"]["doc_id"], r["shard"]) for r in resharded.collect()}
        sharding.rewrite_affected(resharded, path)
        back = spark.read.parquet(path)
        rows = back.collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(40))
        assert {(r["doc_id"], r["shard"]) for r in rows} == want
        after = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("shard=")}
        untouched = {f for f in before if before[f] == after.get(f)}
        assert untouched == {f for f in before if int(f.split("=")[1]) not in affected}
        assert set(after) == {f"shard={s}" for _, s in want}
        for shard in {s for _, s in want} & affected:
            slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert slots == list(range(len(slots)))
