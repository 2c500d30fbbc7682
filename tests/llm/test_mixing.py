import random

import pytest
from pyspark.sql import functions as F

from custos.llm import mixing
from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


def water_filling(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing; ``sizes`` in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, stopped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        rest = total - sum(most * sizes[i] for i in stopped)
        target = [most * s for s in sizes]
        for i in free:
            target[i] = rest * w[i] / sum(w[j] for j in free)
        over = [i for i in free if target[i] > most * sizes[i] + 1e-9]
        if not over:
            return target
        stopped |= set(over)


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 100_000]) for i in range(rng.randrange(1, 12))}
    names = [*sorted(sizes), None]
    sizes[None] = 77
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    targets = {r["source"]: r["target"] for r in got}
    for name, wanted in zip(names, water_filling([sizes[n] for n in names])):
        assert targets[name] == pytest.approx(wanted, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("seed", range(8))
def test_apportionment_is_sainte_lague(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0.0, rng.random(), rng.random() * 300, 40.0]) for _ in range(rng.randrange(1, 15))]
    seats = [0] * len(votes)
    total = sum(votes)
    for _ in range(int(total + 0.5)):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    got = mixing.apportion(spark.createDataFrame(list(enumerate(votes)), "k int, v double"), "v", "k").collect()
    assert [r["seats"] for r in sorted(got, key=lambda r: r["k"])] == seats


def mixed(docs, **kw):
    return mixing.mix(docs, docs["doc_id"], docs["source"], mixing.word_count(docs["text"]), **kw)


def test_mix_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = mixed(docs).collect()
    assert sorted(r["doc"]["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    per = {}
    for r in rows:
        assert r["size"] == len((r["doc"]["text"] or "").encode().split())
        assert 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3
        own = per.setdefault(r["doc"]["source"], [0, 0, r["source_size"], r["target"]])
        own[0] += r["size"]
        own[1] += r["taken"]
    names = sorted(per)
    wanted = water_filling([per[n][0] for n in names])
    for name, target in zip(names, wanted):
        size, taken, source_size, got = per[name]
        assert size == source_size and got == pytest.approx(target)
        assert abs(taken - target) <= max(64, 0.03 * target)
    again = mixed(docs).collect()
    assert sorted((r["doc"]["doc_id"], r["taken"]) for r in rows) == sorted((r["doc"]["doc_id"], r["taken"]) for r in again)


def test_whole_table_against_sql(spark, duck):
    wanted = duck.sql(ORACLE_SQL["op9_sainte_lague_mix"])
    got = QUERIES["op9_sainte_lague_mix"](spark, SF001)
    assert got.columns == wanted.columns and sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_odd_rows(odd, none):
    rows = mixed(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 and r["copies"] == 0 for r in rows if not (r["doc"]["text"] or "").split())
    assert {r["doc"]["source"] for r in rows} == {"a", "b", "c", None}
    assert mixed(odd).select("doc.*").columns == odd.columns
    assert mixed(none).count() == 0


def test_no_python_in_the_plan(odd):
    text = mixed(odd)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_a_hot_source_is_spread(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c d").alias("text"))
    rows = mixed(docs).groupBy("quota", "blocks").count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 4000
