"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read back as the next stage's documents. All but the last return the
columns of ``documents``:

1. ``language``: whole texts without letters, or with half or more of them in
   scripts that no learned language uses, go (learned from the documents' own
   labels); a text in several learned languages stays;
2. ``near_duplicates``: one document of each class of near copies stays, the
   one with the smallest id;
3. ``decontamination``: documents that hold ten consecutive words of a
   benchmark item (or a shorter item whole) go;
4. ``mix``: every document stays as often as the mix takes its middle word
   (0 to 3 times), so each source comes near its target;
5. ``shard``: documents move from the 20-shard layout to 24 shards of equal
   bytes and get their shard and slot (columns of these names are replaced).

Nulls and odd rows, stage by stage: a null or empty text has no letters and
goes in the first stage; repeated rows are one class of copies, of which one
row stays; rows with a null id are documents like others (null ids come last
where a smallest id is chosen); a null source is a source of its own. Texts
are never cut, however long. Other columns travel along, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.llm import decontamination, langid, mixing, near_duplicates, sharding
from custos.llm.common import let_workers_import, packed, stored, table

LEAST_KNOWN_SHARE = 0.5
SHARDS = 24
OLD_SHARDS = 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, docs["text"], docs["lang"], docs["doc_id"])
    found = docs.select(packed(docs), langid.identify(docs["text"], model, spark).alias("found"))
    known = (F.col("found.lang") != langid.UNKNOWN) & (F.col("found.known") >= LEAST_KNOWN_SHARE)
    return found.filter(known).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each_class(docs, docs["doc_id"], docs["text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    found = docs.select(packed(docs), docs["text"].alias("text"))
    found = decontamination.find(found, F.col("text"), bench, bench["item_id"], bench["text"])
    return found.filter(F.size("match.spans") == 0).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, docs["doc_id"], docs["source"], mixing.word_count(docs["text"]))
    return mixed.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = sharding.reshard(docs, docs["doc_id"], docs["text"],
                              sharding.old_shard_by_id(docs["doc_id"], OLD_SHARDS), OLD_SHARDS, SHARDS)
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*own, "shard", "slot")


# No SQL: the stages hash, train and search in ways SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def _importable(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _importable(stage)) for name, stage in (
    ("language", language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
    ("mix", mix_sources), ("shard", shard))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
