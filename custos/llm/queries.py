"""Registered queries: each operator applied to its whole test table.

The queries derive the fixed result columns from what the operators return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.llm import (centroids, chat, decontamination, langid, language_model, mixing, near_duplicates, phrases, quality,
                        sharding, substrings, suffix_dedup, topk)
from custos.llm.common import id_remainder, table

SHARDS = 24
OLD_SHARDS = 20


def op1_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from labelled documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(docs["doc_id"], 4)
    train = docs.filter(remainder != 2)
    model = langid.learn(train, train["text"], train["lang"], train["doc_id"])
    found = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
                        langid.identify(docs["text"], model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score",
                        F.size("found.spans").alias("n_spans"))


def op2_perspective_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from each participant's side; ``mask`` lists the trained stretches."""
    said = table(spark, sf_dir, "conversations")
    sides = chat.perspectives(said, said["conv_id"], said["turn"], said["role"], said["text"])
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return sides.select("conv_id", "perspective", "part", "piece", "n_messages", "n_own", "text", mask.alias("mask"))


def op3_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its path (source and language) and its host (source)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.posteriors(docs, docs["doc_id"], docs["text"], docs["source"], docs["lang"], labels, labels["doc_id"],
                              labels["quality"])


def op4_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a 20-shard hash layout moved to 24 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    placed = sharding.reshard(docs, docs["doc_id"], docs["text"], sharding.old_shard_by_id(docs["doc_id"], OLD_SHARDS),
                              OLD_SHARDS, SHARDS, carry=["doc_id"])
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op5_minhash_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: 5-word n-grams, Jaccard similarity 0.8 or more."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates.near_duplicates(docs, docs["doc_id"], docs["text"])


def op6_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"], vectors["embedding"], vectors["vec_id"] % 20 == 0, k=20, scale=64)


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document inside 10-word windows of benchmark items."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find(docs, docs["text"], bench, bench["item_id"], bench["text"], carry=["doc_id"])
    found = found.select("doc_id", F.col("match.n_words").alias("n_words"),
                         decontamination.words_hit(F.col("match.spans")).alias("n_hit"),
                         decontamination.item_ids(F.col("match.spans")).alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op8_gated_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10-probability of every whole document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    remainder = id_remainder(docs["doc_id"], 7)
    scored = language_model.score(docs, docs["doc_id"], docs["text"], remainder != 2)
    return scored.withColumn("held_out", F.coalesce(id_remainder(F.col("doc_id"), 7) == 2, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with source weights 5, 2, 1, repeating, up to 3 times a source's words."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, docs["doc_id"], docs["source"], mixing.word_count(docs["text"]), carry=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", "copies")


def op10_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document outside repeated 35-word windows."""
    docs = table(spark, sf_dir, "documents")
    return substrings.remove_repeats(docs, docs["doc_id"], docs["text"], with_text=False).drop("kept")


def op11_heap_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all 64-component vectors after ten exact rounds."""
    vectors = table(spark, sf_dir, "embeddings")
    assigned, centers, _ = centroids.cluster(vectors, vectors["vec_id"], vectors["embedding"])
    return centroids.with_inertia(assigned, centers).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_multikey_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to four words in all documents."""
    docs = table(spark, sf_dir, "documents")
    return phrases.collocations(docs, docs["lang"], docs["text"])


def op13_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole document outside repeated 200-byte strings."""
    docs = table(spark, sf_dir, "documents")
    cleaned = suffix_dedup.remove_repeats(docs, docs["doc_id"], docs["text"], with_bytes=False)
    n_spans = F.expr("size(spans) div 2")
    return cleaned.select("doc_id", "n_bytes", "n_removed", n_spans.alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_spans": op1_language_spans,
    "op2_perspective_chat": op2_perspective_chat,
    "op3_empirical_bayes_quality": op3_empirical_bayes_quality,
    "op4_min_cost_flow_sharding": op4_min_cost_flow_sharding,
    "op5_minhash_jaccard_join": op5_minhash_jaccard_join,
    "op6_kd_tree_top_k": op6_kd_tree_top_k,
    "op7_winnowing_decontamination": op7_winnowing_decontamination,
    "op8_gated_recurrent_scores": op8_gated_recurrent_scores,
    "op9_sainte_lague_mix": op9_sainte_lague_mix,
    "op10_doubling_substring_dedup": op10_doubling_substring_dedup,
    "op11_heap_centroids": op11_heap_centroids,
    "op12_multikey_collocations": op12_multikey_collocations,
    "op13_induced_suffix_dedup": op13_induced_suffix_dedup,
}
