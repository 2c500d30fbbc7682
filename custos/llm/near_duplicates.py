"""N-gram Jaccard join by MinHash banding.

Texts are sets of word n-grams (words as in :func:`common.alnum_words`; a
text of fewer words is one n-gram). Bands and rows are chosen so that a pair
at the threshold shares a band with the target recall. Equal texts are
collapsed first, so a group of copies is one text with a count. Band hashes
are shuffled; texts that share one are chained into candidate groups, which
only decide what is compared with what: inside a group every pair of
different texts is verified on the full n-gram sets, in blocks of bounded
size that are compared block against block, each pair of blocks in one task.
Pairs are never written out: a block pair gives each text its number of
links and a link to its local class, and the classes meet in connected
components.

Nulls and odd rows: a null text is in a class of its own without links;
equal texts (also those without words) are always linked; other texts
without words have no links; repeated rows are copies of each other; rows
with a null id take part, and a class is named by its smallest id (null if
it has none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import (WordHashes, alnum_words, cuts, give_back_memory, gram_hashes, mixed, packed, starts_inside,
                               stored, whole_groups)
from custos.llm.components import connected_components

THRESHOLD = 0.8
WORDS = 5
RECALL = 0.9999
# A block holds about this many texts, and about this many words.
BLOCK_TEXTS = 256
BLOCK_WORDS = 1_000_000


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        """Probability that a pair of this similarity shares a band."""
        return 1 - (1 - similarity ** self.rows) ** self.bands


def choose_banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 128) -> Banding:
    """The most rows a band (so the fewest false candidates) that reach ``recall`` at the threshold."""
    best = None
    for rows in range(1, most_hashes + 1):
        chance = threshold ** rows
        bands = 1 if chance >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-chance) - 1e-9))
        if bands * rows > most_hashes:
            break
        best = Banding(bands, rows)
    if best is None:
        raise ValueError("the recall needs more hashes than allowed")
    return best


def n_gram_sets(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, text)`` of all n-grams of concatenated texts (padded to ``n`` words), with repeats."""
    grams = mixed(gram_hashes(words, n))
    inside = starts_inside(ends, n)[:len(grams)]
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:len(grams)]
    return grams[inside], text[inside]


def band_hashes(text: Column, banding: Banding, n: int = WORDS) -> Column:
    """``struct(words, bands)``: number of words and one hash a band; null bands without words."""
    rng = np.random.default_rng(20240601)
    k = banding.bands * banding.rows
    xor = rng.integers(0, 1 << 63, k, np.uint64)
    odd = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    kind = pa.struct([("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<words:bigint,bands:array<bigint>>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back_memory()
        hashes = WordHashes(alnum_words)
        for texts in batches:
            out: list[pa.Array] = []
            for lo, hi in cuts(texts):
                words, ends = hashes.of(texts[lo:hi].to_pylist(), pad=n)
                grams, owner = n_gram_sets(words, ends, n)
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                full = owner[begin]
                signature = np.empty((k, len(full)), np.uint64)
                if len(full):
                    for i in range(k):
                        signature[i] = np.minimum.reduceat((grams ^ xor[i]) * odd[i], begin)
                bands = np.zeros((banding.bands, len(full)), np.uint64)
                for r in range(banding.rows):
                    bands = bands * np.uint64(0x9E3779B97F4A7C15) + signature[r::banding.rows]
                values = mixed(bands.T.reshape(-1))
                filled = np.zeros(hi - lo, np.int64)
                filled[full] = banding.bands
                offsets = np.concatenate([[0], np.cumsum(filled)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)),
                                                 mask=pa.array(filled == 0))
                out.append(pa.StructArray.from_arrays([pa.array(np.diff(ends)), lists], fields=list(kind)))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return sign(text.cast("binary"))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts have equal keys."""
    return F.unhex(F.md5(text.cast("binary")))


def _verifier(threshold: float, n: int):
    """Compares the texts of a block pair; one row per text with links: its links and its local class."""
    kind = pa.schema([("t", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def compare(group: pa.Table, hashes: WordHashes) -> tuple[list, list, list] | None:
        same = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        side = np.array(group.column("block").to_pylist()) == group.column("i")[0].as_py()
        m = len(side)
        if m < 2 or (not same and side.all()) or (not same and not side.any()):
            return None
        words, ends = hashes.of(group.column("text").to_pylist(), pad=n)
        grams, owner = n_gram_sets(words, ends, n)
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
        sizes = np.bincount(owner, minlength=m)
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        gram = np.cumsum(new) - 1
        shared = np.bincount(gram)[gram] > 1 if len(gram) else np.zeros(0, bool)
        gram, owner = gram[shared], owner[shared]
        _, gram = np.unique(gram, return_inverse=True)
        common = np.zeros((m, m), np.float32)
        width = max(256, (1 << 22) // m)
        at = 0
        while at < len(gram):
            to = np.searchsorted(gram, gram[at] + width)
            part = np.zeros((m, width), np.float32)
            part[owner[at:to], gram[at:to] - gram[at]] = 1
            common += part @ part.T
            at = to
        union = sizes[:, None] + sizes[None, :] - common
        linked = (common >= threshold * union - 1e-6) & (common > 0)
        np.fill_diagonal(linked, False)
        if not same:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        copies = np.array(group.column("copies").to_pylist(), np.int64)
        links = linked @ copies
        keys = group.column("t").to_pylist()
        rank = np.empty(m, np.int64)
        by_key = sorted(range(m), key=keys.__getitem__)
        rank[by_key] = np.arange(m)
        label = rank.copy()
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], m).min(1))
            low = low[by_key][low]  # the label's own label
            if (low == label).all():
                break
            label = low
        some = np.flatnonzero(linked.any(1))
        return [keys[x] for x in some], links[some].tolist(), [keys[by_key[label[x]]] for x in some]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        hashes = WordHashes(alnum_words)
        held: tuple[list, list, list] = ([], [], [])
        for group in whole_groups(batches, ["c", "i", "j"]):
            found = compare(group, hashes)
            if found:
                for column, values in zip(held, found):
                    column.extend(values)
            if len(held[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, kind)], schema=kind)
                held = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, kind)], schema=kind)

    return verify


def classes(docs: DataFrame, doc_id: Column, text: Column, threshold: float = THRESHOLD, n: int = WORDS,
            recall: float = RECALL, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(t, root, rep, copies, class_id, n_links)``: one row per different text.

    ``t`` is the text's key, ``root`` the smallest key of its class, ``rep``
    the smallest id among its copies,
    ``class_id`` the smallest id of its class and ``n_links`` the number of
    other rows linked to each of its rows (its copies and all rows of texts
    at the threshold or above).
    """
    banding = choose_banding(threshold, recall)
    rows = docs.select(doc_id.cast("long").alias("id"), text.cast("binary").alias("text")).filter("text is not null")
    signed = rows.select("id", text_key(F.col("text")).alias("t"), band_hashes(F.col("text"), banding, n).alias("s"))
    texts = stored(signed.groupBy("t").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                           F.first("s.words").alias("words"), F.first("s.bands").alias("bands")), "texts")
    bands = texts.select("t", F.posexplode("bands").alias("band", "hash"))
    bands = bands.select("t", F.xxhash64("band", "hash").alias("bucket"))
    buckets = stored(bands.groupBy("bucket").agg(F.min("t").alias("first"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").select("bucket", "first"), "buckets")
    edges = bands.join(buckets, "bucket").filter("t != first").select("t", "first").distinct()
    groups = connected_components(edges, "t", "first").select(F.col("node").alias("t"), F.col("root").alias("c"))
    groups = stored(groups.join(texts.select("t", "rep", "copies", "words"), "t"), "candidates")
    sizes = groups.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    sizes = stored(sizes.select("c", F.ceil(F.greatest(F.col("n") / block_texts, F.col("w") / block_words, F.lit(1)))
                                .cast("int").alias("g")), "candidate-sizes")
    members = groups.join(sizes, "c").withColumn("id", F.coalesce("rep", F.lit(-1))).drop("rep", "words")
    # one row of each different text that is a candidate; copies under other ids do not meet it
    found = rows.select(F.coalesce("id", F.lit(-1)).alias("id"), text_key(F.col("text")).alias("t"), "text")
    found = found.join(members, ["t", "id"]).dropDuplicates(["t"])
    block = F.pmod(F.xxhash64("t"), F.col("g")).cast("int")
    placed = found.select("t", "text", "copies", "c", "g", block.alias("block"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    placed = placed.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           "block", "t", "copies", "text")
    dealt = placed.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    verified = stored(dealt.mapInArrow(_verifier(threshold, n), "t binary, links long, root binary"), "verified")
    links = verified.groupBy("t").agg(F.sum("links").alias("links"))
    roots = connected_components(verified.select("t", "root"), "t", "root")
    linked = links.join(roots, links["t"] == roots["node"]).select("t", "links", "root")
    known = texts.select("t", "rep", "copies").join(linked, "t", "left")
    known = stored(known.select("t", "rep", "copies", F.coalesce("root", "t").alias("root"),
                                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    names = stored(known.groupBy("root").agg(F.min("rep").alias("class_id")), "class-names")
    return known.join(names, "root").select("t", "root", "rep", "copies", "class_id", "n_links")


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, **options) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row of ``docs``; options as in :func:`classes`."""
    found = stored(classes(docs, doc_id, text, **options).select("t", "class_id", "n_links"), "classes")
    rows = docs.select(doc_id.alias("doc_id"), text_key(text).alias("t"))
    out = rows.join(found, "t", "left")
    return out.select("doc_id", F.when(F.col("t").isNull(), F.col("doc_id").cast("long"))
                      .otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_class(docs: DataFrame, doc_id: Column, text: Column, **options) -> DataFrame:
    """One row of ``docs`` for each class: the one with the smallest id (null ids last), all its columns.

    Rows with a null text all stay: each is a class of its own.
    """
    found = classes(docs, doc_id, text, **options)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("t").alias("t")))
    kept = found.groupBy("root").agg(first.alias("kept")).select(
        F.col("kept.t").alias("_t"), F.coalesce("kept.id", F.lit(-1)).alias("_id"), F.col("kept.none").alias("_none"))
    kept = stored(kept, "kept-documents")
    rows = docs.select(packed(docs), text_key(text).alias("_t"), F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("_id"),
                       doc_id.isNull().alias("_none"))
    # copies with other ids do not meet the kept one, so a group of copies is spread
    again = Window.partitionBy("_t", "_id", "_none").orderBy(F.lit(1))
    one = rows.filter("_t is not null").join(kept, ["_t", "_id", "_none"], "left_semi")
    one = one.withColumn("_again", F.row_number().over(again)).filter("_again = 1").select("doc")
    return one.union(rows.filter("_t is null").select("doc")).select("doc.*")
