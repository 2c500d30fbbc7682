"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Sources share all words by weight; a target stops at ``most`` times its
source's words and the excess is shared again by weight (water filling, in
closed form over the sources sorted by how early they fill). Every source's
documents are dealt to shards and laid out in a seeded order; each shard's
stream is cut into blocks of equal word counts. The targets are votes for
blocks: the highest quotients ``votes / (2k + 1)`` win, which gives each
source a whole number of blocks; cumulative rounding deals it to the
source's shards. A shard's quota takes all its blocks ``quota div blocks``
times and the first ``quota mod blocks`` of the seeded order once more.

Only the table of sources (names, sizes, weights) is handled in one task;
its size is the number of distinct source names. Words are summed per
``(source, shard)``, so a source with any share of the rows is spread.

Nulls and odd rows: a null source is a source of its own, ordered last; a
null text has no words and takes none; equal rows may change places with
each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import packed, stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
SHARD_ROWS = 50_000
LEAST_SHARDS = 128
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, seed: str = SEED) -> Column:
    """A hexadecimal key that orders documents by chance, the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``position``, ``weight`` and ``target``.

    Sources in code-point order, nulls last, take the weights in turn.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("position", F.row_number().over(
        Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                      (F.col("position") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_full", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_full = Window.partitionBy().orderBy("_full", "position")
    below = by_full.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_full.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumns({
        "_rank": F.row_number().over(by_full),
        "_level": (F.sum("source_size").over(everything)
                   - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(below), F.lit(0)))
        / F.sum("weight").over(onward)})
    first_open = F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_rank", "_level"))).over(everything)
    ranked = ranked.withColumn("_open", first_open)
    target = F.when(F.col("_rank") < F.col("_open._rank"), (F.lit(most) * F.col("source_size")).cast("double"))
    target = target.otherwise(F.least(F.col("_open._level") * F.col("weight"),
                                      (F.lit(most) * F.col("source_size")).cast("double")))
    return ranked.select("source", "source_size", "position", "weight", target.alias("target"))


def apportion(parties: DataFrame, votes: str, key: str, name: str = "seats") -> DataFrame:
    """Sainte-Laguë: ``round(sum of votes)`` seats by highest quotients ``votes / (2k + 1)``; ties to the smaller key.

    A party's seats differ from its votes by at most half the number of
    parties times its share, plus a half; only quotients in that range are
    compared, so the rows are in proportion to the parties.
    """
    everything = Window.partitionBy()
    total = F.sum(votes).over(everything)
    slack = F.when(total > 0, F.col(votes) / total).otherwise(0.0) * F.count(F.lit(1)).over(everything) / 2 + 1
    bounds = parties.withColumns({"_least": F.greatest(F.lit(0), F.floor(F.col(votes) - slack)).cast("long"),
                                  "_up": F.ceil(F.col(votes) + slack).cast("long")})
    bounds = bounds.withColumn("_open", F.round(total).cast("long") - F.sum("_least").over(everything))
    quotients = bounds.withColumn("_k", F.explode(F.sequence(F.col("_least"), F.col("_up"))))
    won = Window.partitionBy().orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), key, "_k")
    quotients = quotients.withColumn("_won", (F.row_number().over(won) <= F.col("_open")).cast("long"))
    seats = quotients.groupBy(key).agg((F.first("_least") + F.sum("_won")).alias(name))
    return parties.join(seats, key)


def mix(docs: DataFrame, doc_id: Column, source: Column, size: Column, weights: Sequence[int] = WEIGHTS,
        most: int = MOST, block_words: int = BLOCK_WORDS, seed: str = SEED,
        carry: Sequence[str] | None = None) -> DataFrame:
    """Words each document gives to the mix.

    Returns ``doc`` (a struct of the columns of ``docs``, or of those in ``carry``), ``size``,
    ``source_size``, ``target``, ``quota`` and ``blocks`` of the document's
    source in its shard, ``taken`` (words, repeats counted) and ``copies``
    (for whole documents: how often the document's middle word is taken).
    """
    order = seeded_order(doc_id, seed)
    sized = docs.select(packed(docs, carry), doc_id.cast("string").alias("_id"),
                        source.alias("source"), size.alias("size"), order.alias("_order"))
    sized = stored(sized, "mix-sized")
    shards = max(LEAST_SHARDS, -(-sized.count() // SHARD_ROWS))
    shard = F.pmod(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(shards)).alias("shard")
    keyed = sized.select("doc", "_id", "size", "_order", F.col("source").isNull().alias("_none"),
                         F.coalesce("source", F.lit("")).alias("_source"), shard)
    cells = keyed.groupBy("_none", "_source", "shard").agg(F.sum("size").alias("words"))
    cells = stored(cells.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(
        F.lit(1), F.floor(F.col("words") / block_words + 0.5))).otherwise(0).cast("long")), "mix-cells")
    sources = cells.groupBy("_none", "_source").agg(F.sum("words").alias("source_size"),
                                                    F.sum("blocks").alias("all_blocks"))
    named = sources.withColumn("source", F.when(~F.col("_none"), F.col("_source")))
    targets = source_targets(named.select("source", "source_size"), weights, most)
    targets = targets.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    votes = targets.drop("source_size").join(sources, ["_none", "_source"]).withColumn(
        "votes", F.when(F.col("source_size") > 0,
                        F.col("target") / F.col("source_size") * F.col("all_blocks")).otherwise(0.0))
    seats = apportion(votes, "votes", "position")
    seats = seats.select("_none", "_source", "source_size", "target", "all_blocks",
                         F.least(F.col("seats"), most * F.col("all_blocks")).alias("seats"))
    so_far = Window.partitionBy("_none", "_source").orderBy("shard")
    cells = cells.withColumn("_upto", F.sum("blocks").over(so_far)).join(seats, ["_none", "_source"])
    dealt = lambda blocks: F.floor(F.when(F.col("all_blocks") > 0, F.col("seats") / F.col("all_blocks")
                                          ).otherwise(0.0) * blocks + 0.5)
    cells = cells.withColumn("quota", (dealt(F.col("_upto")) - dealt(F.col("_upto") - F.col("blocks"))).cast("long"))
    cells = cells.withColumns({
        "_times": F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long")})
    cells = cells.withColumn("_cut", F.when(F.col("blocks") > 0, F.floor(
        (F.col("quota") - F.col("_times") * F.col("blocks")) * F.col("words") / F.col("blocks"))).otherwise(0).cast("long"))
    cells = cells.select("_none", "_source", "shard", "source_size", "target", "quota", "blocks", "_times", "_cut")
    running = Window.partitionBy("_none", "_source", "shard").orderBy("_order", "_id", "size")
    placed = keyed.withColumn("_end", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(cells, ["_none", "_source", "shard"])
    start = F.col("_end") - F.col("size")
    partial = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_cut")) - start)
    taken = (F.col("_times") * F.col("size") + partial).cast("long")
    once_more = (start + F.floor(F.col("size") / 2) < F.col("_cut")).cast("long")
    copies = F.when(F.col("size") > 0, F.col("_times") + once_more).otherwise(0)
    return placed.select("doc", "size", "source_size", "target", "quota", "blocks", taken.alias("taken"),
                         copies.cast("int").alias("copies"))
