"""Substring deduplication by level-wise doubling.

A window of ``length`` words repeats when its word sequence starts anywhere
else, in the same text or another. Levels of doubling length find the
candidates: at the first level only window starts that are the smallest hash
of their neighbourhood (anchors) are looked at; every window of the full
length holds one, its own smallest, and equal windows hold the same. Anchors
whose short window repeats are extended to twice the length, to the right and
to the left, up to the full length. There a window remains only if its own
anchor survived with every extension that lies inside the window; what
remains is counted exactly.

All of it is grouping and joining: anchors with their hashes are written once,
each level groups their hashes and keeps the anchors that meet a repeated one.
The last level counts windows under two independent 64-bit hashes of their
words, so different windows do not pass for one. Texts are kept once per
distinct text, bucketed by their digest, and are joined with what was found by
bucket, without moving again. Hashes that many places share are joined apart
(:func:`custos.llm.suffix_dedup.join_by_weight`), so none fills a task.

Nulls and odd rows: a null text has no words; a text shorter than the window
keeps all of them; repeated rows (same id and text) are different places, so
both lose what they share; a null id is kept; very long texts are one value
each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import (HASHED_BYTES, cuts, discard, gram_hashes, joined_grams, mixed, signed, sliding, space_words,
                               starts_inside, stored, winnow, word_hashes)
from custos.llm.suffix_dedup import join_by_weight
from custos.session import ensure_checkpoint_dir, is_local

LENGTH = 35


class Levels:
    """Window lengths from the first to the full one, and the candidate places of each."""

    def __init__(self, length: int = LENGTH) -> None:
        if length < 4:
            raise ValueError("windows need four words at least")
        self.length = length
        self.lengths = [length]
        while self.lengths[0] > 12:
            self.lengths.insert(0, -(-self.lengths[0] // 2))

    @property
    def middle(self) -> list[int]:
        """Lengths between the first and the full one."""
        return self.lengths[1:-1]

    def grams(self, words: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
        """Window hashes of the first ``levels`` levels (not yet mixed), each made from the level below."""
        out = [gram_hashes(words, self.lengths[0])]
        for short, long in list(zip(self.lengths, self.lengths[1:]))[:None if levels is None else levels - 1]:
            out.append(joined_grams(out[-1], long - short, long - short)
                       if long == 2 * short else self._overlapped(out[-1], short, long))
        return out

    def _overlapped(self, grams: np.ndarray, short: int, long: int) -> np.ndarray:
        # the halves overlap where the length is odd; the pair still stands for the whole window
        n = max(0, len(grams) - (long - short))
        return mixed(grams[:n]) * np.uint64(0x9E3779B97F4A7C15) + grams[long - short:long - short + n]

    def anchors(self, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """First-level places that every full window holds one of."""
        inside = starts_inside(ends, self.length)[:len(first)]
        if not inside.any():
            return np.empty(0, np.int64)
        return np.flatnonzero(winnow(mixed(first), inside, self.length - self.lengths[0] + 1))

    def extended(self, at: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``long`` words that begin and that end with the short windows at ``at``."""
        return at, at + self.lengths[0] - long

    def needed(self, back: int) -> int:
        """Which extensions (bits: right, left by middle length) of an anchor lie in the full window ``back`` words before it."""
        bits = 0
        for i, long in enumerate(self.middle):
            bits |= (1 << 2 * i) * (back <= self.length - long) | (2 << 2 * i) * (back >= long - self.lengths[0])
        return bits

    def starts(self, first: np.ndarray, ends: np.ndarray, at: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Starts of full windows whose smallest first-level hash (mixed) is at an anchor that has all its extensions."""
        inside = starts_inside(ends, self.length)[:len(first)]
        reach = self.length - self.lengths[0]
        if not reach:
            return np.flatnonzero(inside)
        low, good = sliding(first, reach + 1, np.minimum), np.zeros(len(first), bool)
        begin = ends[np.searchsorted(ends, at, "right") - 1]
        for back in range(reach + 1):
            bits = self.needed(back)
            start = at[((sides & bits) == bits) & (at - back >= begin)] - back
            start = start[inside[start]]
            good[start[first[start + back] == low[start]]] = True
        return np.flatnonzero(good)


def _bucketed_texts(docs: DataFrame, text: Column) -> tuple[DataFrame, str]:
    """``(key, n, text)``: every distinct text once with its number of rows, bucketed by key; and the table's name."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))
    texts = rows.groupBy(text_key(F.col("text")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark, allow_local=is_local(spark)).rstrip('/')}/llm/{name}"
    (texts.repartition(parts, "key").write.bucketBy(parts, "key").option("path", path).option("compression", "zstd")
     .saveAsTable(name))
    return spark.table(name), name


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null: the empty one)."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def _anchors(texts: DataFrame, levels: Levels) -> DataFrame:
    """``(key, at, w, h, r0, l0, ...)``: every anchor with its hash and, by middle length, those of its extensions.

    An extension that leaves the text has no hash; ``w`` is 2 where the text has copies.
    """
    names = ["key", "at", "w", "h", *[f"{side}{i}" for i in range(len(levels.middle)) for side in "rl"]]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, column = batch.columns
            for lo, hi in cuts(column, 4 * HASHED_BYTES):
                (words,), ends = word_hashes(column[lo:hi].to_pylist())
                grams = levels.grams(words, len(levels.lengths) - 1)
                at = levels.anchors(grams[0], ends)
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, "right") - 1
                own = pa.array(row + lo)
                columns = [keys.take(own), pa.array((at - ends[row]).astype(np.int32)), copies.take(own),
                           signed(mixed(grams[0][at]))]
                for long, gram in zip(levels.middle, grams[1:]):
                    for start in levels.extended(at, long):
                        inside = (start >= ends[row]) & (start + long <= ends[row + 1])
                        values = mixed(gram[np.where(inside, start, 0)]).view(np.int64)
                        columns.append(pa.array(values, mask=~inside))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "key binary, at int, w int, " + ", ".join(f"{name} long" for name in names[3:])
    return texts.select("key", _weight(), "text").mapInArrow(emit, schema)


def _weight() -> Column:
    return F.least(F.col("n"), F.lit(2)).cast("int").alias("w")


def _surviving(texts: DataFrame, levels: Levels) -> DataFrame:
    """``(key, at, side)``: the anchors that repeat at every level, once for each extension that does (bits)."""
    live = stored(_anchors(texts, levels), "anchors")
    twice = live.groupBy("h").agg(F.sum("w").alias("times"), F.count(F.lit(1)).alias("met"))
    twice = stored(twice.filter("times > 1").drop("times"), f"repeated-{levels.lengths[0]}")
    kept = stored(join_by_weight(live, twice, ["h"], "met").drop("h"), "repeated-anchors")
    discard(live, twice)
    if not levels.middle:
        return kept.select("key", "at", F.lit(0).alias("side"))
    live, found = kept, []
    for i, long in enumerate(levels.middle):
        right, left = levels.extended(F.col("at"), long)
        both = F.array(F.struct(F.col(f"r{i}").alias("h"), right.alias("start"), F.lit(1 << 2 * i).alias("side")),
                       F.struct(F.col(f"l{i}").alias("h"), left.alias("start"), F.lit(2 << 2 * i).alias("side")))
        sides = live.select("key", "at", "w", F.inline(both)).filter("h is not null")
        # one window may extend two anchors: different places count
        place = F.xxhash64("key", "start")
        twice = sides.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("w").alias("w"),
                                       F.count(F.lit(1)).alias("met"))
        twice = stored(twice.filter("low != high or w > 1").select("h", "met"), f"repeated-{long}")
        found.append(stored(join_by_weight(sides, twice, ["h"], "met").select("key", "at", "side"), "extended-anchors"))
        discard(twice)
        if i + 1 < len(levels.middle):
            live = kept.join(found[-1].select("key", "at").distinct(), ["key", "at"], "left_semi")
    discard(kept)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _windows(texts: DataFrame, levels: Levels) -> DataFrame:
    """``(a, b, key, start, w)``: the windows of full length that remain, under two independent hashes.

    ``texts`` has ``key, n, text`` and ``live``, its surviving anchors (null where all windows are counted).
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, column, live = batch.columns
            for lo, hi in cuts(column, 4 * HASHED_BYTES):
                (words, others), ends = word_hashes(column[lo:hi].to_pylist(), seeds=(0, 1))
                grams = levels.grams(words)
                lists = live[lo:hi]
                flat = lists.flatten()
                row = np.repeat(np.arange(hi - lo), pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                place = flat.field("at").to_numpy(zero_copy_only=False) + ends[row]
                at, back = np.unique(place, return_inverse=True)
                sides = np.zeros(len(at), np.int64)
                np.bitwise_or.at(sides, back, flat.field("side").to_numpy(zero_copy_only=False).astype(np.int64))
                start = levels.starts(mixed(grams[0]), ends, at.astype(np.int64), sides)
                if not len(start):
                    continue
                row = np.searchsorted(ends, start, "right") - 1
                own = pa.array(row + lo)
                second = levels.grams(others)[-1]
                yield pa.RecordBatch.from_arrays(
                    [signed(mixed(grams[-1][start])), signed(mixed(second[start])), keys.take(own),
                     pa.array((start - ends[row]).astype(np.int32)), copies.take(own)], names=["a", "b", "key", "start", "w"])

    return texts.select("key", _weight(), "text", "live").mapInArrow(emit, "a long, b long, key binary, start int, w int")


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key, starts)`` of every text with a repeated window; ``texts`` has ``key``, ``n`` and binary ``text``.

    ``starts`` are the word places at which a repeated window starts.
    """
    levels = Levels(length)
    if len(levels.lengths) > 1:
        # one text's anchors: bounded by its words
        live = _surviving(texts, levels).groupBy("key").agg(F.collect_list(F.struct("at", "side")).alias("live"))
        live = stored(live, "live-anchors")
        candidates = texts.join(live, "key")
    else:
        candidates = texts.withColumn("live", F.lit(None).cast("array<struct<at:int,side:int>>"))
    windows = stored(_windows(candidates, levels), "windows")
    counts = windows.groupBy("a", "b").agg(F.sum("w").alias("times"), F.count(F.lit(1)).alias("met"))
    counts = stored(counts.filter("times > 1").drop("times"), "repeated-windows")
    # one text's starts: bounded by its words
    found = join_by_weight(windows, counts, ["a", "b"], "met").groupBy("key").agg(F.collect_list("start").alias("starts"))
    found = stored(found, "starts")
    discard(windows, counts)
    return found


def keep_unrepeated(text: bytes | None, starts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """``(words, removed words, kept words joined by one space)``."""
    words = space_words(text) if text else []
    if not len(starts):
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + length, len(words)), -1)
    gone = np.cumsum(cover)[:-1] > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(words), int(gone.sum()), b" ".join(kept)


def remove_repeats(docs: DataFrame, doc_id: Column, text: Column, length: int = LENGTH,
                   with_text: bool = True) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for every row; ``kept`` is null unless ``with_text``."""
    spark = docs.sparkSession
    texts, name = _bucketed_texts(docs, text)
    starts = repeated_starts(texts, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, column, found = batch.columns
            for lo, hi in cuts(column):
                out = [keep_unrepeated(t, np.array(s or (), np.int64), length)
                       for t, s in zip(column[lo:hi].to_pylist(), found[lo:hi].to_pylist())]
                n, gone, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [keys[lo:hi], copies[lo:hi], pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                     pa.array([k if with_text else None for k in kept], pa.binary())],
                    names=["key", "n", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = "key binary, n long, n_words long, n_removed long, kept_sha256 string, kept binary"
    done = texts.join(starts, "key", "left").select("key", "n", "text", "starts").mapInArrow(finish, schema)
    done = stored(done, "cleaned-texts")
    spark.sql(f"DROP TABLE {name}")
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text_key(text).alias("key"))
    return join_by_weight(rows, done, ["key"], "n").select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"))
