"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words. Of every window of
``span - gram + 1`` consecutive ``gram``-word hashes the smallest is kept as
a fingerprint; a shared span of ``span`` words holds one such window whole,
so both sides keep the same fingerprint of it. The fingerprints of all
documents are joined with those of all items; around a fingerprint that
meets, every window of ``span`` words that holds it is joined with the
items' windows under two independent 64-bit hashes, and windows that follow
one another are put together: the whole shared stretch. Items of fewer words
are one window of their own length, looked up at every place of a document.

Both tables stay distributed: nothing of the benchmark passes the driver but
the lengths of its short items (fewer than ``span`` numbers). Spark sends a
side of a join to all tasks only if its stored size is under the session's
broadcast threshold and shuffles both otherwise. Equal texts are compared
once; a fingerprint that many documents hold is dealt to ``SALTS`` tasks
(and split further by adaptive execution), documents without a hit are not
looked at again.

Nulls and odd rows: a null or empty text has no words, no spans and is not
contaminated; an item without words occurs nowhere; a null item id counts as
the empty id; repeated items count once for each id; repeated documents get
equal results; a very long text is hashed whole, in one row's memory; a
column named like the result is replaced, other names never clash; empty
tables give empty spans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import (WordHashes, alnum_words, cuts, discard, give_back_memory, gram_hashes, mixed, packed,
                               signed, starts_inside, stored, winnow)

SPAN = 10
GRAM = 5
#: Tasks that a fingerprint's documents, and the copies of a text, are dealt to.
SALTS = 8
# Bytes of text hashed at a time.
PIECE_BYTES = 1 << 20
_IS_WORD = np.array([len(alnum_words(bytes([b]))) > 0 for b in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64)
# A word's hash is the sum of a number of its byte times a number of the byte's place.
_BYTE = np.where(_IS_WORD, mixed(_LOWER + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def _place_numbers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


_PLACE = _place_numbers(1 << 10)


def word_places(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, begin, ends)`` of texts one after another: where words begin, and each text's first word."""
    starts = np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in texts], dtype=np.int64)])
    data = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    word = _IS_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = starts[starts < len(data)]
    begins[edges] = word[edges]
    begin = np.flatnonzero(begins)
    return data, begin, np.searchsorted(begin, starts)


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of :func:`common.alnum_words` of all texts, and where each text starts (and the last ends).

    Worked out on whole arrays of bytes, twice as fast as word by word;
    unlike words may agree, so what they find is compared again.
    """
    data, begin, ends = word_places(texts)
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        lo = begin[at]
        to = max(at + 1, int(np.searchsorted(begin, lo + PIECE_BYTES)))
        hi = begin[to] if to < len(begin) else len(data)
        first = (begin[at:to] - lo).astype(np.int32 if hi - lo < 1 << 31 else np.int64)
        room = np.diff(first, append=first.dtype.type(hi - lo))
        place = np.arange(hi - lo, dtype=first.dtype) - np.repeat(first, room)
        numbers = _PLACE if room.max() <= len(_PLACE) else _place_numbers(int(room.max()))
        out[at:to] = np.add.reduceat(_BYTE[data[lo:hi]] * numbers[place], first)
        at = to
    return out, ends


def fingerprints(words: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)`` of the kept ``gram``-word hashes of concatenated texts."""
    grams = mixed(gram_hashes(words, gram))
    inside = starts_inside(ends, span)[:len(grams)]
    places = np.flatnonzero(winnow(grams, inside, span - gram + 1)) if inside.any() else np.empty(0, np.int64)
    return places, grams[places]


def windows(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, hash)`` of every window of ``n`` words inside one of the concatenated texts."""
    grams = mixed(gram_hashes(words, n))
    places = np.flatnonzero(starts_inside(ends, n)[:len(grams)])
    return places, grams[places]


def windows_around(places: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Starts of the ``span``-word windows, each inside one text, that hold the ``gram`` words at any of ``places``."""
    starts = np.unique(places[:, None] - np.arange(span - gram + 1)[None, :])
    starts = starts[(starts >= 0) & (starts <= int(ends[-1]) - span)]
    return starts[starts_inside(ends, span)[starts]]


def _lists(owner: np.ndarray, values: pa.Array, rows: int) -> pa.Array:
    """``values``, which are sorted by ``owner``, as one list a row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _owners(ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, places, "right") - 1


def _item_parts(text: Column, span: int, gram: int) -> Column:
    """``struct(prints, windows)`` of items: hashes that documents are searched for, and all windows ``(n, a, b)``."""
    window = pa.struct([("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    kind = pa.struct([("prints", pa.list_(pa.int64())), ("windows", pa.list_(window))])

    @F.arrow_udf("struct<prints:array<bigint>,windows:array<struct<n:int,a:bigint,b:bigint>>>")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first, second = WordHashes(alnum_words), WordHashes(alnum_words, seed=1)
        for texts in batches:
            prints, found = [], []
            for item in texts.to_pylist():
                (words, ends), (a, _), (b, _) = word_hashes([item]), first.of([item]), second.of([item])
                n = min(span, len(words))
                if not n:
                    prints.append([])
                    found.append([])
                    continue
                kept = fingerprints(words, ends, span, gram)[1] if n == span else windows(words, ends, n)[1]
                prints.append(np.unique(kept).view(np.int64).tolist())
                pairs = np.unique(np.stack([windows(a, ends, n)[1], windows(b, ends, n)[1]], 1), axis=0).view(np.int64)
                found.append([{"n": n, "a": x, "b": y} for x, y in pairs.tolist()])
            yield pa.StructArray.from_arrays([pa.array(prints, pa.list_(pa.int64())), pa.array(found, pa.list_(window))],
                                             fields=list(kind))

    return parts(text)


def _document_prints(text: Column, short: Sequence[int], span: int, gram: int) -> Column:
    """Fingerprints of a text, and the hashes of all its windows of the lengths in ``short``."""

    @F.arrow_udf("array<bigint>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back_memory()
        for texts in batches:
            out = []
            for lo, hi in cuts(texts, PIECE_BYTES):
                words, ends = word_hashes(texts[lo:hi].to_pylist())
                kinds = [fingerprints(words, ends, span, gram)] + [windows(words, ends, n) for n in short]
                places, found = (np.concatenate(x) for x in zip(*kinds))
                if short:
                    order = np.argsort(places, kind="stable")
                    places, found = places[order], found[order]
                out.append(_lists(_owners(ends, places), signed(found), hi - lo))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return prints(text)


def _document_windows(text: Column, met: Column, short: Sequence[int], span: int, gram: int) -> Column:
    """Windows ``(place, n, a, b)`` of a text around the hashes that it shares with items."""
    kind = pa.struct([("place", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("array<struct<place:bigint,n:int,a:bigint,b:bigint>>")
    def around(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        first, second = WordHashes(alnum_words), WordHashes(alnum_words, seed=1)
        for texts, shared in batches:
            out = []
            for lo, hi in cuts(texts):
                rows = texts[lo:hi].to_pylist()
                (words, ends), (a, _), (b, _) = word_hashes(rows), first.of(rows), second.of(rows)
                known = shared[lo:hi].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                places, found = fingerprints(words, ends, span, gram)
                starts = {span: windows_around(places[np.isin(found, known)], ends, span, gram)}
                for n in short:
                    places, found = windows(words, ends, n)
                    starts[n] = places[np.isin(found, known)]
                place = np.concatenate(list(starts.values()))
                length = np.repeat(list(starts), [len(s) for s in starts.values()])
                sides = [np.concatenate([mixed(gram_hashes(w, n))[s] for n, s in starts.items()]) for w in (a, b)]
                order = np.argsort(place, kind="stable")
                owner = _owners(ends, place[order])
                columns = [pa.array(place[order] - ends[owner]), pa.array(length[order], pa.int32()),
                           *(signed(side[order]) for side in sides)]
                out.append(_lists(owner, pa.StructArray.from_arrays(columns, fields=list(kind)), hi - lo))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    return around(text, met)


def _n_words(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back_memory()
        for texts in batches:
            counts = [np.diff(word_places(texts[lo:hi].to_pylist())[2]) for lo, hi in cuts(texts, PIECE_BYTES)]
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return count(text.cast("binary"))


def _text_key(text: Column) -> Column:
    """16 bytes that stand for a text; equal texts have equal keys."""
    return F.unhex(F.md5(text.cast("binary")))


def _salted(rows: DataFrame) -> DataFrame:
    """Every row once for each of the tasks that the other side's rows are dealt to."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def shared_spans(docs: DataFrame, text: Column, benchmark: DataFrame, item_id: Column, item_text: Column,
                 span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``(t, spans)``: one row per different text that shares a window with an item; ``t`` is the text's key."""
    items = benchmark.select(F.coalesce(item_id.cast("string"), F.lit("")).alias("item"),
                             item_text.cast("binary").alias("text")).filter("text is not null").distinct()
    items = stored(items.select("item", _item_parts(F.col("text"), span, gram).alias("parts")), "benchmark-items")
    wanted = stored(items.select(F.explode("parts.prints").alias("hash")).distinct(), "benchmark-prints")
    held = items.select("item", F.explode("parts.windows").alias("w")).select("w.n", "w.a", "w.b", "item").distinct()
    held = stored(held, "benchmark-windows")
    short = [r["n"] for r in held.filter(F.col("n") < span).select("n").distinct().orderBy("n").collect()]  # below span

    texts = docs.select(text.cast("binary").alias("text")).filter("text is not null")
    prints = texts.select(_text_key(F.col("text")).alias("t"), _document_prints(F.col("text"), short, span, gram).alias("p"))
    prints = prints.select("t", F.pmod(F.xxhash64("t"), F.lit(SALTS)).alias("salt"), F.explode("p").alias("hash"))
    met = prints.join(_salted(wanted), ["hash", "salt"], "left_semi").groupBy("t").agg(F.collect_set("hash").alias("met"))
    met = stored(met, "shared-prints")

    # copies are dealt to several tasks, each of which passes one of them on
    dealt = texts.select("text", _text_key(F.col("text")).alias("t"),
                         F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    one = dealt.join(_salted(met.select("t")), ["t", "salt"], "left_semi").dropDuplicates(["t", "salt"])
    candidates = one.select("t", "text").dropDuplicates(["t"]).join(met, "t")
    found = candidates.select("t", F.explode(_document_windows(F.col("text"), F.col("met"), short, span, gram)).alias("w"))
    hits = found.select("t", "w.*").join(held, ["n", "a", "b"]).select("t", "item", "place", "n")
    order = Window.partitionBy("t", "item").orderBy("place")  # one text's hits of one item
    begins = F.col("place") != F.coalesce(F.lag("place").over(order), F.lit(-2)) + 1
    stretch = hits.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    stretch = stretch.groupBy("t", "item", "run").agg(F.min("place").alias("first"),
                                                     F.max(F.col("place") + F.col("n") - 1).alias("last"))
    spans = stretch.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("first", "last", "item"))).alias("spans"))
    spans = stored(spans, "shared-spans")
    discard(items, wanted, held, met)
    return spans


def find(docs: DataFrame, text: Column, benchmark: DataFrame, item_id: Column, item_text: Column, span: int = SPAN,
         gram: int = GRAM, name: str = "match", carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``carry``) with a column ``name``: ``struct(n_words, spans)``; one of that name is replaced.

    ``spans`` are the stretches shared with items, ``(first word, last word,
    item id)``, sorted by place: every window of ``span`` consecutive item
    words (or a shorter item whole) that a document holds lies in one of them.
    """
    found = shared_spans(docs, text, benchmark, item_id, item_text, span, gram)
    # a null text meets nothing; a number of its own keeps such rows from gathering in one task
    alone = F.concat(F.lit("null "), F.monotonically_increasing_id().cast("string")).cast("binary")
    rows = docs.select(packed(docs, carry), F.coalesce(_text_key(text), alone).alias("t"),
                       _n_words(text).alias("n_words"))
    none = F.array().cast(found.schema["spans"].dataType)
    match = F.struct("n_words", F.coalesce("spans", none).alias("spans")).alias(name)
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() != name.lower()]
    return rows.join(found, "t", "left").select(*[F.col("doc").getField(c).alias(c) for c in kept], match)


def words_hit(spans: Column) -> Column:
    """Number of words inside any span (spans sorted by first word)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        end = s["last"] + 1
        return F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["upto"], s["first"]))).alias("n"),
                        F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def item_ids(spans: Column) -> Column:
    """Ids of the items that occur, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["item"])))
