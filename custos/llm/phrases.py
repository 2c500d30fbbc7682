"""Phrase collocation mining by multikey quicksort of suffix pointers.

Every word starts a suffix of up to four words inside its piece. Suffixes are
routed to tasks by their leading words; a task sorts pointers to them by
three-way partitions, one word at a time to the maximum depth. The pointers
equal in their first words are the occurrences of that phrase, so the size of
an equal partition is its count, and a partition of fewer than the least
count is abandoned with everything in it.

Infrequent partitions are abandoned for the whole corpus level by level: a
first pass counts words by language, a second sorts suffixes of two frequent
words, a third those of three and four whose neighbours are all frequent
pairs. A suffix ends at the first infrequent word or pair. Tasks know the
frequent words and pairs where their measured size allows that
(``known_bytes``); beyond it suffixes are not cut there, which moves more
rows and gives the same result. Equal suffixes of a task are one row with a
count before anything is shuffled. A leading word
with more than ``group_rows`` rows is routed by its first two words instead,
then by three, its rows collapsed to distinct suffixes first; past that every
suffix is a phrase of its own, so no task holds more than the bound.

Scores and the removal of covered phrases are joins on phrases, whose number
is bounded by words / least count.

Nulls and odd rows: a null language is ``und``, a null text is empty; a null
id does not matter; repeated rows count each time; very long texts are worked
through in pieces of a task's memory (a text itself is one value); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.common import cuts, mixed, stored

DEPTH = 4
LEAST = 30
TOP = 2000
UNKNOWN = "und"
#: Frequent words up to this size (their bytes and 16 a word), and pairs (16 each), are sent to all tasks.
KNOWN_BYTES = 32 << 20
#: Most suffix rows of one leading word, and rows aimed at per group of routes.
GROUP_ROWS = 1 << 18
# Suffixes a task holds before it collapses equal ones.
_FLUSH = 1 << 21
# Words counted before a task hands its counts on.
_WORDS = 400_000
# Partitions up to this size are split at all their words at once.
_SMALL = 1024
# Separators of pieces become ".", a tab a blank; A-Z are lower-cased.
_SPLIT = bytes(46 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
               for b in range(256))


def words_and_ends(text: bytes) -> list[bytes]:
    """Lower-cased words, with ``.`` where a piece ends."""
    return text.translate(_SPLIT).replace(b".", b" . ").split(b" ")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    langs, texts = batch.columns
    for lo, hi in cuts(texts):
        yield langs[lo:hi].to_pylist(), texts[lo:hi].to_pylist()


def word_counts(rows: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of every word, and each language's total under a null word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            found = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            langs, words, n = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words, pa.binary()), pa.array(n, pa.int64())],
                                              names=["lang", "word", "n"])

        for batch in batches:
            for langs, texts in _texts(batch):
                for lang, text in zip(langs, texts):
                    own = counts.setdefault(lang, Counter())
                    words = words_and_ends(text)
                    own.update(words)
                    own[None] += len(words) - own.pop(b".", 0) - own.pop(b"", 0)
                if sum(map(len, counts.values())) > _WORDS:
                    yield out()
        if counts:
            yield out()

    return rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def letter(lang: str, word: bytes) -> int:
    """A word of a language as a number other than 0 (no word) and -1 (end of a piece)."""
    h = xxhash.xxh3_64_intdigest(lang.encode() + b" " + word) - (1 << 63)
    return h if h not in (0, -1) else 1


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of letters."""
    return mixed(mixed(first.view(np.uint64)) + second.view(np.uint64))


def suffix_rows(rows: DataFrame, known: DataFrame | None, longest: int = DEPTH, pairs: DataFrame | None = None) -> DataFrame:
    """``(w1, w2, w3, w4, n)``: suffixes of ``longest`` words at most, collapsed by task; 0 stands for no word.

    Without ``pairs`` suffixes of two words or more; with them suffixes of
    three or more, cut where two neighbours are none of ``pairs``. The sizes
    of ``known`` and ``pairs`` are checked by the caller.
    """
    context = rows.sparkSession.sparkContext
    shared = shared_pairs = None
    if known is not None:
        words: dict[str, dict[bytes, int]] = {}
        for r in known.collect():
            words.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
        shared = context.broadcast(words)
    if pairs is not None:
        two = np.array([(r["w1"], r["w2"]) for r in pairs.select("w1", "w2").collect()], np.int64).reshape(-1, 2)
        shared_pairs = context.broadcast(np.sort(pair_keys(two[:, 0].copy(), two[:, 1].copy())))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hashes = [], 0, {}

        def number(lang: str, word: bytes) -> int:
            return -1 if word == b"." else letter(lang, word)

        for batch in batches:
            for langs, texts in _texts(batch):
                codes = []
                for lang, text in zip(langs, texts):
                    words = [w for w in words_and_ends(text) if w]
                    words.append(b".")
                    if shared is not None:
                        get = shared.value.get(lang, {}).get
                        codes.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
                    else:
                        if len(hashes) > _WORDS:
                            hashes.clear()
                        own = hashes.setdefault(lang, {})
                        for w in set(words).difference(own):
                            own[w] = number(lang, w)
                        codes.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                held.append(suffixes(np.concatenate(codes), longest, None if shared_pairs is None else shared_pairs.value))
                size += held[-1].shape[1]
                if size >= _FLUSH:
                    yield collapsed(np.concatenate(held, 1))
                    held, size = [], 0
        if size:
            yield collapsed(np.concatenate(held, 1))

    return rows.mapInArrow(emit, "w1 long, w2 long, w3 long, w4 long, n long")


def collapsed(w: np.ndarray) -> pa.RecordBatch:
    """Equal suffixes (columns of ``w``) once, with their count."""
    # small letters are compared two at a time
    small = w.max() < 1 << 31 and w.min() >= 0
    keys = [(w[i] << 32) | w[i + 1] for i in range(0, DEPTH, 2)] if small else list(w)
    if small and not keys[1].any():
        keys = keys[:1]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order)))
    first = order[at]
    return pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in w), pa.array(n)], names=[*_W, "n"])


def suffixes(codes: np.ndarray, longest: int = DEPTH, pairs: np.ndarray | None = None) -> np.ndarray:
    """``(4, suffixes)``: the words from each place on, up to the first -1 (an end or an infrequent word).

    With ``pairs`` (sorted keys) a suffix also ends between two words that are none of them.
    """
    n = len(codes)
    padded = np.append(codes, np.full(DEPTH, -1))
    held = padded != -1
    # joined[i]: the words at i and i + 1 may stand in one phrase
    joined = held[:-1] & held[1:]
    if pairs is not None:
        at = np.flatnonzero(joined)
        keys = pair_keys(padded[at], padded[at + 1])
        found = np.searchsorted(pairs, keys)
        joined[at] = pairs[np.minimum(found, len(pairs) - 1)] == keys if len(pairs) else False
    least = 2 if pairs is None else 3
    start = joined[:n].copy()
    for i in range(1, least - 1):
        start &= joined[i:n + i]
    start = np.flatnonzero(start)
    out = np.zeros((DEPTH, len(start)), np.int64)
    open_ = np.ones(len(start), bool)
    for i in range(longest):
        if i:
            open_ &= joined[start + i - 1]
        out[i] = np.where(open_, padded[start + i], 0)
    return out


def equal_partitions(letters: np.ndarray, counts: np.ndarray, least: int, begin: int) -> Iterator[tuple[int, int, int]]:
    """``(row, depth, count)`` of every prefix of ``begin`` letters or more that ``least`` suffixes share.

    Multikey quicksort of pointers to the rows of ``letters`` (suffix by
    depth, 0 ends a suffix) with their counts: a three-way partition at a
    pivot's letter, the equal part going on at the next letter. Small
    partitions are split at all their letters in one step.
    """
    todo = [(np.arange(len(counts)), 0)]
    while todo:
        pointers, depth = todo.pop()
        weight = counts[pointers]
        if weight.sum() < least:
            continue  # no equal partition inside can be frequent
        keys = letters[pointers, depth]
        if len(pointers) <= _SMALL:
            order = np.argsort(keys, kind="stable")
            keys, pointers = keys[order], pointers[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            totals = np.add.reduceat(weight[order], at)
            ends = np.append(at[1:], len(keys))
            equal = [(pointers[b:e], t) for b, e, t, k in zip(at.tolist(), ends.tolist(), totals.tolist(), keys[at].tolist())
                     if t >= least and k]
        else:
            pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
            same = keys == pivot
            below = keys < pivot
            todo += [(pointers[below], depth), (pointers[~(same | below)], depth)]
            equal = [(pointers[same], int(weight[same].sum()))] if pivot else []
        for part, total in equal:
            if total < least:
                continue
            if depth + 1 >= begin:
                yield int(part[0]), depth + 1, total
            if depth + 1 < letters.shape[1]:
                todo.append((part, depth + 1))


_W = [f"w{i + 1}" for i in range(DEPTH)]


def _sorted_counts(rows: DataFrame, begin: int, routed_by: int, groups: int, least: int) -> DataFrame:
    """``(w1..w4, a)`` of the frequent phrases of ``begin`` words or more, each group of routes sorted in one task."""
    begin = max(begin, routed_by)

    def sort(table: pa.Table) -> pa.Table:
        letters = np.stack([table.column(c).to_numpy() for c in _W], 1)
        found = list(equal_partitions(letters, table.column("n").to_numpy(), least, begin))
        out = np.zeros((len(found), DEPTH), np.int64)
        for i, (row, depth, _) in enumerate(found):
            out[i, :depth] = letters[row, :depth]
        return pa.table([*(pa.array(c) for c in out.T), pa.array([a for *_, a in found], pa.int64())], names=[*_W, "a"])

    route = F.pmod(F.xxhash64(*_W[:routed_by]), F.lit(groups))
    return rows.select(*_W, "n", route.alias("route")).groupBy("route").applyInArrow(
        sort, "w1 long, w2 long, w3 long, w4 long, a long")


def phrase_counts(suffixes: DataFrame, begin: int = 2, least: int = LEAST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(w1..w4, a)``: counts of all phrases of ``begin`` to four words that occur ``least`` times or more."""
    spark = suffixes.sparkSession
    rows, found = stored(suffixes, "suffixes"), []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(0).cast("long")
    for depth in range(1, DEPTH):
        lead = _W[:depth]
        groups = max(parts, -(-rows.count() // group_rows))
        sizes = rows.groupBy(*lead).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("a"))
        # at most rows / group_rows of them
        hot = stored(sizes.filter(F.col("m") > group_rows), "hot-leads")
        if hot.isEmpty():
            found.append(_sorted_counts(rows, begin, depth, groups, least))
            rows = None
            break
        found.append(_sorted_counts(rows.join(hot.select(*lead), lead, "left_anti"), begin, depth, groups, least))
        if depth >= begin:
            ends = [none.alias(c) for c in _W[depth:]]
            found.append(hot.filter((F.col("a") >= least) & (F.col(lead[-1]) != 0)).select(*lead, *ends, "a"))
        rows = rows.join(hot.select(*lead), lead, "left_semi").groupBy(*_W).agg(F.sum("n").alias("n"))
        rows = stored(rows, "hot-suffixes")
    if rows is not None:
        found.append(rows.filter((F.col("n") >= least) & (F.col(_W[-1]) != 0)).select(*_W, F.col("n").alias("a")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelled(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, phrase, k, a)`` from letters; ``words`` has ``(id, lang, word)``."""
    letters = counts.select(*_W, "a", F.posexplode(F.filter(F.array(*_W), lambda w: w != 0)).alias("at", "id"))
    named = letters.join(words.select("id", "lang", "word"), "id")
    # four words a group at most
    named = named.groupBy(*_W, "a").agg(F.min("lang").alias("lang"),
                                        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("s"))
    return named.select("lang", F.array_join("s.word", " ").alias("phrase"), F.size("s").alias("k"), "a")


def scored(phrases: DataFrame, keep_share: int = 80) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the phrases that no longer one covers.

    ``phrases`` has ``(lang, phrase, k, a)`` of all frequent phrases, single
    words too. The lowest-scoring cut counts, ties to the shortest first part.
    """
    candidates = phrases.filter("k > 1")
    cut = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', c)"),
                           "right": F.expr("substring_index(phrase, ' ', c - k)")})
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))")
    best = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "c", "l", "r")).alias("b"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(0, k - m), "
                   "s -> array_join(slice(w, s + 1, m), ' '))))")
    longer = candidates.filter("k > 2").select("lang", "k", "a", F.split("phrase", " ", -1).alias("w"))
    inside = longer.select("lang", "a", F.explode(inner).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left")
    covered = F.expr(f"100 * cast(longer as decimal(20, 0)) >= {int(keep_share)} * cast(a as decimal(20, 0))")
    return best.filter(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, lang: Column, text: Column, least: int = LEAST, top: int | None = TOP,
                 group_rows: int = GROUP_ROWS, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases (all, if null)."""
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    counts = word_counts(rows).filter((F.col("n") >= least) | F.col("word").isNull())
    counts = stored(counts, "frequent-words")
    words = counts.filter("word is not null")
    size = words.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    known = size <= known_bytes
    if known:
        # few enough for one task, so they are numbered from 1
        words = stored(words.coalesce(1).withColumn("id", F.monotonically_increasing_id() + 1), "numbered-words")
    else:
        @F.arrow_udf("long")
        def by_hash(langs: pa.Array, texts: pa.Array) -> pa.Array:
            return pa.array([letter(lang, w) for lang, w in zip(langs.to_pylist(), texts.to_pylist())], pa.int64())

        words = words.withColumn("id", by_hash("lang", "word"))
    pairs = stored(phrase_counts(suffix_rows(rows, words if known else None, 2), 2, least, group_rows), "pairs")
    few = pairs.count() * 16 <= known_bytes
    longer = suffix_rows(rows, words if known else None, DEPTH, pairs if few else None)
    found = pairs.unionByName(phrase_counts(longer, 3, least, group_rows))
    words = words.withColumn("word", F.col("word").cast("string"))
    found = spelled(found, words)
    single = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("a"))
    phrases = stored(found.unionByName(single), "phrases")
    # one row a language
    totals = counts.filter("word is null").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
