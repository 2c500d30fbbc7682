"""Helpers shared by the operators: words, word hashes and stored tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custos.session import ensure_checkpoint_dir, is_local

# Words of letters, digits and non-ASCII characters, A-Z lower-cased; everything else separates.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
# Text bytes worked on at a time inside a task.
CHUNK_BYTES = 4 << 20


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, unchanged."""
    return text.split()


def lower_space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text with A-Z lower-cased."""
    return text.lower().split()


class WordHashes(dict):
    """Cached 64-bit hashes of words; emptied beyond ``limit`` words or 32 MB of them, so its memory is bounded.

    Different seeds give independent hashes.
    """

    def __init__(self, split: Callable[[bytes], list[bytes]], limit: int = 300_000, seed: int = 0) -> None:
        super().__init__()
        self.split, self.limit, self.bytes, self.seed = split, limit, 0, seed
        self.raw = array("Q")

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self.raw)
        self.bytes += len(word)
        self.raw.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return slot

    def of(self, texts: Iterable[bytes | None], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after another, and where each text starts (and the last ends).

        Texts of fewer than ``pad`` words, but not none, are filled up with empty words.
        """
        if len(self) > self.limit or self.bytes > 32 << 20:
            self.clear()
            self.raw, self.bytes = array("Q"), 0
        get, parts, ends = self.__getitem__, [], [0]
        for text in texts:
            words = self.split(text) if text else ()
            if 0 < len(words) < pad:
                words += [b""] * (pad - len(words))
            parts.append(np.fromiter(map(get, words), np.int64, len(words)))
            ends.append(ends[-1] + len(words))
        slots = np.concatenate(parts) if parts else np.empty(0, np.int64)
        return np.array(self.raw, dtype=np.uint64)[slots], np.array(ends, np.int64)


def hashed_words(texts: list[bytes], seeds: Sequence[int] = (0,)
                  ) -> tuple[bytes, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """``(data, begins, ends, hashes)`` of the words ``[^\\x20\\x09-\\x0D]+`` of texts, and how many words each text has.

    A word's hash is the sum of random values, one for each byte at its place; a long word's is made of it at once.
    """
    data = b" " + b" ".join(texts) + b" "
    codes = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    text_begin = 1 + np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    n = np.diff(np.searchsorted(begin, text_begin))
    if not len(size):
        return data, begin, end, [np.empty(0, np.uint64)] * len(seeds), n
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    place &= _PLACES - 1
    place <<= 8
    place |= codes[inside]
    hashes = [np.add.reduceat(_BYTE_AT[seed].take(place), first) for seed in seeds]
    for i in np.flatnonzero(size > _PLACES).tolist():
        for own, seed in zip(hashes, seeds):
            own[i] = xxhash.xxh3_64_intdigest(data[begin[i]:end[i]], seed)
    return data, begin, end, hashes, n


def byte_groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Texts (null: empty) in groups of about ``HASHED_BYTES``."""
    room, group = HASHED_BYTES, []
    for text in texts:
        group.append(text or b"")
        room -= len(group[-1])
        if room <= 0:
            yield group
            room, group = HASHED_BYTES, []
    if group:
        yield group


def different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hashes: a place of each different one, and which of them stands at each place."""
    # the hash's high bits and the place in one number; the whole hash decides
    mask = np.uint64((1 << len(h).bit_length()) - 1)
    keyed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    keyed.sort()
    order = (keyed & mask).astype(np.int64)
    whole, high = h[order], keyed & ~mask
    new = np.append(True, whole[1:] != whole[:-1])[:len(h)]
    if not np.array_equal(new[1:], high[1:] != high[:-1]):
        order = np.argsort(h, kind="stable")
        whole = h[order]
        new = np.append(True, whole[1:] != whole[:-1])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def word_hashes(texts: list[bytes | None], seeds: Sequence[int] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts one after another, independent ones by seed
    (0 or 1), and where each text starts (and the last ends)."""
    parts = [hashed_words(group, seeds) for group in byte_groups(texts)]
    hashes = [np.concatenate([np.empty(0, np.uint64), *(p[3][i] for p in parts)]) for i in range(len(seeds))]
    return hashes, np.cumsum(np.concatenate([[0], *(p[4] for p in parts)])).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (every output bit depends on every input bit)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
# Bytes of words, by seed the value of a byte at each of the first places of a word, and text bytes hashed at a time
# (their arrays of 64-bit values stay in a core's cache).
_IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_PLACES = 64
_BYTE_AT = mixed(np.arange(1, 512 * _PLACES + 1, dtype=np.uint64) * np.uint64(_BASE)).reshape(2, 256 * _PLACES)
HASHED_BYTES = 1 << 18


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of every ``k`` consecutive words (before :func:`mixed`); windows may cross texts."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i:i + n]
    return out


def joined_grams(grams: np.ndarray, length: int, shift: int, start: int = 0) -> np.ndarray:
    """Hashes of longer windows: the window at ``p`` of ``length`` words and the one at ``p + shift``.

    With ``shift == length`` the window doubles; a smaller shift lets the halves overlap.
    """
    n = max(0, len(grams) - shift)
    power = np.uint64(pow(_BASE, length, 1 << 64))
    return grams[:n] * power + grams[shift:shift + n]


def starts_inside(ends: np.ndarray, length: int) -> np.ndarray:
    """For concatenated texts: whether a window of ``length`` words starting at each word stays in its text."""
    n = int(ends[-1])
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)
    return left >= length


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (``np.minimum`` or ``np.maximum``) over every ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = op(out[:max(0, len(out) - span)], out[span:])
        span *= 2
    rest = width - span
    return op(out[:max(0, len(out) - rest)], out[rest:]) if rest else out


def winnow(values: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Which values are the smallest of some window of ``width`` consecutive values (ties all count).

    ``inside[p]`` says whether the window starting at ``p`` lies in one text. Selection looks at values
    only, so equal stretches of words select equal places.
    """
    low = sliding(values, width, np.minimum)
    low = np.where(inside[:len(low)], low, np.uint64(0))
    # the windows that hold place q start at q-width+1 .. q
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low,
                             np.zeros(len(values) - len(low), np.uint64)])
    best = sliding(padded, width, np.maximum)[:len(values)]
    return (best == values) & (best > 0)


def cuts(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow binary array that hold about ``limit`` bytes each (one row at least)."""
    begin, room = 0, limit
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if room < size and i > begin:
            yield begin, i
            begin, room = i, limit
        room -= size
    if len(texts) > begin:
        yield begin, len(texts)


def packed(docs: DataFrame, carry: Sequence[str] | None = None, name: str = "doc") -> Column:
    """The columns of ``docs`` (or those in ``carry``) as one struct, so no name can clash with a working column."""
    return F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)]).alias(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the session's shared checkpoint folder and read back.

    Cuts lineage: a lost executor cannot change it, and later readers do not
    recompute it. The folder is the one the cluster names in
    ``spark.checkpoint.dir``; a local session without one uses a fresh folder.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark, allow_local=is_local(spark)).rstrip("/")
    path = f"{root}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_in = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of tables that :func:`stored` wrote and nothing will read again."""
    for frame in frames:
        path = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._stored_in)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, cut into tables of whole groups: one table for each key."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not part.num_rows:
            continue
        columns = [part.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        begin = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > begin:
                    held.append(part.slice(begin, i - begin))
                if held:
                    yield pa.concat_tables(held)
                held, begin, last = [], i, key
        held.append(part.slice(begin))
    if held:
        yield pa.concat_tables(held)


def give_back_memory() -> None:
    """Free memory of this Python worker goes back to the machine: Spark uses a worker again for the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this library where the driver has it.

    Enough where that folder is on every machine, as in a local session; on a
    cluster without it, pass the library with ``--py-files`` as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
