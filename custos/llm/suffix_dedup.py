"""Exact removal of repeated byte strings with suffix arrays of routed shards.

A string of ``length`` bytes repeats when it starts at two places of the
corpus. Every such window has an anchor, the smallest hash of its short
grams (the leftmost, if equal), so equal windows have equal anchors. Windows
with one anchor are consecutive: they form a segment. Segments are routed by
their anchor's hash, so all copies of a window meet; a shard of segments is
sorted by induced sorting (:mod:`custos.llm.suffix_array`), and permuted
common prefixes of ``length`` bytes or more mark the repeated windows.

What travels: anchors seen once in the corpus are dropped by a semi-join on
their hashes; equal segments are one row with a weight (a weight of two marks
all its windows); an anchor with one distinct segment has nothing to be
compared with. Only the other distinct segments travel as bytes. An anchor
with more than ``group_segments`` distinct segments (a short line that very
many texts share, say) would fill a task: its windows are counted one by one
under 128-bit hashes, which any number of tasks can do, with the same result.

Texts are kept once per distinct text, bucketed by their digest, and are
joined with what was found by bucket, without moving again. Joins on hot keys
send the few rows that meet more than a thousandth of the other side (so at
most a thousand) to all tasks and shuffle the rest.

Nulls and odd rows: a null text has no bytes and removes none; a text shorter
than the window keeps all of them; repeated rows are different places, so all
lose what they share; a null id is kept; very long texts are one value each;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import HASHED_BYTES, cuts, discard, joined_grams, mixed, signed, sliding, starts_inside, stored
from custos.llm.suffix_array import permuted_common_prefixes, suffix_array
from custos.session import ensure_checkpoint_dir, is_local

LENGTH = 200
#: Most distinct segments of one anchor that a shard takes.
GROUP_SEGMENTS = 4096
#: Bytes of segments aimed at per shard.
SHARD_BYTES = 1 << 20
# A row that meets more than this share of the other side is sent to all tasks.
_HOT = 1000
# A segment's place: its first window, how many windows follow it, and where its anchor lies.
_BITS = 13


def gram_length(length: int) -> int:
    """Bytes of an anchor: short enough to have many places in a window, long enough to be rare."""
    return max(1, min(40, length // 5))


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of every ``k`` consecutive bytes."""
    h, have = mixed(np.arange(1, 257, dtype=np.uint64))[data], 1
    while have < k:
        shift = min(have, k - have)
        h = joined_grams(h, shift, shift)
        have += shift
    return mixed(h)


def anchored_segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(first window, last window, anchor, gram hash at the anchor)`` of every segment of concatenated texts."""
    k = gram_length(length)
    grams = byte_grams(data, k)
    width = length - k + 1
    if len(grams) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    # the high half decides, places break ties: the leftmost of the smallest
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding(keyed, width, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = starts_inside(ends, length)[:len(anchor)]
    edge = np.append(True, (anchor[1:] != anchor[:-1]) | ~inside[:-1])
    first = np.flatnonzero(edge & inside)
    stop = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True))
    return first, stop, anchor[first], grams[anchor[first]]


def segment_digest(text: bytes, first: int, more: int, anchor: int, length: int) -> int:
    return xxhash.xxh3_64_intdigest(text[first:first + more + length], seed=anchor)


def pack_place(first, more, anchor):
    return (first << (2 * _BITS)) | (more << _BITS) | anchor


def unpack_place(place):
    mask = (1 << _BITS) - 1
    return place >> (2 * _BITS), (place >> _BITS) & mask, place & mask


def _concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """``(h, sid, key, place, w)``: the segments of every text; ``w`` is 2 where the text itself has copies."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, column = batch.columns
            for lo, hi in cuts(column, HASHED_BYTES):
                part = column[lo:hi].to_pylist()
                data, ends = _concatenated(part)
                first, last, anchor, h = anchored_segments(data, ends, length)
                if not len(first):
                    continue
                row = np.searchsorted(ends, first, "right") - 1
                begin = first - ends[row]
                more, at = last - first, anchor - first
                sid = [segment_digest(part[r], b, m, a, length)
                       for r, b, m, a in zip(row.tolist(), begin.tolist(), more.tolist(), at.tolist())]
                again = np.minimum(copies[lo:hi].to_numpy(zero_copy_only=False), 2)
                yield pa.RecordBatch.from_arrays(
                    [signed(h), signed(np.array(sid, np.uint64)), keys.take(pa.array(row + lo)),
                     pa.array(pack_place(begin, more, at)), pa.array(again[row])], names=["h", "sid", "key", "place", "w"])

    return texts.select("key", "n", "text").mapInArrow(emit, "h long, sid long, key binary, place long, w long")


def join_by_weight(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``unique`` (one row a key, which meets ``weight`` of ``rows``).

    Keys that meet more than a thousandth of all are at most a thousand: they
    are sent to all tasks, so they never share one. The rest is shuffled.
    """
    total = unique.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * _HOT > total
    most, rest = unique.filter(hot).drop(weight), unique.filter(~hot).drop(weight)
    met = rows.join(F.broadcast(most), keys)
    left = rows.join(F.broadcast(most.select(*keys)), keys, "left_anti")
    return met.unionByName(left.join(rest, keys).select(*met.columns))


def shard_repeats(segments: list[bytes], weights: np.ndarray, length: int) -> pa.ListArray:
    """For each segment, the stretches (first window, behind the last) of its windows that repeat."""
    sizes = np.array([len(s) for s in segments])
    # a 0 ends every segment, bytes are moved up by one: 255 is no byte of UTF-8
    raw = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    text = (raw + np.uint8(1))
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    array = suffix_array(text)
    agree = permuted_common_prefixes(text.tobytes(), array, begins, int(sizes.max()) + 2)
    after = np.zeros(len(text), np.int64)
    after[array[:-1]] = agree[array[1:]]
    longest = np.maximum(agree, after)
    windows = sizes - length + 1
    # behind a segment's last window lies the rest of its bytes: no stretch goes on into the next one
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    hit = (longest >= length) | (weights > 1)[segment]
    hit &= np.arange(len(text)) < (begins + windows)[segment]
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    owner = segment[edges[::2]]
    return _lists(owner, (edges.reshape(-1, 2) - begins[owner][:, None]).ravel(), len(sizes), pa.int32())


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each value of the lists."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _lists(owner: np.ndarray, edges: np.ndarray, rows: int, kind: pa.DataType) -> pa.ListArray:
    """``edges`` as one list a row; ``owner`` has the row of each two of them, in order."""
    offsets = 2 * np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(edges, kind))


def _found_in_shards(segments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    size = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-size // shard_bytes))

    def sort(table: pa.Table) -> pa.Table:
        spans = shard_repeats(table.column("bytes").to_pylist(), table.column("w").to_numpy(), length)
        return pa.table([table.column("h"), table.column("sid"), table.column("rows"), spans],
                        names=["h", "sid", "rows", "spans"])

    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    return segments.select(shard.alias("shard"), "h", "sid", "rows", "w", "bytes").groupBy("shard").applyInArrow(
        sort, "h long, sid long, rows long, spans array<int>").filter(F.size("spans") > 0)


def _found_by_window(segments: DataFrame, length: int) -> DataFrame:
    """The same for segments of crowded anchors: windows under 128-bit hashes, counted by a shuffle."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, sid, rows, w, column = batch.columns
            for i, text in enumerate(column.to_pylist()):
                n = len(text) - length + 1
                digests = [xxhash.xxh3_128_digest(text[p:p + length]) for p in range(n)]
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                same = [c.take(pa.array(np.full(n, i))) for c in (h, sid, rows, w)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(n, dtype=np.int32))],
                    names=["h", "sid", "rows", "w", "a", "b", "p"])

    schema = "h long, sid long, rows long, w long, a long, b long, p int"
    each = stored(segments.select("h", "sid", "rows", "w", "bytes").mapInArrow(windows, schema), "windows")
    counts = each.groupBy("a", "b").agg(F.sum("w").alias("times"), F.count(F.lit(1)).alias("met"))
    counts = stored(counts.filter("times > 1").drop("times"), "repeated-windows")
    hit = join_by_weight(each, counts, ["a", "b"], "met")
    # the windows of one segment: at most the places of an anchor in a window
    hit = hit.groupBy("h", "sid", "rows").agg(F.array_sort(F.collect_set("p")).alias("p"))
    one = F.flatten(F.transform("p", lambda p: F.array(p, p + 1)))
    return hit.select("h", "sid", "rows", one.alias("spans"))


def _bucketed_texts(docs: DataFrame, text: Column) -> tuple[DataFrame, str, str]:
    """``(key, n, text)``: every distinct text once with its number of rows, bucketed by key; its name and folder."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))
    texts = rows.groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark, allow_local=is_local(spark)).rstrip('/')}/llm/{name}"
    (texts.repartition(parts, "key").write.bucketBy(parts, "key").option("path", path).option("compression", "zstd")
     .saveAsTable(name))
    return spark.table(name), name, path


def repeated_places(texts: DataFrame, length: int, group_segments: int, shard_bytes: int) -> DataFrame:
    """``(key, found)`` of every text with repeated windows: ``found`` lists ``(place, spans)`` of its segments."""
    places = stored(_segments(texts, length), "segments")
    twice = places.groupBy("h").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("met")).filter("w > 1").drop("w")
    met = stored(join_by_weight(places, stored(twice, "repeated-anchors"), ["h"], "met"), "repeated-segments")
    discard(places)
    distinct = met.groupBy("h", "sid").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("rows"),
                                           F.min(F.struct("key", "place")).alias("one"))
    distinct = stored(distinct, "distinct-segments")
    crowd = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "anchors")
    distinct = join_by_weight(distinct, crowd.withColumn("met", F.col("m")), ["h"], "met")
    distinct = stored(distinct, "crowded-segments")
    more = F.expr(f"cast((one.place >> {_BITS}) & {(1 << _BITS) - 1} as int)")
    alone = distinct.filter("m = 1").select("h", "sid", "rows", F.array(F.lit(0), more + 1).alias("spans"))
    # one text's segments: bounded by its bytes
    wanted = distinct.filter("m > 1").groupBy("one.key").agg(
        F.collect_list(F.struct("h", "sid", "rows", "w", "m", F.col("one.place").alias("place"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, wanted = batch.columns
            for lo, hi in cuts(column):
                own = wanted[lo:hi]
                row, flat = _owners(own), own.flatten()
                first, more, _ = unpack_place(flat.field("place").to_numpy())
                part = column[lo:hi].to_pylist()
                cut_out = [part[r][a:b] for r, a, b in zip(row.tolist(), first.tolist(), (first + more + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(flat.field(name) for name in ("h", "sid", "rows", "w", "m")), pa.array(cut_out, pa.binary())],
                    names=["h", "sid", "rows", "w", "m", "bytes"])

    cut_out = texts.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(
        cut, "h long, sid long, rows long, w long, m long, bytes binary")
    cut_out = stored(cut_out, "segment-bytes")
    found = alone.unionByName(_found_in_shards(cut_out.filter(F.col("m") <= group_segments), length, shard_bytes))
    crowded = cut_out.filter(F.col("m") > group_segments)
    if not crowded.isEmpty():
        found = found.unionByName(_found_by_window(crowded, length))
    found = stored(found, "found-segments")
    placed = join_by_weight(met, found, ["h", "sid"], "rows")
    return stored(placed.groupBy("key").agg(F.collect_list(F.struct("place", "spans")).alias("found")), "found-places")


def removed_runs(found: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first byte, behind the last)`` of the maximal runs of bytes in repeated windows, in order."""
    flat = found.flatten()
    text, first = _owners(found), unpack_place(flat.field("place").to_numpy())[0]
    spans = flat.field("spans")
    edges = spans.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
    owner = _owners(spans)[::2]
    text, first = text[owner], first[owner]
    begin, end = first + edges[:, 0], first + edges[:, 1] - 1 + length
    by = np.lexsort((begin, text))
    text, begin, end = text[by], begin[by], end[by]
    # texts one behind another, more than a byte apart: runs of two texts never touch
    room = int(end.max(initial=0)) + 2
    reach = np.maximum.accumulate(text * room + end)
    new = np.append(True, text[1:] * room + begin[1:] > reach[:-1])[:len(text)]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text))[:len(at)] - 1
    return text[at], begin[at], reach[last] - text[at] * room


def remove_repeats(docs: DataFrame, doc_id: Column, text: Column, length: int = LENGTH, with_bytes: bool = True,
                   group_segments: int = GROUP_SEGMENTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept_sha256, kept)`` for every row.

    ``spans`` lists the removed runs (first byte, behind the last); ``kept``
    holds the other bytes, which may end inside a character (null unless
    ``with_bytes``).
    """
    if not 2 <= length < 1 << _BITS:
        raise ValueError(f"the window must have 2 to {(1 << _BITS) - 1} bytes")
    spark = docs.sparkSession
    texts, name, path = _bucketed_texts(docs, text)
    found = repeated_places(texts, length, group_segments, shard_bytes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, column, found = batch.columns
            for lo, hi in cuts(column):
                part = column[lo:hi].to_pylist()
                text, begin, end = removed_runs(found[lo:hi], length)
                gone = np.zeros(len(part), np.int64)
                np.add.at(gone, text, end - begin)
                edges = _lists(text, np.stack([begin, end], 1).ravel(), len(part), pa.int64())
                kept = list(part)
                for i in np.unique(text).tolist():
                    e = edges[i].as_py()
                    kept[i] = b"".join([part[i][a:b] for a, b in zip([0, *e[1::2]], [*e[::2], len(part[i])])])
                digests = [hashlib.sha256(rest).hexdigest() for rest in kept]
                yield pa.RecordBatch.from_arrays(
                    [keys[lo:hi], copies[lo:hi], pa.array([len(t) for t in part], pa.int64()), pa.array(gone), edges,
                     pa.array(digests, pa.string()), pa.array(kept if with_bytes else [None] * len(part), pa.binary())],
                    names=["key", "n", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    schema = "key binary, n long, n_bytes long, n_removed long, spans array<long>, kept_sha256 string, kept binary"
    done = texts.join(found, "key", "left").select("key", "n", "text", "found").mapInArrow(finish, schema)
    done = stored(done, "cleaned-texts")
    spark.sql(f"DROP TABLE {name}")
    key = F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))
    rows = docs.select(doc_id.alias("doc_id"), key.alias("key"))
    return join_by_weight(rows, done, ["key"], "n").select(
        "doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept")
