import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from custos.llm import suffix_array, suffix_dedup
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        kept = bytes(b for b, g in zip(t, gone.tolist()) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(df, length, **options):
    rows = suffix_dedup.remove_repeats(df, df["doc_id"], df["text"], length, **options).collect()
    return sorted(((*r[:5], bytes(r["kept"])) for r in rows), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_induced_suffix_dedup"](spark, SF001).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 200)
    assert got == sorted(((i, n, gone, len(spans) // 2, digest) for i, n, gone, spans, digest, _ in want), key=str)
    assert sum(r[2] for r in got) > 0


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    rows = []
    for i in range(80):
        own = "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 80)))
        at = rng.randrange(0, 60)
        rows.append((i % 70, own + passage[at:at + rng.randrange(40)] * rng.choice([1, 1, 3]) + own[::-1] + "z" * rng.choice([0, 0, 60])))
    return rows + rows[:5]


@pytest.mark.parametrize("length,options", [(2, {}), (13, {}), (31, {}), (13, {"group_segments": 2}), (31, {"group_segments": 1}),
                                            (13, {"shard_bytes": 100})])
def test_random_texts(spark, random_rows, length, options):
    df = spark.createDataFrame(random_rows, "doc_id long, text string").repartition(4)
    assert run(df, length, **options) == brute(random_rows, length)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd, 20) == brute(rows, 20)
    assert run(none, 20) == []
    with pytest.raises(ValueError):
        run(odd, 1)


def test_no_table_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")
    run(df, 3)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_suffix_arrays_of_random_strings(monkeypatch):
    rng = random.Random(1)
    for trial in range(300):
        monkeypatch.setattr(suffix_array, "_STRETCH", rng.choice([2, 16, 512]))
        monkeypatch.setattr(suffix_array, "_SHORT", rng.choice([0, 2, 16]))
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 250])) for _ in range(rng.randrange(1, 90)))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array.suffix_array(np.frombuffer(s, np.uint8)).tolist() == want
        agree = [0] * len(s)
        for a, b in zip(want, want[1:]):
            while max(a, b) + agree[b] < len(s) and s[a + agree[b]] == s[b + agree[b]]:
                agree[b] += 1
        got = suffix_array.permuted_common_prefixes(s, np.array(want), np.array([0]), 100)
        assert got.tolist() == agree
    names = [rng.randrange(2000) for _ in range(3000)]
    assert suffix_array.suffix_array(np.array(names)).tolist() == sorted(range(3000), key=lambda i: names[i:])
    assert suffix_array.suffix_array(np.empty(0, np.int64)).tolist() == []


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)), np.uint8)
    ends = np.array([0, 700, 705, 3000])
    first, last, anchor, h = suffix_dedup.anchored_segments(data, ends, 12)
    seen, covered = {}, set()
    for f, t, a, x in zip(first.tolist(), last.tolist(), anchor.tolist(), h.tolist()):
        for p in range(f, t + 1):
            covered.add(p)
            assert seen.setdefault(data[p:p + 12].tobytes(), (x, a - p)) == (x, a - p)
    assert covered == {p for b, e in zip(ends, ends[1:]) for p in range(b, e - 11)}


def test_names_are_sorted_without_recursion(monkeypatch):
    """Two inductions of two scans each, however deep the repeats; the recursion gives the same order."""
    rng = random.Random(9)
    passage = bytes(rng.choice(b"abcd") for _ in range(700))
    data = np.frombuffer(b"".join(passage[rng.randrange(300):] for _ in range(9)), np.uint8)
    want = sorted(range(len(data)), key=lambda i: data.tobytes()[i:])
    scans, whole = [], suffix_array._Induction._scan
    monkeypatch.setattr(suffix_array._Induction, "_scan", lambda *a: scans.append(1) or whole(*a))
    assert suffix_array.suffix_array(data).tolist() == want and len(scans) == 4
    monkeypatch.setattr(suffix_array, "_RANK_BITS", 0)
    assert suffix_array.suffix_array(data).tolist() == want and len(scans) > 8


def test_runs_of_sliced_lists():
    rng = random.Random(2)
    length, found = 5, []
    for _ in range(40):
        found.append(rng.choice([None, []]) if rng.random() < 0.3 else [
            {"place": suffix_dedup.pack_place(rng.randrange(60), 3, 1), "spans": rng.choice([[], [0, 2], [0, 1, 4, 9]])}
            for _ in range(rng.randrange(1, 4))])
    kind = pa.list_(pa.struct([("place", pa.int64()), ("spans", pa.list_(pa.int32()))]))
    text, begin, end = suffix_dedup.removed_runs(pa.array([found[0], *found], kind)[1:], length)
    for i, own in enumerate(found):
        gone = np.zeros(100, bool)
        for f in own or ():
            at = suffix_dedup.unpack_place(f["place"])[0]
            for a, b in zip(f["spans"][::2], f["spans"][1::2]):
                gone[at + a:at + b - 1 + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        assert np.stack([begin[text == i], end[text == i]], 1).ravel().tolist() == edges.tolist()
