import random

import numpy as np
import pyarrow as pa
import pytest

from custos.llm import common
from custos.llm.components import connected_components


def test_word_patterns():
    import re
    text = "Ab,c1 \x0b ÄÖ-x y\x1cz\t!"
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    decode = lambda words: [w.decode() for w in words]
    assert decode(common.alnum_words(text.encode())) == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    assert decode(common.space_words(text.encode())) == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert decode(common.lower_space_words(text.encode())) == re.findall(r"[^\x20\x09-\x0D]+", low)


def test_word_hashes_do_not_depend_on_the_cache():
    small, large = common.WordHashes(common.space_words, limit=2), common.WordHashes(common.space_words)
    for texts in ([b"a b c d", None, b""], [b"d c b a"], [b"a a"]):
        a, b = small.of(texts), large.of(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert common.WordHashes(common.space_words).of([b"a", b"", b"b c"], pad=3)[1].tolist() == [0, 3, 3, 6]


@pytest.mark.parametrize("width", [1, 2, 3, 6, 7, 27])
def test_sliding_and_winnow(width):
    rng = np.random.default_rng(width)
    values = rng.integers(1, 50, 200).astype(np.uint64)
    expected = [values[i:i + width].min() for i in range(len(values) - width + 1)]
    assert common.sliding(values, width, np.minimum).tolist() == expected
    ends = np.array([0, 40, 41, 200])
    inside = common.starts_inside(ends, width)
    picked = common.winnow(values, inside, width)
    wanted = set()
    for p in range(len(values)):
        if inside[p]:
            window = values[p:p + width]
            wanted |= {p + i for i in np.flatnonzero(window == window.min())}
    assert set(np.flatnonzero(picked)) == wanted


def test_grams_join_to_longer_grams():
    words = np.random.default_rng(1).integers(0, 1 << 60, 50).astype(np.uint64)
    assert (common.joined_grams(common.gram_hashes(words, 4), 4, 4) == common.gram_hashes(words, 8)).all()
    assert len(common.gram_hashes(words[:3], 4)) == 0


def test_cuts_and_whole_groups():
    texts = pa.array([b"x" * 5, None, b"y" * 20, b"z"])
    assert list(common.cuts(texts, 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(common.cuts(pa.array([], pa.binary()))) == []
    batches = [pa.record_batch({"a": [1, 1, 2], "v": [1, 2, 3]}), pa.record_batch({"a": [2, 3], "v": [4, 5]})]
    assert [g.column("v").to_pylist() for g in common.whole_groups(batches, ["a"])] == [[1, 2], [3, 4], [5]]


def test_word_hashes_of_other_seeds():
    one, other = common.WordHashes(common.space_words), common.WordHashes(common.space_words, seed=1)
    texts = [b"a b a", None, b"", b"c"]
    (h, ends), (g, _) = one.of(texts), other.of(texts)
    assert ends.tolist() == [0, 3, 3, 3, 4] and h[0] == h[2] and g[0] == g[2]
    assert len({*h.tolist(), *g.tolist()}) == 6


def test_components_match_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)]
    edges += [(300, 300), (None, 5), (7, None)] + [(400, 400 + i) for i in range(1, 60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_hashed_at_once(monkeypatch):
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"ab \x09\x0b\x0d\x1c\x85\xc3") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, b"", b"  ", b"x" * 70 + b"y", b"y" + b"x" * 70, b"x" * 64 + b" " + b"x" * 128, b"ab ba"]
    flat = [w for t in texts for w in (t or b"").split()]
    n = [len((t or b"").split()) for t in texts]
    (one, other), ends = common.word_hashes(texts, (0, 1))
    assert ends.tolist() == np.append(0, np.cumsum(n)).tolist()
    for h in (one, other):
        assert len(set(zip(h.tolist(), flat))) == len(set(h.tolist())) == len(set(flat))
    assert not (one == other).any()
    for none in ([], [None], [b" ", b""]):
        assert common.word_hashes(none)[1].tolist() == [0] * (len(none) + 1)
    monkeypatch.setattr(common, "HASHED_BYTES", 40)
    (again,), places = common.word_hashes(texts)
    assert (again == one).all() and (places == ends).all()


@pytest.mark.parametrize("values", [[], [5], [1 << 60, 3, 1 << 60, 3, 4], [(1 << 60) + i % 3 for i in range(50)],
                                    [(i * i % 37) << 50 for i in range(200)]])
def test_different_hashes(values):
    at, back = common.different(np.array(values, np.uint64))
    assert len(at) == len(set(values)) and [values[at[i]] for i in back.tolist()] == values
