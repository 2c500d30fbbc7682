import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from custos.llm import phrases
from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[p:p + k]) for p in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = {p: a for p, a in c.items() if a >= least}
        rows = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            longer = [b for q, b in frequent.items() if len(q) > len(p)
                      and any(q[s:s + len(p)] == p for s in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def run(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, df["lang"], df["text"], **options).collect())


def test_whole_table_and_sql(spark, duck):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_multikey_collocations"](spark, SF001).collect())
    assert got and got == brute([(r["lang"], r["text"]) for r in docs.collect()], 30)
    assert got == sorted(duck.execute(ORACLE_SQL["op12_multikey_collocations"]).fetchall())


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(3)
    words = ["a", "B", "c", "d", "É", "f\x01", "g", "the", "x-y"]
    line = "same old line again"
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + line * (i % 3 == 0)))
    return rows


@pytest.mark.parametrize("options", [{}, {"group_rows": 10}, {"group_rows": 1}, {"known_bytes": 0},
                                     {"known_bytes": 0, "group_rows": 7}, {"top": 5}])
def test_routes_and_known_words_do_not_matter(spark, random_rows, options):
    df = spark.createDataFrame(random_rows, "lang string, text string").repartition(6)
    assert run(df, least=6, **options) == brute(random_rows, 6, options.get("top", 2000))


def test_suffixes_end_at_infrequent_words_and_pairs():
    codes = np.array([1, 2, 3, -1, 1, 2, 4, 1, 2])
    assert phrases.suffixes(codes).T.tolist() == [[1, 2, 3, 0], [2, 3, 0, 0], [1, 2, 4, 1], [2, 4, 1, 2], [4, 1, 2, 0], [1, 2, 0, 0]]
    assert phrases.suffixes(codes, 2).T.tolist() == [[1, 2, 0, 0], [2, 3, 0, 0], [1, 2, 0, 0], [2, 4, 0, 0], [4, 1, 0, 0], [1, 2, 0, 0]]
    pairs = np.sort(phrases.pair_keys(np.array([1, 2, 4]), np.array([2, 4, 1])))
    assert phrases.suffixes(codes, 4, pairs).T.tolist() == [[1, 2, 4, 1], [2, 4, 1, 2], [4, 1, 2, 0]]
    assert phrases.suffixes(codes, 4, pairs[:0]).shape == (4, 0)
    big = np.array([[1 << 40, 5, 1 << 40], [2, 2, 2], [-7, 0, -7], [0, 0, 0]])
    for w in (big, np.abs(big) % 7):
        batch = phrases.collapsed(w)
        rows = [tuple(r.values()) for r in batch.to_pylist()]
        want = Counter(map(tuple, w.T.tolist()))
        assert sorted(rows) == sorted((*k, n) for k, n in want.items())


def test_task_limits_do_not_matter(spark, random_rows, monkeypatch):
    monkeypatch.setattr(phrases, "_FLUSH", 50)
    monkeypatch.setattr(phrases, "_WORDS", 20)
    df = spark.createDataFrame(random_rows, "lang string, text string").repartition(3)
    assert run(df, least=6) == brute(random_rows, 6)


def test_equal_partitions_are_counts(monkeypatch):
    rng = np.random.default_rng(2)
    letters = rng.integers(0, 6, (4000, 4))
    letters[:, 1:] *= np.logical_and.accumulate(letters[:, :-1] > 0, 1)
    counts = rng.integers(1, 4, 4000)
    want = Counter()
    for row, n in zip(letters.tolist(), counts.tolist()):
        for k in range(2, 5):
            if 0 not in row[:k]:
                want[tuple(row[:k])] += n
    want = {p: n for p, n in want.items() if n >= 25}
    for small in (1, 64, 10_000):
        monkeypatch.setattr(phrases, "_SMALL", small)
        found = list(phrases.equal_partitions(letters, counts, 25, 2))
        assert {tuple(letters[r, :d].tolist()): n for r, d, n in found} == want and len(found) == len(want)


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    for options in ({}, {"known_bytes": 0, "group_rows": 3}):
        assert run(odd, least=2, **options) == brute(rows, 2)
    assert run(none) == []
    assert run(odd, least=10**6) == []
