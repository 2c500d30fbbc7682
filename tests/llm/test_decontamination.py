import re

import pytest
from pyspark.sql import functions as F

from custos.llm import decontamination as dc
from custos.llm.oracles import ORACLE_SQL
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(docs, bench, **kw):
    found = dc.find(docs, docs["text"], bench, bench["item_id"], bench["text"], **kw)
    found = found.select("doc_id", "match.n_words", dc.words_hit(F.col("match.spans")), dc.item_ids(F.col("match.spans")))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_whole_table_against_sql(spark, duck):
    wanted = duck.sql(ORACLE_SQL["op7_winnowing_decontamination"]).fetchall()
    got = [tuple(r) for r in QUERIES["op7_winnowing_decontamination"](spark, SF001).collect()]
    assert sorted(got) == sorted(wanted) and any(r[-1] for r in got)


ITEM = "a b c d e f g h i j k l m n o p q r s t"
ITEMS = [(1, ITEM), (2, "u v w"), (3, "One-two THREE"), (4, ""), (5, None), (6, "..."), (None, "null id item"), (2, "u v w"),
         (7, "z " * 25), (8, "e f g h i j k l m n")]
DOCS = [(1, ITEM), (2, "x " + ITEM[:19] + " x"), (3, ITEM[:17] + " x " + ITEM[20:]), (4, "x u, V w! one two three x"),
        (5, None), (6, ""), (7, "y " + "z " * 9), (8, "z " * 40 + ITEM), (None, "the null ID item here"), (9, ITEM.upper() * 2),
        (10, "a b c d e f g h i j"), (10, "a b c d e f g h i j"), (11, ("filler " * 5000) + ITEM)]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_spans_short_items_sent_or_shuffled(spark, threshold):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, threshold)
    try:
        assert run(docs, bench) == brute(DOCS, ITEMS)
    finally:
        spark.conf.set(key, before)


def test_spans_are_whole_stretches(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM + " y " + ITEM[:21] + " u v w")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "u v w"), (8, ITEM[8:28])], "item_id long, text string")
    found = dc.find(docs, docs["text"], bench, bench["item_id"], bench["text"]).first()["match"]
    assert [tuple(s) for s in found["spans"]] == [(1, 20, "1"), (5, 14, "8"), (22, 32, "1"), (33, 35, "2")]


def test_a_fingerprint_in_most_items_and_documents(spark):
    common = "what is the right answer to"
    items = [(i, f"{common} question {i} a{i} b{i} c{i} d{i} e{i}") for i in range(60)]
    rows = [(d, f"say {common} this " + (items[d][1] if d % 7 == 0 and d < 60 else f"p{d} q{d} r{d} s{d} t{d}"))
            for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert run(docs, bench) == brute(rows, items)


def test_word_hashes_are_those_of_the_words(monkeypatch):
    import random
    monkeypatch.setattr(dc, "PIECE_BYTES", 50)
    rng = random.Random(4)
    texts = [None, b"", b"...", "Été é Z z".encode(), b"x" * 5000, b" " * 3000 + b"A-b" * 2000]
    texts += [bytes(rng.choice(b"abAB09 \x00\x7f\xc3\xa9.,[`{") for _ in range(rng.randrange(60))) for _ in range(300)]
    hashes, ends = dc.word_hashes(texts)
    split = [dc.alnum_words(t) if t else [] for t in texts]
    assert ends.tolist() == [sum(map(len, split[:i])) for i in range(len(texts) + 1)]
    flat = [w for words in split for w in words]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    assert [len(x) for x in dc.word_hashes([])] == [0, 1] and [len(x) for x in dc.word_hashes([None])] == [0, 2]


def test_every_long_shared_span_is_found():
    import random

    import numpy as np
    rng = random.Random(2)
    for _ in range(200):
        item = [rng.choice("abcd") for _ in range(30)]
        start = rng.randrange(0, 20)
        doc = [rng.choice("abcd") for _ in range(rng.randrange(0, 15))] + item[start:start + 10] + ["q"] * rng.randrange(0, 15)
        (words, ends), (own, own_ends) = (dc.word_hashes([" ".join(x).encode()]) for x in (doc, item))
        places, prints = dc.fingerprints(words, ends)
        starts = dc.windows_around(places[np.isin(prints, dc.fingerprints(own, own_ends)[1])], ends)
        covered = np.zeros(len(doc), bool)
        for s in starts[np.isin(dc.mixed(dc.gram_hashes(words, 10))[starts], dc.windows(own, own_ends, 10)[1])]:
            covered[s:s + 10] = True
        wanted = np.zeros(len(doc), bool)
        wins = {tuple(item[i:i + 10]) for i in range(21)}
        for i in range(len(doc) - 9):
            if tuple(doc[i:i + 10]) in wins:
                wanted[i:i + 10] = True
        assert (covered == wanted).all() and wanted.any()


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd, bench) == brute(rows, ITEMS)
    assert dc.find(none, none["text"], bench, bench["item_id"], bench["text"], name="m2").count() == 0
    replaced = dc.find(odd, odd["text"], bench, bench["item_id"], bench["text"])
    assert sorted(replaced.columns) == sorted(odd.columns) and "spans" in replaced.schema["match"].dataType.names
    assert run(odd, spark.createDataFrame([], "item_id long, text string")) == brute(rows, [])
