import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from custos.llm import language_model as lm
from custos.llm.queries import QUERIES
from tests.llm.conftest import SF001


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def base(rows, learned):
    count = collections.Counter(t for i, text in rows if learned(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return {i: (len(tokens(text)), sum(count[t] > 0 for t in tokens(text)), n,
                sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(text))) for i, text in rows}


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    wanted = base(rows, lambda i: not held(i))
    got = QUERIES["op8_gated_recurrent_scores"](spark, SF001).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, score = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(score, rel=1e-9) and r["score"] < 0
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_rare_words_are_joined(spark, monkeypatch):
    """With a tiny table of frequent words nearly all counts come from the join: same scores."""
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(40)) + (" Unseen" if i % 5 == 0 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs["doc_id"] % 5 != 0
    one = {r["doc_id"]: r for r in lm.score(docs, docs["doc_id"], docs["text"], train, rounds=1).collect()}
    whole = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: whole(counts, 60))
    monkeypatch.setattr(lm, "OWN_CLASSES", 47)
    wanted = base(rows, lambda i: i % 5 != 0)
    for r in lm.score(docs, docs["doc_id"], docs["text"], train, rounds=1).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == wanted[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(wanted[r["doc_id"]][3]) == one[r["doc_id"]]["base_score"]


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    network = lm.Network.fresh(np.log(rng.dirichlet(np.ones(9))), hidden=5)
    h = rng.normal(size=(4, 5)).astype(np.float32)
    total = sum(np.exp(network.log_probabilities(h, np.full(4, y))) for y in range(9))
    assert total == pytest.approx(np.ones(4), abs=1e-5)


def test_gradients():
    rng = np.random.default_rng(3)
    network = lm.Network.fresh(np.log(rng.dirichlet(np.ones(6))), hidden=4)
    network = lm.Network(*[p.astype(np.float64) for p in network.parts()])
    x, y = rng.integers(0, 7, (5, 3)), rng.integers(0, 6, (5, 3))
    keep = np.ones((5, 3))
    keep[0], keep[3, 1] = 0, 0
    weight = np.ones((5, 3))
    weight[4, 2] = 0
    start = np.zeros((3, 4))
    _, grads, _ = network.gradients(x, y, keep, weight, start)
    for part, grad in zip(network.parts(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            old = part[at]
            loss = []
            for d in (1e-5, -1e-5):
                part[at] = old + d
                loss.append(network.gradients(x, y, keep, weight, start)[0] / weight.sum())
            part[at] = old
            assert grad[at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-4)


def test_state_is_carried_through_the_whole_text():
    rng = np.random.default_rng(5)
    network = lm.Network.fresh(np.log(rng.dirichlet(np.ones(8))), hidden=6)
    lengths = np.array([1, 200, 3, 77, 50, 1])
    classes = rng.integers(0, 8, lengths.sum()).astype(np.int16)
    expected, at = [], 0
    for n in lengths:
        own, h, before, total = classes[at:at + n], np.zeros((1, 6), np.float32), 8, 0.0
        for y in own:
            h = network.step(np.array([before]), h)[0]
            total += network.log_probabilities(h, np.array([y]))[0]
            before = y
        expected.append(total / np.log(10))
        at += n
    for lanes, window in ((1, 7), (3, 32), (256, 16)):
        assert lm.class_log10(network, classes, lengths, 8, lanes, window) == pytest.approx(expected, rel=1e-4)


def test_training_lowers_the_loss():
    network = lm.Network.fresh(np.log(np.full(4, 0.25)), hidden=8)
    classes = np.tile(np.array([0, 1, 2, 3], np.int16), 500)
    lengths = np.full(20, 100)
    before = lm.class_log10(network, classes, lengths, 4).sum()
    adam = lm.Adam(0.02)
    for _ in range(5):
        x, y, keep, text = lm.streams(classes, lengths, 4, 8)
        state = np.zeros((x.shape[1], 8), np.float32)
        for t in range(0, len(x), 16):
            part = slice(t, t + 16)
            _, grads, state = network.gradients(x[part], y[part], keep[part], (text[part] >= 0).astype(np.float32), state)
            adam.update(network.parts(), grads)
    assert lm.class_log10(network, classes, lengths, 4).sum() > 0.3 * before


def test_network_learns_from_every_training_document(spark, monkeypatch):
    """2.4 million tokens: more than any sample of a fixed size."""
    docs = spark.range(70).select(F.col("id").alias("doc_id"), F.expr("repeat('one two three four ', 10000)").alias("text"))
    given = []

    def learn(learned, words, rounds):
        given.append((learned.count(), words.tokens))
        return lm.Network.fresh(words.log_prior)

    monkeypatch.setattr(lm, "train_network", learn)
    lm.score(docs, docs["doc_id"], docs["text"], docs["doc_id"] % 7 != 2)
    assert given == [(60, 60 * 40_001)]


def test_rounds_hold_every_row_once(spark):
    rows = [(i if i % 9 else None, f"t{i}".encode()) for i in range(300)]
    learned = spark.createDataFrame(rows, "doc_id long, text binary")
    for rounds in (1, 2, 3):
        parts = [[bytes(r["text"]) for r in part.collect()] for part in lm.dealt_to_rounds(learned, rounds)]
        assert all(parts) and sorted(t for part in parts for t in part) == sorted(t for _, t in rows)


def test_odd_rows(odd, none):
    train = odd["doc_id"] % 2 == 1
    rows = lm.score(odd, odd["doc_id"], odd["text"], train, rounds=1).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in rows)
    null = next(r for r in rows if r["doc_id"] == 2)
    assert (null["n_tokens"], null["n_known"]) == (1, 1)
    twins = [tuple(r) for r in rows if r["doc_id"] == 6]
    assert len(twins) == 2 and twins[0] == pytest.approx(twins[1], rel=1e-6)
    assert lm.score(none, none["doc_id"], none["text"], F.lit(True), rounds=1).count() == 0
    alone = lm.score(odd, odd["doc_id"], odd["text"], F.lit(False), rounds=1).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in alone} == {(0, 0)} and len(alone) == len(rows)


def test_tokens_without_a_python_value_for_each(monkeypatch):
    """Tokens of a text are worked out in arrays; a counted word is hashed apart once a group of texts."""
    texts = ["Ab c ÄÖü x.", None, "", " ab  C abcdefg. ", "é" * 50 + " Z"]
    flat = [t for text in texts for t in tokens(text)]
    h, ending, n = lm.tokens_of([t.encode() if t is not None else None for t in texts])
    assert n.tolist() == [len(tokens(t)) for t in texts]
    assert ending.tolist() == [-1 if t is None else lm.ending_class(t) for t in flat]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(h.tolist(), flat)))
    assert (h == lm.END).tolist() == [t is None for t in flat]


def test_own_words_are_found_by_either_way():
    rng = np.random.default_rng(2)
    for own in (np.sort(rng.integers(1, 1 << 63, 9).astype(np.uint64)), np.arange(5, 14, dtype=np.uint64)):
        words = lm.Vocabulary(1, 1, own, rng.permutation(9) + 80, own, own, own, own)
        h = np.concatenate([own, own[:3] + np.uint64(100), own[::-1]])
        want = [*words.own_class, 7, 7, 7, *words.own_class[::-1]]
        assert words.class_of(h, np.full(len(h), 7, np.int16)).tolist() == want
