"""Document scoring with a gated recurrent language model in numpy.

The output softmax is factored by word classes: the recurrent network gives
the probability of the next token's class after all tokens before it in the
document, and corpus counts the probability of the token in its class. The
most frequent words and the end of the text are classes of their own; all
other words, seen or not, fall in classes by a hash of their last bytes (the
endings tell languages, punctuation and word forms apart).

Counts cover all training documents: they are summed by word hash in a
shuffle. The network learns by truncated backpropagation on every training
document once, however many there are. A hash deals the documents to
``ROUNDS`` rounds; in each every task goes on from the same weights over its
own documents of the round, and their results are averaged. Scoring carries
the state from window to window, so a document's probability is that of the
whole document, however long.

A token's count is looked up in two ways: the most frequent words
(``FREQUENT``, a table of bounded size) inside the scoring task, all others
by a join on the word's hash.

Nulls and odd rows: a null text is empty and has the end token only; a null
id is neither held out nor learned from; repeated rows count as often as they
occur and score alike; an empty table gives an empty result, and without
training documents every token is unknown.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import byte_groups, cuts, different, hashed_words, signed, stored

# Words with a class of their own, and classes of all other words.
OWN_CLASSES = 47
ENDING_CLASSES = 80
HIDDEN = 24
WINDOW = 16
LANES = 256
SCORE_LANES = 256
# States whose softmax is worked out at a time: its numerators stay in a core's cache.
SOFTMAX_ROWS = 512
ROUNDS = 2
RATE = 0.01
FREQUENT = 1 << 18
# Tokens a task works on at a time.
BUFFER_TOKENS = 4_000_000
END = xxhash.xxh3_64_intdigest(b"")  # words are never empty


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


_CRC = _crc_table()


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDING_CLASSES


def ending_classes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`ending_class` of the words of ``data`` at the given places."""
    codes, crc = np.frombuffer(data, np.uint8), np.full(len(end), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        at = end - back
        more = _CRC[(crc ^ codes[at]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        crc = np.where(at >= begin, more, crc)
    return (~crc % np.uint32(ENDING_CLASSES)).astype(np.int16)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, ending classes, lengths)`` of texts one after another, each closed by the end token (class -1)."""
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int16), np.empty(0, np.int64))]
    for group in byte_groups([text.lower() if text else None for text in texts]):
        data, begin, end, (h,), n = hashed_words(group)
        parts.append((h, ending_classes(data, begin, end), n))
    h, ending, n = (np.concatenate(x) for x in zip(*parts))
    ends = np.cumsum(n)
    return np.insert(h, ends, np.uint64(END)), np.insert(ending, ends, -1), n + 1


class Room(dict):
    """Working arrays by name, used again for every window: fresh ones cost more than the sums in them."""

    def array(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        found = self.get(name)
        if found is None or found.shape != shape or found.dtype != dtype:
            found = self[name] = np.empty(shape, dtype)
        return found


@dataclass
class Network:
    """Gated recurrent unit over classes. Class ``inputs - 1`` stands for the beginning of a text."""

    table: np.ndarray   # inputs x 3H: what an input adds to update gate, reset gate and candidate
    inner: np.ndarray   # H x 3H
    bias: np.ndarray    # H: inside the reset candidate
    out: np.ndarray     # H x classes
    prior: np.ndarray   # classes

    @classmethod
    def fresh(cls, log_prior: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = len(log_prior)
        normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        return cls(normal(n + 1, 3 * hidden, s=0.3), normal(hidden, 3 * hidden, s=hidden ** -0.5),
                   np.zeros(hidden, np.float32), normal(hidden, n, s=0.05), log_prior.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32).tobytes()

    def unpacked(self, data: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(data[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def split(self) -> tuple[np.ndarray, ...]:
        """What :meth:`step` multiplies with: tables and inner weights of the gates, negative, and of the candidate."""
        k = len(self.bias)
        return (-self.table[:, :2 * k], np.ascontiguousarray(self.table[:, 2 * k:]),
                -self.inner[:, :2 * k], np.ascontiguousarray(self.inner[:, 2 * k:]))

    def step(self, x: np.ndarray, h: np.ndarray, split: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
        k = h.shape[1]
        gate_table, new_table, gate_inner, new_inner = split or self.split()
        gates = h @ gate_inner
        gates += gate_table.take(x, 0)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :k], gates[:, k:]
        m = h @ new_inner
        m += self.bias
        n = r * m
        n += new_table.take(x, 0)
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, m, n

    def softmax(self, h: np.ndarray, y: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numerators after each state but for a factor of each class, these factors, the sums of the whole numerators, and
        the logarithm of the numerator of class ``y``."""
        p = np.matmul(h, self.out, out=room.array("softmax", len(h), self.out.shape[1], dtype=h.dtype))
        own, factor = p[np.arange(len(p)), y] + self.prior[y], np.exp(self.prior)
        # states lie in (-1, 1): what no logit can exceed needs no shift
        if (np.abs(self.out).sum(0) + np.abs(self.prior)).max() > 60:
            p += self.prior
            top = p.max(1, keepdims=True)
            p -= top
            own -= top[:, 0]
            factor = np.ones_like(factor)
        np.exp(p, out=p)
        return p, factor, p @ factor, own

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Natural log-probability of class ``y`` after each state."""
        room, out = room or Room(), np.empty(len(h), h.dtype)
        for lo in range(0, len(h), SOFTMAX_ROWS):
            part = slice(lo, lo + SOFTMAX_ROWS)
            _, _, total, own = self.softmax(h[part], y[part], room)
            out[part] = own - np.log(total)
        return out

    def gradients(self, x, y, keep, weight, h, room: Room | None = None):
        """Loss, gradients and last state of one window (``steps x lanes`` arrays), by backpropagation inside it."""
        steps, lanes = x.shape
        k = h.shape[1]
        room = room or Room()
        begun, states, z, r, m, n, by_n, by_z, by_r, one = room.array("cells", 10, steps, lanes, k)
        split = self.split()
        for t in range(steps):
            np.multiply(h, keep[t][:, None], out=begun[t])
            h, z[t], r[t], m[t], n[t] = self.step(x[t], begun[t], split)
            states[t] = h
        flat = states.reshape(-1, k)
        w, targets, loss = weight.ravel(), y.ravel(), 0.0
        share = w / max(1.0, w.sum())
        d_out, d_prior = np.zeros_like(self.out), np.zeros_like(self.prior)
        d_states = room.array("states", len(flat), k, dtype=self.out.dtype)
        for lo in range(0, len(flat), SOFTMAX_ROWS):
            part = slice(lo, lo + SOFTMAX_ROWS)
            own_states, own_y = flat[part].astype(self.out.dtype, copy=False), targets[part]
            p, factor, total, own = self.softmax(own_states, own_y, room)
            loss -= ((own - np.log(total)) * w[part]).sum()
            # the gradient of a logit is p times its class's factor times the state's, so both are left out of the large array
            p[np.arange(len(p)), own_y] -= total / factor[own_y]
            by_state = share[part] / total
            d_out += ((own_states * by_state[:, None]).T @ p) * factor
            d_prior += (by_state @ p) * factor
            np.matmul(p, (self.out * factor).T, out=d_states[part])
            d_states[part] *= by_state[:, None]
        d_states = d_states.reshape(steps, lanes, k)
        # what a state's gradient is multiplied by, for all steps at once
        np.subtract(1, z, out=one)
        np.multiply(n, n, out=by_n)
        np.subtract(1, by_n, out=by_n)
        by_n *= one
        np.subtract(begun, n, out=by_z)
        by_z *= z
        by_z *= one
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= m
        d_in, d_hidden = room.array("inputs", 2, steps, lanes, 3 * k)
        dh = np.zeros((lanes, k), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += d_states[t]
            du = d_hidden[t]
            dn = dh * by_n[t]
            np.multiply(dh, by_z[t], out=du[:, :k])
            np.multiply(dn, by_r[t], out=du[:, k:2 * k])
            np.multiply(dn, r[t], out=du[:, 2 * k:])
            d_in[t, :, 2 * k:] = dn
            dh *= z[t]
            dh += du @ self.inner.T
            dh *= keep[t][:, None]
        d_in[..., :2 * k] = d_hidden[..., :2 * k]
        d_hidden = d_hidden.reshape(-1, 3 * k)
        d_inner, d_bias = begun.reshape(-1, k).T @ d_hidden, (np.ones(len(d_hidden), d_hidden.dtype) @ d_hidden)[2 * k:]
        order = np.argsort(x, axis=None, kind="stable")
        used, first = np.unique(x.ravel()[order], return_index=True)
        d_table = np.zeros(self.table.shape, np.float32)
        by_input = np.take(d_in.reshape(-1, 3 * k), order, 0, out=room.array("sorted", len(order), 3 * k), mode="clip")
        d_table[used] = np.add.reduceat(by_input, first, 0)
        return loss, [d_table, d_inner, d_bias, d_out, d_prior], h


@dataclass
class Adam:
    rate: float
    steps: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def update(self, parts: list[np.ndarray], grads: list[np.ndarray]) -> None:
        g = np.concatenate([x.ravel() for x in grads])
        if self.first is None:
            self.first, self.second = np.zeros_like(g), np.zeros_like(g)
        self.steps += 1
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        rate = self.rate * float(np.sqrt(1 - 0.999 ** self.steps)) / (1 - 0.9 ** self.steps)
        self.first *= 0.9
        self.first += 0.1 * g
        self.second *= 0.999
        g *= g
        g *= 0.001
        self.second += g
        np.sqrt(self.second, out=g)
        g += 1e-8
        np.divide(self.first, g, out=g)
        g *= rate
        at = 0
        for p in parts:
            p -= g[at:at + p.size].reshape(p.shape)
            at += p.size


def lanes_of(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, longest first; fewer lanes where one text is very long."""
    n = int(np.clip(lengths.sum() // max(1, lengths.max(initial=1)), 1, most))
    n = max(n, min(8, len(lengths)))
    lanes: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for text in np.argsort(-lengths, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        lanes[lane].append(text)
        heapq.heappush(heap, (size + int(lengths[text]), lane))
    return lanes


def streams(classes: np.ndarray, lengths: np.ndarray, begin_class: int, most: int):
    """``(x, y, keep, text)``, each ``steps x lanes``: inputs, targets, 0 at text starts, text of each place (-1: none)."""
    lanes = lanes_of(lengths, most)
    ends = np.cumsum(lengths)
    steps = max(int(sum(lengths[t] for t in lane)) for lane in lanes)
    x = np.full((steps, len(lanes)), begin_class, np.int16)
    y = np.zeros((steps, len(lanes)), np.int16)
    keep = np.zeros((steps, len(lanes)), np.float32)
    text = np.full((steps, len(lanes)), -1, np.int32)
    for i, lane in enumerate(lanes):
        at = 0
        for t in lane:
            n = int(lengths[t])
            own = classes[ends[t] - n:ends[t]]
            y[at:at + n, i] = own
            x[at + 1:at + n, i] = own[:-1]
            keep[at + 1:at + n, i] = 1
            text[at:at + n, i] = t
            at += n
    return x, y, keep, text


@dataclass(frozen=True)
class Vocabulary:
    """What every task needs to know of the corpus; its size is bounded by ``FREQUENT`` and the number of classes."""

    tokens: int                # N
    words: int                 # V
    own: np.ndarray            # sorted hashes of the words with a class of their own (the end token among them)
    own_class: np.ndarray
    frequent: np.ndarray       # sorted hashes
    frequent_count: np.ndarray
    class_total: np.ndarray    # log10 of (tokens + different words + 1) for ending classes, 0 for own classes
    log_prior: np.ndarray

    @property
    def classes(self) -> int:
        return ENDING_CLASSES + len(self.own)

    @property
    def base_total(self) -> float:
        return float(np.log10(self.tokens + self.words + 1))

    def count_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a frequent word, and its count (0 if not)."""
        if not len(self.frequent):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        found = self.frequent[place] == hashes
        return found, np.where(found, self.frequent_count[place], 0)

    def class_of(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        # the high bits nearly always tell the few own words apart
        high = self.own >> np.uint64(48)
        if len(np.unique(high)) == len(high):
            slots = np.zeros(1 << 16, np.int16)
            slots[high] = np.arange(len(high))
            at = slots[hashes >> np.uint64(48)]
        else:
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, self.own_class.astype(np.int16)[at], ending)


def count_tokens(train: DataFrame) -> DataFrame:
    """``(h, x, ending, n)`` of all tokens of all rows of ``train`` (binary ``text``); ``x`` is a hash that orders words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, x, ending, n = (np.concatenate(c) for c in zip(*held))
            at, back = different(h)
            n = np.bincount(back, n, len(at)).astype(np.int64)
            return pa.RecordBatch.from_arrays([signed(h[at]), signed(x[at]), pa.array(ending[at]), pa.array(n)],
                                              names=["h", "x", "ending", "n"])

        for batch in batches:
            texts = batch.column(0)
            for lo, hi in cuts(texts):
                part = texts[lo:hi].to_pylist()
                held.append((np.array([END], np.uint64), np.array([END], np.uint64), np.array([-1], np.int16), np.array([len(part)])))
                for group in byte_groups([text.lower() if text else None for text in part]):
                    data, begin, end, (h,), _ = hashed_words(group)
                    at, back = different(h)
                    begin, end = begin[at], end[at]
                    x = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
                    held.append((h[at], np.array(x, np.uint64), ending_classes(data, begin, end),
                                 np.bincount(back, minlength=len(at))))
                    size += len(at)
                if size >= BUFFER_TOKENS // 4:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = train.select("text").mapInArrow(count, "h long, x long, ending short, n long")
    return counted.groupBy("h").agg(F.first("x").alias("x"), F.first("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """Corpus totals, the words with their own class, the frequent words and the class totals."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # words by the logarithm of their count: a few hundred rows
    step = F.floor(16 * F.log2("n"))
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    room, least = frequent, None
    for r in sizes:
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    top = counts.filter(step >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    hashes = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    n = top["n"].to_numpy().astype(np.int64)
    x = top["x"].to_numpy().astype(np.int64).view(np.uint64)
    by_count = [(int(x[i]), int(hashes[i])) for i in np.lexsort((x, -n)) if int(hashes[i]) != END][:OWN_CLASSES]
    own = np.array([h for _, h in sorted([(END, END), *by_count])], np.uint64)
    known = F.col("h").isin([int(x) for x in own.view(np.int64)])
    per_class = counts.filter(~known).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass, kinds = np.zeros(ENDING_CLASSES), np.zeros(ENDING_CLASSES)
    for r in per_class:
        mass[r["ending"]], kinds[r["ending"]] = r["n"], r["v"]
    own_n = {int(h): int(c) for h, c in zip(hashes, n)}
    weight = np.concatenate([mass, [own_n.get(int(h), 0) for h in own]]) + 0.5
    order, by_hash = np.argsort(hashes), np.argsort(own)
    return Vocabulary(int(total[0]), int(total[1]), own[by_hash], by_hash + ENDING_CLASSES, hashes[order], n[order],
                      np.concatenate([np.log10(mass + kinds + 1), np.zeros(len(own))]),
                      np.log(weight / weight.sum()))


def dealt_to_rounds(learned: DataFrame, rounds: int) -> list[DataFrame]:
    """The rows of each round: every row is in one of them."""
    own = F.pmod(F.xxhash64("doc_id", F.lit("lm-round")), F.lit(rounds))
    return [learned.filter(own == i).select("text") for i in range(rounds)]


def train_network(learned: DataFrame, words: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Rounds of local training averaged over tasks; ``learned`` has ``doc_id`` and binary ``text``."""
    spark = learned.sparkSession
    network = Network.fresh(words.log_prior)
    lexicon = spark.sparkContext.broadcast(words)

    def learn_from(network: Network, rate: float):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, adam, seen = network.unpacked(np.frombuffer(network.packed(), np.float32)), Adam(rate), 0
            held, size = [], 0

            def pass_over() -> None:
                classes, n = (np.concatenate(x) for x in zip(*held))
                x, y, keep, text = streams(classes, n, lexicon.value.classes, LANES)
                state, room = np.zeros((x.shape[1], own.inner.shape[0]), np.float32), Room()
                for t in range(0, len(x), WINDOW):
                    part = slice(t, t + WINDOW)
                    weight = (text[part] >= 0).astype(np.float32)
                    _, grads, state = own.gradients(x[part], y[part], keep[part], weight, state, room)
                    adam.update(own.parts(), grads)

            for batch in batches:
                texts = batch.column(0)
                for lo, hi in cuts(texts):
                    h, ending, n = tokens_of(texts[lo:hi].to_pylist())
                    held.append((lexicon.value.class_of(h, ending), n))
                    size += len(h)
                    seen += len(h)
                    if size >= BUFFER_TOKENS:
                        pass_over()
                        held, size = [], 0
            if held:
                pass_over()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh32_intdigest(own.packed()) % 32], pa.int32()),
                                                  pa.array([seen], pa.int64()), pa.array([own.packed()], pa.binary())],
                                                 names=["part", "n", "weights"])
        return learn

    def average(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy().astype(np.float64)
        mean = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(n, group.column("weights"))) / n.sum()
        return pa.table({"n": [int(n.sum())], "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    for i, part in enumerate(dealt_to_rounds(learned, rounds)):
        trained = part.mapInArrow(learn_from(network, rate / (1 + i)), "part int, n long, weights binary")
        # 32 averages of bounded size reach the driver
        found = trained.groupBy("part").applyInArrow(average, "n long, weights binary").collect()
        if found:
            total = sum(r["n"] for r in found)
            found.sort(key=lambda r: bytes(r["weights"]))
            mean = sum(r["n"] / total * np.frombuffer(bytes(r["weights"]), np.float32).astype(np.float64) for r in found)
            network = network.unpacked(mean)
    return network


def class_log10(network: Network, classes: np.ndarray, lengths: np.ndarray, begin_class: int, lanes: int = SCORE_LANES,
                window: int = 32) -> np.ndarray:
    """Log10-probability of each text's classes, the state carried through the whole text."""
    x, y, keep, text = streams(classes, lengths, begin_class, lanes)
    out = np.zeros(len(lengths) + 1)
    h = np.zeros((x.shape[1], network.inner.shape[0]), np.float32)
    states, room, split = np.empty((window, *h.shape), np.float32), Room(), network.split()
    for t in range(0, len(x), window):
        n = min(window, len(x) - t)
        for i in range(n):
            h = network.step(x[t + i], h * keep[t + i][:, None], split)[0]
            states[i] = h
        own = network.log_probabilities(states[:n].reshape(-1, h.shape[1]), y[t:t + n].ravel(), room)
        out += np.bincount(text[t:t + n].ravel() + 1, own, len(out))
    return out[1:] / np.log(10)


def score(docs: DataFrame, doc_id: Column, text: Column, train: Column, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``train`` marks what is learned from.

    ``base_score`` is the unigram log10-probability with one added to every
    count (and one unseen word); ``score`` the model's.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    learned = rows.filter("train")
    counts = stored(count_tokens(learned), "token-counts")
    words = vocabulary(counts)
    network = train_network(learned, words, rounds)
    shared = spark.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, net = shared.value
        held, rows, size = [], [], 0

        def counted(texts: list[bytes | None], row: pa.Array, ids: pa.Array) -> pa.RecordBatch:
            """Looks up counts of one chunk of texts; what the table of frequent words lacks goes out to the join."""
            h, ending, n = tokens_of(texts)
            at, back = different(h)
            kinds, classes = h[at], lexicon.class_of(h[at], ending[at])
            text = np.repeat(np.arange(len(n)), n)
            found, count = lexicon.count_of(kinds)
            own = classes >= ENDING_CLASSES
            total = lexicon.class_total[classes]
            base = np.where(found, np.log10(count + 1) - lexicon.base_total, 0.0)
            inside = np.where(found & ~own, np.log10(count + 1) - total, 0.0)
            sums = [np.bincount(text, x[back], len(n)) for x in (base, inside, found)]
            held.append((classes[back], n, *sums))
            rows.append((row, ids))
            rare = ~found[back]
            pairs, times = np.unique(text[rare] * len(kinds) + back[rare], return_counts=True)
            word = pairs % max(1, len(kinds))
            none = pa.nulls(len(times), pa.int64())
            return pa.RecordBatch.from_arrays(
                [row.take(pa.array(pairs // max(1, len(kinds)))), none, pa.array(times), none, pa.nulls(len(times), pa.float64()),
                 pa.array(total[word]), signed(kinds[word]), pa.array(own[word].astype(np.int64))], names=names)

        def scored_documents() -> pa.RecordBatch:
            classes, n, base, inside, known = (np.concatenate(x) for x in zip(*held))
            log = class_log10(net, classes, n, lexicon.classes) + inside
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([r for r, _ in rows]), pa.concat_arrays([i for _, i in rows]), pa.array(n),
                 pa.array(known.astype(np.int64)), pa.array(base), pa.array(log), none, none], names=names)

        for batch in batches:
            keys, ids, texts = batch.columns
            for lo, hi in cuts(texts):
                yield counted(texts[lo:hi].to_pylist(), keys[lo:hi], ids[lo:hi])
                size += len(held[-1][0])
                if size >= BUFFER_TOKENS:
                    yield scored_documents()
                    held.clear()
                    rows.clear()
                    size = 0
        if held:
            yield scored_documents()

    names = ["row", "doc_id", "n", "known", "base", "log", "h", "own"]
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        run, "row long, doc_id long, n long, known long, base double, log double, h long, own long")
    scored = stored(scored, "scored")
    rare = scored.filter("h is not null").select("row", "h", "n", F.col("log").alias("class_total"), "own")
    rare = rare.join(counts.select("h", F.col("n").alias("c")), "h", "left")
    one_more = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rest = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("n") * (one_more - words.base_total)).alias("base_rest"),
        F.sum(F.when(F.col("own") == 0, F.col("n") * (one_more - F.col("class_total"))).otherwise(0.0)).alias("log_rest"))
    whole = scored.filter("h is null").join(rest, "row", "left")
    return whole.select("doc_id", F.col("n").alias("n_tokens"),
                        (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
                        F.lit(words.tokens).cast("long").alias("train_tokens"),
                        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
                        (F.col("log") + F.coalesce("log_rest", F.lit(0.0))).alias("score"))
