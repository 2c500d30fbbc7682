"""Language identification of whole texts, with spans of mixed-language text.

A word's script (by code-point ranges) narrows the languages it can belong
to: those that were seen to use it. Hashed character 1- to 3-grams give each
word a log-likelihood under each candidate; Viterbi over the words with a
penalty for every switch labels spans. A text's language is the one whose
spans hold most letters, and its score their share of all letters. Letters of
a script that no learned language uses count in "all letters", but for no
language: a text wholly in such a script has score 0.

Scripts written without blanks (Chinese, Japanese, Thai and the like) are cut
in units of up to four characters, each a word: a run of them can earn more
than two switches cost, so it can be a span between two others.

Most texts are one span. That is proved without running Viterbi: with ``l``
the best language for the whole text, no other path can win when no stretch
of words is better under any other language by more than half the penalty
(each further span costs a switch). All other texts get the exact search.

The model is learned from a sample of the labelled rows of bounded size
(``docs_per_lang`` for each language); its size depends on the number of
languages only.

Nulls and odd rows: a null text, or one without letters, is ``und`` with
score 0 and no spans; rows with a null label or text teach nothing; repeated
rows get equal results; ties go to the language first in code-point order;
without any labelled row every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import cuts, mixed

UNKNOWN = "und"
# Labelled documents learned from, for each language: about this many, chosen by hash.
DOCS_PER_LANG = 3000
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SWITCH_PENALTY = 8.0
# A word's scores lie this far apart at most, so no single word forces a switch on its own.
WORD_RANGE = 12.0
# A language uses a script that makes up this share of its letters.
SCRIPT_SHARE = 0.02
#: First code point of each script's ranges (a range lasts until the next entry; 0: no script).
SCRIPT_STARTS = (
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 1),
    (0x00B6, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x0250, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4),
    (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0E00, 11), (0x0E80, 12),
    (0x0F00, 13), (0x10A0, 14), (0x1100, 15), (0x1200, 16), (0x1400, 17), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x2C60, 1), (0x2C80, 0), (0x3040, 18), (0x3100, 19), (0x3130, 15), (0x3190, 19), (0xA640, 3), (0xA6A0, 0),
    (0xA720, 1), (0xA800, 0), (0xAC00, 15), (0xD7B0, 0), (0xF900, 19), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFEFF, 0), (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 18),
    (0xFFA0, 15), (0xFFE0, 0), (0x10000, 20), (0x20000, 19), (0x40000, 0))
N_SCRIPTS = 21
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_SCRIPT = np.array([k for _, k in SCRIPT_STARTS])
# ASCII letters and non-ASCII bytes make words (cut further below); everything else separates.
_LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# UTF-8 of punctuation and blanks beyond ASCII (joiners and the soft hyphen stay in their word).
_MARKS = re.compile(rb"\xc2[\x80-\xa9\xab\xac\xae-\xb4\xb6-\xb9\xbb-\xbf]|\xe2\x80[\x80-\x8b\x8e-\xbf]|\xe2\x81[\x80-\xaf]"
                    rb"|\xe3\x80[\x80-\x84\x88-\xbf]|\xef\xbc[\x80-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
# UTF-8 of up to four characters of one script that is written without blanks: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_UNITS = re.compile(rb"(?:\xe0[\xb8-\xbf][\x80-\xbf]){1,4}|(?:\xe1(?:[\x80\x81][\x80-\xbf]|\x82[\x80-\x9f])){1,4}"
                    rb"|(?:\xe1[\x9e\x9f][\x80-\xbf]){1,4}"
                    rb"|(?:\xe3(?:[\x81-\x83][\x80-\xbf])|\xef(?:\xbd[\xa6-\xbf]|\xbe[\x80-\x9f])){1,4}"
                    rb"|(?:\xe3(?:\x80[\x85-\x87]|[\x84\x86-\xbf][\x80-\xbf])|[\xe4-\xe9][\x80-\xbf]{2}|\xea[\x80-\x93][\x80-\xbf]"
                    rb"|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}){1,4}")


def letter_words(text: bytes) -> list[bytes]:
    """Words of ``text``; runs of a script written without blanks are cut in units of up to four characters."""
    words = text.translate(_LETTER_BYTES).split()
    if text.isascii():
        return words
    out: list[bytes] = []
    for word in words:
        if word.isascii():
            out.append(word)
        else:
            out += _UNITS.sub(rb" \g<0> ", _MARKS.sub(b" ", word)).split(b" ")
    return [w for w in out if w]


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(gram word, gram bucket, letters, per script)``: hashed character grams of each word, its letters in all and by script.

    Words without letters have 0 letters. Characters that are no letters separate grams.
    """
    text = " " + " ".join(w.decode("utf-8", "replace").lower().replace(" ", "�") for w in words) + " "
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    space = chars == 32
    word = np.cumsum(space) - 1  # a word and the space before it
    known, at = np.unique(chars, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in known.tolist()])[at]
    script = np.where(is_letter, _SCRIPT[np.searchsorted(_STARTS, chars, "right") - 1], 0)
    n = len(words)
    letters = np.bincount(word[is_letter], minlength=n)[:n]
    per_script = np.bincount(word[is_letter] * N_SCRIPTS + script[is_letter],
                             minlength=(n + 1) * N_SCRIPTS)[:n * N_SCRIPTS].reshape(n, N_SCRIPTS)
    owners, buckets = [], []
    code = np.where(is_letter | space, chars, 0).astype(np.uint64)
    for order in ORDERS:
        m = len(chars) - order + 1
        h = np.full(m, order, np.uint64)
        good = np.ones(m, bool)
        for i in range(order):
            part = code[i:i + m]
            h = h * np.uint64(0x100000001B3) + part
            good &= part != 0
            if 0 < i < order - 1:
                good &= part != 32  # a gram lies in one word and its bounds
        if order == 1:
            good &= ~space
        owner = word[:m]  # the space before a word belongs to it; the last space to none
        good &= owner < n
        owners.append(owner[good])
        buckets.append((mixed(h[good]) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets), letters, per_script


@dataclass(frozen=True)
class LanguageModel:
    """Languages in code-point order, gram log-probabilities ``(bucket, language)``, scripts ``(script, language)``."""

    languages: tuple[str, ...]
    logp: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, letters)``: each word's score under each language, 0 for the best; 0 for all if it tells nothing."""
        return self.scored(words)[:2]

    def scored(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`word_scores`, and each word's letters of scripts that some language uses."""
        owner, bucket, letters, per_script = word_features(words)
        script, known = per_script.argmax(1), per_script[:, self.uses.any(1)].sum(1)
        n, k = len(words), len(self.languages)
        scores = np.stack([np.bincount(owner, self.logp[bucket, j], n) for j in range(k)], 1) / len(ORDERS)
        allowed = self.uses[script]
        allowed[~allowed.any(1)] = True
        scores = np.where(allowed, scores, -np.inf)
        scores -= scores.max(1, keepdims=True)
        scores = np.maximum(scores, -WORD_RANGE)
        scores[(letters == 0) | ~self.uses[script].any(1)] = 0
        return scores.astype(np.float32), letters, known


def learn(docs: DataFrame, text: Column, lang: Column, key: Column, docs_per_lang: int = DOCS_PER_LANG) -> LanguageModel:
    """Learn from about ``docs_per_lang`` labelled rows of each language, chosen by a hash of ``key``."""
    labelled = docs.select(text.cast("binary").alias("text"), lang.alias("lang"),
                           F.pmod(F.xxhash64(key.cast("string"), F.lit("langid")), F.lit(1 << 30)).alias("h"))
    labelled = labelled.filter("text is not null and lang is not null")
    found = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(found))
    k = len(languages)
    if not k:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*[F.lit(x) for lg in languages for x in (lg, int((1 << 30) * min(1.0, docs_per_lang / found[lg])))])
    sample = labelled.filter(F.col("h") < share[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lg: i for i, lg in enumerate(languages)}
        grams, scripts = np.zeros((k, BUCKETS), np.int64), np.zeros((k, N_SCRIPTS), np.int64)
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for lo, hi in cuts(texts):
                by_lang: dict[int, dict[bytes, int]] = {}
                for t, lg in zip(texts[lo:hi].to_pylist(), langs[lo:hi].to_pylist()):
                    seen = by_lang.setdefault(index[lg], {})
                    for w in letter_words(t):
                        seen[w] = seen.get(w, 0) + 1
                for i, seen in by_lang.items():
                    if seen:
                        times = np.fromiter(seen.values(), np.int64, len(seen))
                        owner, bucket, letters, per_script = word_features(list(seen))
                        script = per_script.argmax(1)
                        grams[i] += np.bincount(bucket, times[owner], BUCKETS).astype(np.int64)
                        scripts[i] += np.bincount(script, letters * times, N_SCRIPTS).astype(np.int64)
        for kind, counts in ((0, grams), (1, scripts)):
            i, slot = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind)), pa.array(i), pa.array(slot),
                                              pa.array(counts[i, slot])], names=["kind", "lang", "slot", "n"])

    counted = sample.mapInArrow(count, "kind long, lang long, slot long, n long")
    # at most one row a language and bucket or script
    rows = counted.groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((BUCKETS, k)), np.zeros((N_SCRIPTS, k))
    for kind, out in ((0, grams), (1, scripts)):
        part = rows[rows["kind"] == kind]
        out[part["slot"], part["lang"]] = part["n"]
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    uses = (scripts > 0) & (scripts >= SCRIPT_SHARE * scripts.sum(0))
    uses[0] = False
    return LanguageModel(languages, logp, uses)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of every word of several texts at once: sum of scores minus ``penalty`` per switch."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    k = scores[0].shape[1]
    steps = int(lengths[0])
    live = (lengths[None, :] > np.arange(steps)[:, None]).sum(1) if steps * len(order) < 1 << 24 else \
        np.array([np.searchsorted(-lengths, -t) for t in range(steps)])
    flat = np.concatenate([scores[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    back = np.empty((len(flat), k), np.int16)  # where each state came from
    value = flat[begin[:live[0]]].astype(np.float64) if steps else np.zeros((0, k))
    own = np.arange(k, dtype=np.int16)
    for t in range(1, steps):
        n = live[t]
        now = value[:n]
        best = now.argmax(1).astype(np.int16)
        switched = now[np.arange(n), best][:, None] - penalty
        stay = now >= switched
        back[begin[:n] + t] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, now, switched) + flat[begin[:n] + t]
    state = value.argmax(1)
    labels = np.empty(len(flat), np.int16)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(scores)
    for place, i in enumerate(order):
        out[i] = labels[begin[place]:begin[place] + lengths[place]]
    return out


class Labeller(dict):
    """Labels texts with a model, caching word scores (bounded: emptied beyond ``limit`` words or 32 MB of them)."""

    def __init__(self, model: LanguageModel, penalty: float = SWITCH_PENALTY, limit: int = 200_000) -> None:
        super().__init__()
        self.model, self.penalty, self.limit = model, penalty, limit
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.bytes = 0
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return slot

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """``(language, score, spans)`` of each text; a span is first word, last word, language."""
        return [found[:3] for found in self.labelled(texts)]

    def labelled(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
        """As :meth:`label`, with the share of letters whose script some learned language uses."""
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        if len(self) > self.limit or self.bytes > 32 << 20:
            self._empty()
        get, parts, lengths = self.__getitem__, [], []
        for text in texts:
            words = letter_words(text) if text else ()
            parts.append(np.fromiter(map(get, words), np.int64, len(words)))
            lengths.append(len(words))
        if self.new:
            scores, letters, known = self.model.scored(self.new)
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
            self.known = np.concatenate([self.known, known])
            self.new = []
        full = [i for i, n in enumerate(lengths) if n]
        out: list = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        if not full:
            return out
        slots = np.concatenate([parts[i] for i in full])
        n = np.array([lengths[i] for i in full])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        scores, known = self.scores[slots], self.known[slots]
        total, total_known = np.add.reduceat(self.letters[slots], begin), np.add.reduceat(known, begin)
        best = np.add.reduceat(scores.astype(np.float64), begin).argmax(1)
        text = np.repeat(np.arange(len(n)), n)
        base = scores[np.arange(len(slots)), best[text]]
        gain = np.zeros(len(n))
        # texts lie far apart on this scale, so a running minimum starts anew with each
        apart = (len(slots) + 1) * 2 * WORD_RANGE * text.astype(np.float64)
        for j in range(len(languages)):
            d = (scores[:, j] - base).astype(np.float64)
            upto = np.cumsum(d) - apart
            low = np.minimum.accumulate(upto - d)
            gain = np.maximum(gain, np.maximum.reduceat(upto - low, begin))
        search = np.flatnonzero(gain > self.penalty / 2 - 1e-3)
        paths = dict(zip(search.tolist(), viterbi([scores[begin[i]:begin[i] + n[i]] for i in search], self.penalty)))
        for place, i in enumerate(full):
            if not total[place]:
                continue
            path = paths.get(place)
            share = float(total_known[place] / total[place])
            if path is None:
                out[i] = (languages[best[place]], share, [(0, int(n[place]) - 1, languages[best[place]])], share)
                continue
            own = known[begin[place]:begin[place] + n[place]]
            held = np.bincount(path, own, len(languages))
            top = int(held.argmax())
            turns = np.flatnonzero(np.diff(path)) + 1
            spans = [(int(a), int(b) - 1, languages[path[a]]) for a, b in zip([0, *turns], [*turns, len(path)])]
            out[i] = (languages[top], float(held[top] / total[place]), spans, share)
        return out


def identify(text: Column, model: LanguageModel, spark) -> Column:
    """``struct(lang, score, spans, known)`` of each whole text.

    A span is ``(first, last, lang)`` in letter words; ``known`` is the share
    of letters whose script some learned language uses, whatever the language.
    """
    shared = spark.sparkContext.broadcast(model)  # languages x (buckets + scripts) numbers
    span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
                      ("known", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<first:int,last:int,lang:string>>,known:double>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        for texts in batches:
            rows: list[dict] = []
            for lo, hi in cuts(texts):
                rows += [{"lang": lg, "score": score, "spans": [dict(zip(("first", "last", "lang"), s)) for s in spans],
                          "known": known} for lg, score, spans, known in labeller.labelled(texts[lo:hi].to_pylist())]
            yield pa.array(rows, kind)

    return label(text.cast("binary"))
