"""Document quality by hierarchical empirical Bayes.

A logistic classifier on the shape of a text (rates of symbols, case,
digits, repeated lines and words) gives each document's own evidence. Its
site adds what is known of its neighbours: a path's quality is shrunk toward
its host's, a host's toward the global rate, each by a prior whose strength
is estimated from how far the groups differ (method of moments). Labelled
documents count with their label, all others with the classifier's
probability, and no document counts in its own site's estimate. The posterior
adds the document's log-odds against the training rate to its path's.

The classifier is fitted on at most about ``most_labelled`` labelled rows,
chosen by hash; site counts cover all documents, by grouped sums (combined
before the shuffle, so a host of any size leaves each task as a few rows).

Nulls and odd rows: a null text is empty; a null host or path is a group of
its own; a label that is null or not 0 or 1 teaches nothing; ids labelled
more than once count with their mean label; repeated documents count each
time; without labels every document gets the same neutral evidence; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.common import cuts, stored

MOST_LABELLED = 20_000
RIDGE = 1.0
KEEP = 0.5
_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_FEATURES = len(_SYMBOLS) + 10


def features(text: bytes | None) -> np.ndarray:
    """Shape of a text: logarithms of symbol rates, and shares of case, digits, repeated lines and words."""
    out = np.zeros(N_FEATURES)
    if not text:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    words = text.split()
    n = max(1, len(words))
    out[:len(_SYMBOLS)] = np.log1p(1000 * counts[_SYMBOLS] / size)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    rest = out[len(_SYMBOLS):]
    rest[0] = upper / max(1, upper + lower)
    rest[1] = digits / size
    rest[2] = 1 - len(set(lines)) / max(1, len(lines))
    rest[3] = 1 - len(set(words)) / n
    rest[4] = np.log1p(n)
    rest[5] = size / n / 10
    rest[6] = n / max(1, len(lines)) / 100
    rest[7] = np.log1p(len(lines))
    rest[8] = counts[128:].sum() / size
    return out


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # the last one is the intercept
    mean: np.ndarray
    scale: np.ndarray
    rate: float          # share of good documents learned from

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> Classifier:
    """Logistic regression by Newton's method with a ridge."""
    d = x.shape[1]
    rate = float((y.sum() + 1) / (len(y) + 2))
    if not len(y):
        return Classifier(np.zeros(d + 1), np.zeros(d), np.ones(d), rate)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(d + 1)
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(w, mean, scale, rate)


def learn(docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Classifier:
    """Fit on at most about ``most_labelled`` labelled documents; ``labels`` has ``id`` and ``y`` (0 to 1)."""
    n = labels.count()
    chosen = labels.filter(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 20))
                           < int((1 << 20) * min(1.0, most_labelled / max(1, n))))
    rows = docs.select(doc_id.cast("long").alias("id"), text.cast("binary").alias("text")).join(chosen, "id")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in cuts(texts):
                x = [features(t).tolist() for t in texts[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)[lo:hi]],
                                                 names=["x", "y"])

    found = rows.select("text", "y").mapInArrow(shape, "x array<double>, y double").collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), N_FEATURES)
    return fit(x, np.array([r["y"] for r in found]))


def evidence(text: Column, model: Classifier, spark) -> Column:
    """Log-odds that the text is good, by its shape alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def log_odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [shared.value.log_odds(np.array([features(t) for t in texts[lo:hi].to_pylist()]))
                     for lo, hi in cuts(texts)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return log_odds(text.cast("binary"))


def prior_strength(groups: DataFrame, mean: Column, name: str = "n") -> float:
    """Pseudo-count of a Beta prior around ``mean``, from the spread of group rates ``k / n`` beyond sampling noise.

    ``groups`` has ``k`` and ``n``; one grouped sum, one row back. Groups that
    do not differ give a strong prior (at most a million), a lone group too.
    """
    rate = F.col("k") / F.col(name)
    noise = mean * (1 - mean)
    row = groups.agg(F.sum(F.col(name) * (rate - mean) ** 2).alias("spread"), F.sum(noise).alias("noise"),
                     F.sum(F.col(name)).alias("n"), F.sum(F.col(name) * noise).alias("weight")).first()
    if not row["n"]:
        return 1.0
    between = (row["spread"] - row["noise"]) / row["n"]
    inside = row["weight"] / row["n"]
    return float(min(1e6, max(1.0, inside / between - 1))) if between > 1e-9 else 1e6


def posteriors(docs: DataFrame, doc_id: Column, text: Column, host: Column, path: Column, labels: DataFrame,
               label_id: Column, label: Column, most_labelled: int = MOST_LABELLED, keep: float = KEEP) -> DataFrame:
    """``(doc_id, host, path, p_text, host_posterior, path_posterior, quality, keep)`` for every row."""
    spark = docs.sparkSession
    known = labels.select(label_id.cast("long").alias("id"), label.cast("double").alias("y"))
    known = known.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.avg("y").alias("y"))
    known = stored(known, "quality-labels")
    model = learn(docs, doc_id, text, known, most_labelled)
    rows = docs.select(doc_id.alias("doc_id"), doc_id.cast("long").alias("id"), host.alias("host"), path.alias("path"),
                       evidence(text, model, spark).alias("own"))
    rows = rows.withColumn("p_text", 1 / (1 + F.exp(-F.col("own")))).join(known, "id", "left")
    rows = rows.withColumn("y", F.coalesce("y", "p_text"))
    rows = stored(rows.select("doc_id", F.coalesce("host", F.lit("")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"),
                              F.col("host").isNull().alias("_nh"), F.col("path").isNull().alias("_np"), "own", "p_text", "y"),
                  "quality-scored")
    on_host, on_path = ["_h", "_nh"], ["_h", "_nh", "_p", "_np"]
    paths = stored(rows.groupBy(*on_path).agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = stored(paths.groupBy(*on_host).agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "hosts")
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    rate = float((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    host_prior = prior_strength(hosts, F.lit(rate))
    around = paths.join(hosts.select(*on_host, ((F.col("k") + host_prior * rate) / (F.col("n") + host_prior)).alias("m")),
                        on_host)
    path_prior = prior_strength(around, F.col("m"))
    sites = stored(paths.withColumnsRenamed({"k": "path_k", "n": "path_n"}).join(
        hosts.withColumnsRenamed({"k": "host_k", "n": "host_n"}), on_host), "sites")
    placed = rows.join(sites, on_path)
    others = lambda k, n, m, prior: (F.col(k) - F.col("y") + prior * m) / (F.col(n) - 1 + prior)
    host_mean = others("host_k", "host_n", F.lit(rate), host_prior)
    placed = placed.withColumn("host_posterior", F.least(F.greatest(host_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
    path_mean = others("path_k", "path_n", F.col("host_posterior"), path_prior)
    placed = placed.withColumn("path_posterior", F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) + F.col("own") - float(np.log(model.rate / (1 - model.rate)))
    quality = 1 / (1 + F.exp(-odds))
    return placed.select("doc_id", F.when(~F.col("_nh"), F.col("_h")).alias("host"),
                         F.when(~F.col("_np"), F.col("_p")).alias("path"), "p_text", "host_posterior", "path_posterior",
                         quality.alias("quality"), (quality >= keep).alias("keep"))
