"""Quality scores by positive-unlabelled learning.

Trusted positives are labelled good; unlabelled texts are a bounded sample of the whole table. The
class prior is the least ratio, over score thresholds, of unlabelled to positive texts above the
threshold. A small network over statistics of the text then minimises the non-negative unbiased
risk: prior * loss(positives as good) + max(0, loss(unlabelled as bad) - prior * loss(positives as bad)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import remainder
from .words import Words, chunks, grams

#: The samples: at most so many positives, and so many unlabelled rows, those of the lowest hash of doc_id.
SAMPLE_ROWS = 8000
HIDDEN = 16
ROUNDS = 400
RANK_ROUNDS = 80
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:256] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
USUAL = np.zeros(256, dtype=bool)
USUAL[[ord(c) for c in ".,;:!?'\"()-"]] = True
FEATURES = 18


def _repeats(h: np.ndarray, first: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: share of distinct values, share of the most frequent one."""
    distinct, top = np.ones(docs), np.zeros(docs)
    for d in range(docs):
        x = h[first[d] : first[d + 1]]
        if len(x):
            x = np.sort(x)
            edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            distinct[d] = (len(edge) - 1) / len(x)
            top[d] = np.diff(edge).max() / len(x)
    return distinct, top


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Statistics of each text of a group; of an empty text all zero but for the shares of distinct values."""
    w = Words(data, at, lower=True)
    docs = len(at) - 1
    size = np.diff(at).astype(float)
    words = w.counts.astype(float)
    per = np.maximum(size, 1)
    per_word = np.maximum(words, 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return sums[at[1:]] - sums[at[:-1]]

    h = w.hashes()
    doc = w.doc()
    same = np.zeros(len(h), dtype=bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = (w.end - w.start).astype(float)
    last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    odd_end = ~(LETTERS | DIGITS | USUAL)[last]
    no_letter = np.zeros(len(h), dtype=bool)
    if len(h):
        letters = np.concatenate(([0], np.cumsum(LETTERS[data], dtype=np.int64)))
        no_letter = letters[w.end] == letters[w.start]
    pairs, pair_first = grams(h, w.first, 2)
    distinct, top = _repeats(h, w.first, docs)
    distinct2, top2 = _repeats(pairs, pair_first, docs)
    table = np.zeros(256, dtype=bool)
    table[10] = True
    lines = share(table)
    symbol = ~(LETTERS | DIGITS | USUAL)
    symbol = symbol.copy()
    symbol[[9, 10, 11, 12, 13, 32]] = False
    mean = np.bincount(doc, weights=length, minlength=docs) / per_word
    square = np.bincount(doc, weights=length**2, minlength=docs) / per_word
    cols = [
        np.log1p(words),
        mean,
        np.sqrt(np.maximum(square - mean**2, 0)),
        share(LETTERS) / per,
        share(UPPER) / per,
        share(DIGITS) / per,
        share(USUAL) / per,
        share(symbol) / per,
        np.sqrt(share(symbol) / per),
        lines / per_word,
        np.bincount(doc, weights=odd_end, minlength=docs) / per_word,
        np.bincount(doc, weights=no_letter, minlength=docs) / per_word,
        np.bincount(doc, weights=same, minlength=docs) / per_word,
        distinct,
        top,
        distinct2,
        top2,
        np.log1p(size / (lines + 1)),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        w1, b1, w2, b2 = self.params
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]


def _train(x: np.ndarray, slope, seed: int, centre: np.ndarray, scale: np.ndarray, rounds: int = ROUNDS) -> Network:
    """Adam over the whole sample; slope gives the risk's derivative by each row's logit."""
    rng = np.random.default_rng(seed)
    net = Network(centre, scale, [rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)])
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    z = np.clip((x - centre) / scale, -8, 8)
    for t in range(1, rounds + 1):
        w1, b1, w2, b2 = net.params
        hidden = np.tanh(z @ w1 + b1)
        g = slope(hidden @ w2 + b2[0])
        back = (g[:, None] * w2) * (1 - hidden**2)
        grads = [z.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ g + 1e-4 * w2, np.array([g.sum()])]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            net.params[k] = net.params[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of both: the least ratio of their tails."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.6, 59))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(np.min((u + slack) / np.maximum(p, 1e-9)), 0.05, 0.98))


@dataclass
class Model:
    net: Network | None
    prior: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(at) - 1, self.prior)
        return sigmoid(self.net.logits(features(data, at)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(None, 0.5)
    x = np.concatenate([positive, unlabelled])
    is_p = np.arange(len(x)) < len(positive)
    centre, scale = np.median(positive, axis=0), np.maximum(x.std(axis=0), 1e-3)
    n_p, n_u = len(positive), len(unlabelled)
    # Which rows look more like the positives than like the unlabelled, each half ranked by a model of the other half: for the prior.
    half = np.arange(len(x)) % 2 == 0
    rank = np.zeros(len(x))
    for side in (half, ~half):
        own = is_p[side]
        n1, n0 = max(1, own.sum()), max(1, (~own).sum())
        net = _train(x[side], lambda f, own=own, n1=n1, n0=n0: np.where(own, (sigmoid(f) - 1) / n1, sigmoid(f) / n0), seed, centre, scale, RANK_ROUNDS)
        rank[~side] = net.logits(x[~side])
    prior = class_prior(rank[is_p], rank[~is_p])

    def slope(f: np.ndarray) -> np.ndarray:
        as_bad_u = np.logaddexp(0, f[~is_p]).mean()
        as_bad_p = prior * np.logaddexp(0, f[is_p]).mean()
        g = np.zeros(len(f))
        if as_bad_u - as_bad_p >= 0:
            g[is_p] = prior * (sigmoid(f[is_p]) - 1) / n_p - prior * sigmoid(f[is_p]) / n_p
            g[~is_p] = sigmoid(f[~is_p]) / n_u
        else:  # the estimate has gone below what a risk can be: go back
            g[is_p] = prior * sigmoid(f[is_p]) / n_p
            g[~is_p] = -sigmoid(f[~is_p]) / n_u
        return g

    return Model(_train(x, slope, seed, centre, scale), prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(data, at) for _, _, data, at in chunks(batch.column(1))]
        if parts:
            x = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * FEATURES).astype(np.int32)), pa.array(x.ravel()))], names=["positive", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Model:
    """Positives: rows labelled 1 whose crc32(doc_id as text) mod ``folds`` is not ``held_out``. Unlabelled: any rows but those of that remainder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("isnotnull(doc_id)").where(remainder("doc_id", folds) != held_out)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label = 1 and isnotnull(doc_id)").where(remainder("doc_id", folds) != held_out)
    good = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("positive", F.lit(True))
    some = docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(rows).distinct().withColumn("positive", F.lit(False))
    sample = F.broadcast(good.unionByName(some))  # at most 2 * rows of a number and a flag
    found = docs.join(sample, "doc_id").select("positive", "text").mapInArrow(_features, "positive boolean, x array<double>").toArrow()
    x = found["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES) if found.num_rows else np.zeros((0, FEATURES))
    is_p = np.array(found["positive"].to_pylist(), dtype=bool)
    order = lambda y: y[np.lexsort(y.T)] if len(y) else y  # noqa: E731  the same sample gives the same model
    return fit(order(x[is_p]), order(x[~is_p]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            parts = [model.scores(data, at) for _, _, data, at in chunks(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    The model sees texts only. Null and empty texts have the score of an empty text. Without
    positives every score is 0.5. A null doc_id is not held out. Repeated rows are scored each. An
    empty table gives an empty table. Other columns are ignored.
    """
    model = train(docs, labels, label, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
