"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are the 64-bit hashes of its lower-cased words and of the words' first 4, 5 and
6 bytes, each once. The model has a weight and a short vector for each chosen term:

    logit = bias + sum of weights + sum over pairs of the inner products of their vectors

so two terms together (an insult and whom it is aimed at) may count for more than both alone.
The model has the terms that are bound to the positive label by themselves, and the terms of pairs
that are more often positive than both terms alone would make them; one of the latter may be
neutral by itself, and any term of several rows is looked at. Terms are chosen, and the model is fitted, on a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .words import U, Words, chunks, mix, signed

PREFIXES = (4, 5, 6)
#: The sample: at most so many rows of each label, those of the lowest hash of doc_id.
ROWS_PER_LABEL = 3000
#: The size of the model: the most terms that are bound to the positive label by themselves, and that pairs add.
MOST_TERMS, MOST_PAIRED = 4096, 1024
#: Standard deviations by which a pair's positive rows exceed what its terms alone explain (more where more pairs are looked at), and the fewest rows of a pair.
PAIR_Z, PAIR_ROWS = 5.0, 8
FACTORS = 4
ROUNDS = 200
L2_WEIGHT, L2_FACTOR = 1e-4, 3e-3
FILTER_BITS = 22


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a group of documents, with repetitions, and the document of each."""
    w = Words(data, at, lower=True)
    doc = w.doc()
    hashes, docs = [w.hashes()], [doc]
    size = w.end - w.start
    for n in PREFIXES:
        long = size > n
        hashes.append(mix(w.hashes(longest=n)[long] ^ U(n)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in chunks(batch.column(1)):
            h, doc = _terms(data, at)
            rows = []
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(j - i + 1))
            h = h[order]
            for d in range(j - i):
                rows.append(signed(np.unique(h[edges[d] : edges[d + 1]])))
            items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), items], names=["label", "terms"])


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        out = np.full(n, self.bias)
        if not len(self.terms):
            return out
        h, doc = _terms(data, at)
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        shift = U(64 - FILTER_BITS)
        table[self.terms >> shift] = True
        near = table[h >> shift]
        h, doc = h[near], doc[near]
        slot = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[slot] == h
        pairs = np.unique(doc[hit].astype(np.int64) * len(self.terms) + slot[hit])
        doc, slot = pairs // len(self.terms), pairs % len(self.terms)
        out += np.bincount(doc, weights=self.weights[slot], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            out += 0.5 * (np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n))
        return out


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))


def paired(rows: list[np.ndarray], n_terms: int, y: np.ndarray, most: int = MOST_PAIRED) -> np.ndarray:
    """Terms (rows: the terms of each row) in a pair that is positive more often than the terms' own log odds add up to.

    One of the two must be positive more often than a row in general, by a standard error; the other may be any term. All such pairs are
    looked at: each first term is counted with all terms over the rows that hold it.
    """
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    flat = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    count, pos = np.bincount(flat, minlength=n_terms), np.bincount(flat, weights=y[owner], minlength=n_terms)
    odds = _log_odds(pos, count - pos, n_pos, n_neg)
    first = np.flatnonzero((odds > np.sqrt(1 / (pos + 0.5) + 1 / (count - pos + 0.5))) & (count >= PAIR_ROWS))
    best, z_least = np.zeros(n_terms), max(PAIR_Z, np.sqrt(2 * np.log(max(2.0, len(first) * n_terms))))
    owner = owner[np.argsort(flat, kind="stable")]
    edges = np.concatenate(([0], np.cumsum(count)))
    del flat
    for own in first:
        held = owner[edges[own] : edges[own + 1]]
        true, false = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(rows[r] for r in some)]), minlength=n_terms) for some in (held[y[held] == 1], held[y[held] == 0]))
        n = true + false
        often = np.flatnonzero(n >= PAIR_ROWS)
        often = often[often != own]
        n, n_true = n[often], true[often]
        alone = 1 / (1 + np.exp(-np.clip(odds[often] + odds[own] + np.log(n_pos / n_neg), -30, 30)))
        z = (n_true - n * alone) / np.sqrt(n * alone * (1 - alone) + 1e-9)
        z[z <= z_least] = 0
        best[often] = np.maximum(best[often], z)
        best[own] = max(best[own], z.max(initial=0))
    found = np.flatnonzero(best > 0)
    return np.sort(found[np.argsort(-best[found], kind="stable")[:most]])


def fit(x: np.ndarray, y: np.ndarray, terms: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """Fit on rows by terms (0 or 1) by full-batch Adam on the log loss, both labels weighing the same. terms: sorted hashes."""
    x, y = x.astype(np.float32), y.astype(np.float64)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return FactorizationMachine(np.zeros(0, U), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(rate / (1 - rate))))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, ROUNDS + 1):
        grads = gradients(x, y, weight, params)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    bias, w, f = (p.astype(np.float64) for p in params)
    return FactorizationMachine(terms, w, f, float(bias[0]))


def gradients(x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: list[np.ndarray]) -> list[np.ndarray]:
    """Of the weighted log loss, and half the squared weights and factors, by bias, weights and factors."""
    bias, w, f = params
    xf = x @ f
    logit = bias + x @ w + 0.5 * ((xf**2).sum(1) - x @ (f**2).sum(1))
    miss = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)).astype(x.dtype)
    return [miss.sum(keepdims=True), x.T @ miss + L2_WEIGHT * w, x.T @ (miss[:, None] * xf) - f * (x.T @ miss)[:, None] + L2_FACTOR * f]


def _slots(terms: np.ndarray):
    """(label, slots): for each row the places in ``terms`` (sorted) of those it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column(1):
                h = found.values.to_numpy(zero_copy_only=False).view(U)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                rows.append(at[terms[at] == h].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["label", "slots"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, per_label: int = ROWS_PER_LABEL) -> FactorizationMachine:
    """Fit on labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("isnotnull(doc_id) and label in (0, 1)").where(remainder("doc_id", folds) != held_out)
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_label rows of two numbers
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("label", "text")
    found = written(taken.mapInArrow(_distinct_terms, "label int, terms array<long>"), "terms")
    size = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_neg, n_pos = size.get(0, 0), size.get(1, 0)
    if not n_pos or not n_neg:
        dropped(found)
        return fit(np.zeros((n_pos + n_neg, 0)), np.repeat([0, 1], [n_neg, n_pos]), np.zeros(0, U))
    # Of all terms only those that may be chosen come here, a bounded number.
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    odds = f"ln((pos + 0.5) / ({n_pos} - pos + 0.5)) - ln((neg + 0.5) / ({n_neg} - neg + 0.5))"
    low = counts.withColumn("low", F.expr(f"{odds} - sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))"))
    few = 0.004 * n_pos
    strong = low.where(f"pos >= greatest(4, {few}) and low > 1.5").orderBy(F.desc(F.expr("low * sqrt(pos)")), "term").limit(MOST_TERMS).select("term")
    common = counts.where(f"pos + neg >= greatest({PAIR_ROWS}, {few})").select("term")  # of at most 2 * per_label rows
    own, others = (np.unique(x.toArrow()["term"].to_numpy()) for x in (strong, common))
    terms = np.sort(np.union1d(own, others).astype(np.int64).view(U))
    if not len(terms):
        dropped(found)
        return fit(np.zeros((n_pos + n_neg, 0)), np.repeat([0, 1], [n_neg, n_pos]), terms)
    rows = found.mapInArrow(_slots(terms), "label int, slots array<int>").toArrow()  # at most 2 * per_label rows, of the terms that several of them have
    dropped(found)
    slots = rows["slots"].combine_chunks()
    at, flat = slots.offsets.to_numpy(), slots.values.to_numpy(zero_copy_only=False)
    both = sorted((int(k), flat[at[i] : at[i + 1]].tobytes()) for i, k in enumerate(rows["label"].to_pylist()))
    rows_of, y = [np.frombuffer(places, dtype=np.int32) for _, places in both], np.array([k for k, _ in both])
    chosen = np.isin(terms.view(np.int64), own)
    chosen[paired(rows_of, len(terms), y)] = True
    place = np.cumsum(chosen) - 1
    x = np.zeros((len(both), int(chosen.sum())), dtype=np.uint8)
    for i, places in enumerate(rows_of):
        x[i, place[places[chosen[places]]]] = 1
    return fit(x, y, terms[chosen])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: FactorizationMachine = shared.value
        for batch in batches:
            parts = [model.logits(data, at) for _, _, data, at in chunks(batch.column(batch.num_columns - 1))]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    The model sees texts only. Null and empty texts have the score of no terms. Without labelled
    rows of both kinds the score is the one rate there is. A null doc_id is not held out. Repeated
    rows are scored each. An empty table gives an empty table. Other columns are ignored.
    """
    model = train(docs, labels, label, folds, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _keep(shared, threshold: float):
    cut = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: FactorizationMachine = shared.value
        for batch in batches:
            parts = [model.logits(data, at) for _, _, data, at in chunks(batch.column("text"))]
            yield batch.filter(pa.array((np.concatenate(parts) if parts else np.zeros(0)) < cut))

    return run


def toxicity_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; null and empty texts stay if the score of no terms is."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held_out))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
