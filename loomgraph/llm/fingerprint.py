"""Order MinHash fingerprints of whole texts, which edits change in proportion.

A text's k-mers (runs of K code points) are numbered by occurrence, so that a repeated k-mer counts
each time. Each of M hash functions selects the L numbered k-mers of lowest value; those, in the
order in which they stand in the text, are hashed together to one of M numbers. The share of equal
numbers of two texts falls with their edit distance, since moving text changes the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts
from .words import _Powers, U, mix

K, M, L = 10, 32, 2
BLOCK = 1 << 15
#: A k-mer's value is its hash without so many low bits, whatever the text's length; they hold its place while it is sorted.
PLACE_BITS = 24
_POINTS = _Powers(0xD1342543DE82EF95 | 1)
_RNG = np.random.default_rng(20240229)
FLIPS = _RNG.integers(0, 1 << 32, M, dtype=np.uint32)
MULTS = _RNG.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)


def _sorted(h: np.ndarray, most: int = 1 << PLACE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The values of k-mers in ascending order, equal ones by place, and their places."""
    bits = U(PLACE_BITS)
    if len(h) > most:
        value = h >> bits
        at = np.argsort(value, kind="stable")
        return value[at], at
    key = np.sort((h >> bits << bits) | np.arange(len(h), dtype=U))
    return key >> bits, (key & ((U(1) << bits) - U(1))).astype(np.int64)


def fingerprint(points: np.ndarray) -> np.ndarray:
    """M numbers of 32 bits. A text shorter than K is one k-mer; an empty text has fixed numbers."""
    n = len(points)
    if n == 0:
        return mix(np.arange(M, dtype=U)).astype(np.uint32)
    k = min(K, n)
    up, down = _POINTS.get(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum((points.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + U(k))
    count = len(h)
    value, at = _sorted(h)
    new = np.ones(count, dtype=bool)
    new[1:] = value[1:] != value[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(count), 0))
    value = mix(value + (np.arange(count) - begin).astype(U) * U(0x9E3779B97F4A7C15))
    short = (value >> U(32)).astype(np.uint32)
    rows = np.arange(M)
    best_h = best_p = None
    for b in range(0, count, BLOCK):
        x = (short[b : b + BLOCK][None, :] ^ FLIPS[:, None]) * MULTS[:, None]
        found_h, found_p = [], []
        for _ in range(min(L, x.shape[1])):
            p = x.argmin(axis=1)
            found_h.append(x[rows, p].copy())
            found_p.append(p + b)
            x[rows, p] = np.uint32(0xFFFFFFFF)
        hs, ps = np.stack(found_h, 1), np.stack(found_p, 1)
        if best_h is not None:
            hs, ps = np.concatenate([best_h, hs], 1), np.concatenate([best_p, ps], 1)
            order = np.argsort(hs, axis=1, kind="stable")[:, :L]
            hs, ps = np.take_along_axis(hs, order, 1), np.take_along_axis(ps, order, 1)
        best_h, best_p = hs, ps
    order = np.argsort(at[best_p], axis=1, kind="stable")
    chosen = np.take_along_axis(best_p, order, 1)
    out = rows.astype(U)
    for c in range(chosen.shape[1]):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + value[chosen[:, c]])
    return (out >> U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def text_of(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last quarter replaced by as many (or all) first code points of the next."""
    q = len(points) // 4
    return np.concatenate([points[: len(points) - q], following[:q]])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    before = None
    rows: list[tuple] = []
    for batch in batches:
        for bucket, look, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            points = code_points(text.as_buffer().to_pybytes() if text.is_valid else b"")
            if before is None and look:
                continue
            mark = fingerprint(points)
            if before is not None and before[0] == bucket:
                _, old_id, old, old_mark = before
                changed = edited(old, points)
                new_mark = fingerprint(changed)
                sha = hashlib.sha256(changed.tobytes().decode("utf-32-le").encode()).hexdigest()
                rows.append((old_id, len(old), sha, text_of(old_mark), text_of(new_mark), likeness(old_mark, new_mark), likeness(old_mark, mark)))
            before = None if look else (bucket, doc_id, points, mark)
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k != 0 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows))], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) if k != 0 else pa.array(c, pa.int64()) for k, c in enumerate(zip(*rows))], names=names)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [text_of(fingerprint(code_points(t.as_buffer().to_pybytes() if t.is_valid else b""))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (hexadecimal). Equal texts have equal fingerprints; null is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mark, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and both likenesses.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document, by ascending doc_id; after the last comes the first.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness
    to the edited text), near_next (to the next document). Null texts are empty; two empty texts are
    alike (1.0). A null doc_id comes first; equal doc_ids follow each other by text. One row is its
    own next. An empty table gives an empty table. Other columns are ignored.

    Rows are dealt out by ranges of doc_id; the first of each range also goes to the range before,
    where it follows the last, so no row waits for another task.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    n = 4 * n_parts(spark)
    cuts = sorted(set(rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"] or [])) if n > 1 else []
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # Binary search: the number of cuts that the key has reached.
    bucket = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, s: F.when(F.get(edges, low + s - 1) <= F.col("key"), low + s).otherwise(low))
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect())  # one row for each range
    if not firsts:
        return spark.createDataFrame([], OUT)
    size = len(cuts) + 1
    first_of, before = [None] * size, [-1] * size
    for i, (b, first) in enumerate(firsts):
        first_of[b], before[b] = first, firsts[i - 1][0]
    is_first = F.col("key") == F.get(F.array(*[F.lit(x).cast("long") for x in first_of]), F.col("bucket"))
    own = F.struct("bucket", F.lit(0).alias("look"))
    ahead = F.struct(F.get(F.array(*[F.lit(x) for x in before]), F.col("bucket")).alias("bucket"), F.lit(1).alias("look"))
    placed = rows.select("doc_id", "text", "key", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("p.bucket", "p.look", "doc_id", "text", "key").repartition(n_parts(spark), "bucket").sortWithinPartitions("bucket", "look", "key", "text")
    return placed.select("bucket", "look", "doc_id", "text").mapInArrow(_compare, OUT)
