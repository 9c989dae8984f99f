"""Removal of repeated passages of whole words, by a count-min prefilter and an exact second pass.

A window is ``window`` consecutive words of one document. Each partition counts, for its windows,
the smallest hash among the shorter word runs inside the window (``anchor``). Equal windows have
equal anchors, so the merged count of an anchor never falls below the number of documents that
hold the window. Only windows whose estimate reaches two go to the second pass, which groups them
exactly, by a 96-bit hash of their word sequence. A false estimate costs a row, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import about_words
from .words import Words, chunks, grams, mix, signed, sliding_min

WINDOW = 50
ANCHOR = 25
DEPTH = 2
#: The sketch has about 8 counters for each anchor, up to 2**MOST_BITS: a broadcast of 2 x 64 MB.
MOST_BITS = 29
HITS = "h1 long, h2 int, doc_id long, at int"
RESULT = ("doc_id", "n_words", "n_removed", "kept", "kept_sha256", "text")


def _windows(w: Words, window: int, anchor: int):
    """Hashes, anchors, documents and first words of all windows."""
    words = w.hashes()
    runs, run_first = grams(words, w.first, anchor)
    counts = np.maximum(w.counts - (window - 1), 0)
    total = int(counts.sum())
    if not total:
        return None
    begin = np.repeat(run_first[:-1], counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    anchors = sliding_min(runs, window - anchor + 1)[begin + at]
    return words, anchors, np.repeat(np.arange(len(counts)), counts), at


def _anchor_sketch(window: int, anchor: int, width_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sketch.Partial(DEPTH, width_bits)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                found = _windows(Words(data, at, lower=False), window, anchor)
                if found is None:
                    continue
                _, anchors, doc, _ = found
                new = np.ones(len(anchors), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                anchors, doc = anchors[new], doc[new]
                _, once = np.unique(anchors + mix(doc.astype(np.uint64)), return_index=True)
                part.add(anchors[once])
        yield from part.batches()

    return run


def _repeated(window: int, anchor: int, width_bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, dtype=np.uint8) for x in shared.value]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, at in chunks(batch.column(1)):
                w = Words(data, at, lower=False)
                found = _windows(w, window, anchor)
                if found is None:
                    continue
                words, anchors, doc, place = found
                new = np.ones(len(anchors), dtype=bool)
                new[1:] = anchors[1:] != anchors[:-1]
                hit = np.repeat(sketch.has_bits(bits, anchors[new], width_bits), np.diff(np.append(np.flatnonzero(new), len(new))))
                if not hit.any():
                    continue
                h1, _ = grams(words, w.first, window)
                h2, _ = grams(mix(words ^ np.uint64(0x5851F42D4C957F2D)), w.first, window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h1[hit])),
                        pa.array((h2[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids[i + doc[hit]].astype(np.int64)),
                        pa.array(place[hit].astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc_id", "at"],
                )

    return run


def _cut(window: int, names: list[str]):
    """The last two columns are the text and the marks; those before pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, digests = [], [], [], []
            for text, marks in zip(*batch.columns[-2:]):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n = len(words)
                if marks.is_valid and n:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    first = marks.values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.minimum(first + window, n), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                out = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(out)
                digests.append(hashlib.sha256(out).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                names=[*names, "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width_bits: int | None = None) -> DataFrame:
    """(doc_id, at): each window that also starts in a document with a smaller doc_id; at counts words from 0."""
    spark = docs.sparkSession
    anchor = min(anchor, window)
    width_bits = width_bits or sketch.width_for(8 * 2 * about_words(docs) / (window - anchor + 2), 22, MOST_BITS)
    bits = sketch.merged(docs.select("text").mapInArrow(_anchor_sketch(window, anchor, width_bits), sketch.SCHEMA), DEPTH, width_bits, sketch.repeated_bits)
    shared = spark.sparkContext.broadcast([x.tobytes() for x in bits])
    hits = docs.where("isnotnull(doc_id)").select(F.col("doc_id").cast("long"), "text").mapInArrow(_repeated(window, anchor, width_bits, shared), HITS)
    first = hits.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    return hits.join(first, ["h1", "h2"]).where("doc_id > first_id").select("doc_id", "at")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, width_bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the columns named in ``carry``, n_words, n_removed, kept, kept_sha256.

    Each word covered by a window whose word sequence also starts in a document with a smaller
    doc_id goes; the others stay, joined by one space. A word is a run of bytes other than space
    and \\x09-\\x0D. Null and empty texts have no words and keep the empty string. Rows with equal
    doc_id count as one document and are never cut because of each other. A null doc_id is neither
    first nor cut. Windows within one document do not count against each other. An empty table
    gives an empty table. A carried column named as a result column is left out; other columns are ignored.
    """
    carry = tuple(c for c in carry if c.lower() not in RESULT)
    marks = repeated_windows(docs, window, anchor, width_bits).groupBy("doc_id").agg(F.collect_set("at").alias("__marks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    types = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in carry)
    return rows.join(marks, "doc_id", "left").mapInArrow(_cut(window, ["doc_id", *carry]), f"doc_id long, {types}n_words long, n_removed long, kept string, kept_sha256 string")
