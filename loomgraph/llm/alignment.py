"""Alignment of the tokens of two tokenizers: where both cut a text, and which ids meet there.

A: byte-level BPE of a space and the text. B: piece BPE with byte fallback, which puts that space in front
itself. Both cut a text before every lone space, so each worker asks the libraries for the ids of a stretch between
such spaces once and keeps a bounded table of stretches. Token ends of many documents are then marked in two packed
bitsets over their bytes: AND gives the shared cuts, and the set bits before a cut (popcounts of bytes, summed) are
the number of tokens of either side that end there. Ids that end together are counted over the corpus. The counts
of the most frequent id pairs, at most ``head``, go to every task; the rest are joined, where none can be hot.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, word_pattern
from .common import dropped, released, written
from .phrases import ragged
from .tokens import byte_letters

MOST_STRETCHES = 500_000
LEARNT_AT_ONCE = 4096
#: Characters of texts that are aligned at once; a longer text is aligned alone.
GROUP_CHARS = 1_000_000
#: Pairs whose counts are broadcast: 16 bytes each.
HEAD = 1 << 20
FOLD_AT = 1 << 21


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_ranks(path: str) -> dict[bytes, int]:
    """The entries of a byte-level BPE file, without special tokens, as bytes with their ids, which follow the order of merges."""
    letters = {c: b for b, c in byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place, from popcounts of packed bytes (first bit highest)."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
    byte = at >> 3
    within = bits[byte] >> (7 - (at & 7)).astype(np.uint8)
    return before[byte] + np.bitwise_count(within)


class Vocabulary:
    def __init__(self, pieces: list[bytes]):
        self.pieces, self.size = pieces, len(pieces)
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        names = [str(k).encode() for k in range(len(pieces))]
        self.digits = np.array([len(x) for x in names], dtype=np.int64)
        width = int(self.digits.max(initial=1))
        self.names = np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(-1, width)


class Aligned:
    """Texts of a group. docs: the text of each; a, b: ids; da, db, dg: the text of each id and group; ra, rb: tokens up to each group's end; cut: bytes up to it."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, va: Vocabulary, vb: Vocabulary):
        self.n, self.a, self.b, self.da, self.db, self.va, self.vb = n, a, b, da, db, va, vb
        ends = [np.cumsum(v.length[ids]) - 1 for v, ids in ((va, a), (vb, b))]
        total = int(ends[0][-1]) + 1 if len(a) else 0
        marks = []
        for e in ends:
            mark = np.zeros(total, dtype=bool)
            mark[e] = True
            marks.append(np.packbits(mark))
        self.cut = np.flatnonzero(np.unpackbits(marks[0] & marks[1], count=total))
        self.ra, self.rb = rank(marks[0], self.cut), rank(marks[1], self.cut)
        self.dg = da[self.ra - 1]

    def per_text(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def links(self, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of linked ids of A and B and their text. ends: ids that end together; group: all of a group."""
        if rule == "ends":
            return self.ra - 1, self.rb - 1, self.dg
        first_a, first_b = np.concatenate(([0], self.ra[:-1])), np.concatenate(([0], self.rb[:-1]))
        wide = self.rb - first_b
        size = (self.ra - first_a) * wide
        g = np.repeat(np.arange(len(size)), size)
        k = ragged(np.zeros(len(size), np.int64), size)
        return first_a[g] + k // wide[g], first_b[g] + k % wide[g], self.dg[g]

    def written_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``a1,a2|b1;a3|b2,b3`` of all texts in a row, and how many each text has."""
        ga = np.searchsorted(self.ra, np.arange(len(self.a)), side="right")
        gb = np.searchsorted(self.rb, np.arange(len(self.b)), side="right")
        place_a = np.arange(len(self.a)) + np.concatenate(([0], self.rb))[ga]
        place_b = np.arange(len(self.b)) + self.ra[gb]
        width = max(self.va.names.shape[1], self.vb.names.shape[1])
        rows = np.zeros((len(self.a) + len(self.b), width + 1), np.uint8)
        digits, doc = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for v, ids, place, of in ((self.va, self.a, place_a, self.da), (self.vb, self.b, place_b, self.db)):
            rows[place, : v.names.shape[1]] = v.names[ids]
            rows[place, width] = ord(",")
            digits[place], doc[place] = v.digits[ids], of
        rows[place_a[self.ra - 1], width] = ord("|")
        last = place_b[self.rb - 1]
        rows[last, width] = ord(";")
        rows[last[np.append(self.dg[1:] != self.dg[:-1], True)] if len(last) else last, width] = 0
        full = np.arange(width + 1) < digits[:, None]
        full[:, width] = rows[:, width] > 0
        return rows[full], np.bincount(doc, weights=full.sum(axis=1), minlength=self.n).astype(np.int64)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        ranks = byte_ranks(path_a)
        self.lib_a = tiktoken.Encoding("a", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.lib_b = SentencePieceProcessor(model_file=path_b)
        self.a = Vocabulary([p for p, _ in sorted(ranks.items(), key=lambda x: x[1])])
        b = self.lib_b
        self.b = Vocabulary([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())])
        self.not_lone = re.compile(f" (?:[{WHITE}]|\\Z)|\\A(?:[{WHITE}]|\\Z)").search
        self.white = re.compile(f"[{WHITE}]").match
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.first = (array("i"), array("i")), (array("q", [0]), array("q", [0]))
        self.good = array("b")

    def stretches(self, text: str) -> list[str]:
        """The text cut before its lone spaces, which are left out; each stretch stands for a space and itself.

        A space before white space or the end, or after another space, is no place to cut.
        """
        parts = text.split(" ")
        if not self.not_lone(text):
            return parts
        out = parts[:1]
        for before, p in zip(parts, parts[1:]):
            if before and p and not self.white(p):
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def _learn(self, unknown: list[str]) -> None:
        """Ids of new stretches, and whether they give back the bytes of a space and the stretch."""
        for i in range(0, len(unknown), LEARNT_AT_ONCE):
            part = unknown[i : i + LEARNT_AT_ONCE]
            raw = [(" " + x).encode() for x in part]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            text, good = np.frombuffer(b"".join(raw), np.uint8), np.ones(len(raw), dtype=bool)
            a = [self.lib_a.encode_ordinary(" " + x) for x in part]
            b = self.lib_b.encode(part, num_threads=1)
            for v, both, kept, first in zip((self.a, self.b), (a, b), self.ids, self.first):
                ids = array("i", chain.from_iterable(both))
                counts = np.fromiter(map(len, both), np.int64, len(both))
                flat = np.frombuffer(ids, np.int32)
                made = np.add.reduceat(np.append(v.length[flat], 0), np.minimum(np.cumsum(counts) - counts, len(flat))) * (counts > 0)
                good &= made == sizes
                if good.all() and np.array_equal(v.bytes[ragged(v.start[flat], v.length[flat])], text):
                    pass
                else:
                    good &= [b"".join(map(v.pieces.__getitem__, x)) == r for x, r in zip(both, raw)]
                kept.extend(ids)
                first.extend(array("q", (first[-1] + np.cumsum(counts)).tobytes()))
            self.at.update(zip(part, range(len(self.good), len(self.good) + len(part))))
            self.good.extend(good.tolist())

    def align(self, texts: list[str | None]) -> Aligned:
        if len(self.at) > MOST_STRETCHES:
            self._clear()
        cut = [self.stretches(t) if t else [] for t in texts]
        flat = [x for parts in cut for x in parts]
        self._learn([x for x in dict.fromkeys(flat) if x not in self.at])
        at = np.fromiter(map(self.at.__getitem__, flat), dtype=np.int64, count=len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        bad = np.zeros(len(texts), dtype=bool)
        bad[doc[~np.array(self.good, dtype=bool)[at]]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        out = []
        for kept, first in zip(self.ids, self.first):
            ids, first = np.array(kept, dtype=np.int64), np.array(first)
            size = first[at + 1] - first[at]
            out.append((ids[ragged(first[at], size)], np.repeat(doc, size)))
        (a, da), (b, db) = out
        return Aligned(len(texts), a, b, da, db, self.a, self.b)


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """doc_id and text of rows whose texts have some GROUP_CHARS characters together."""
    for batch in batches:
        texts, start, held = batch.column(1).to_pylist(), 0, 0
        for k, t in enumerate(texts):
            held += len(t or "")
            if held >= GROUP_CHARS or k + 1 == len(texts):
                yield batch.column(0).slice(start, k + 1 - start), texts[start : k + 1]
                start, held = k + 1, 0


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values, kind))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, a_ids, b_ids, a_ends, b_ends, cuts.

    cuts: byte offsets in space+text where tokens of both end; a_ends, b_ends: how many tokens end up to each. A text that
    is null, empty or not given back by the tokens of either side has empty arrays. Rows repeat as they stand.
    """
    path_a, path_b = path_a or byte_bpe_path(), path_b or piece_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            x = _aligner(path_a, path_b).align(texts)
            na, nb, ng = x.per_text(x.da), x.per_text(x.db), x.per_text(x.dg)
            size = np.bincount(x.da, weights=x.va.length[x.a], minlength=x.n).astype(np.int64)
            starts = [np.cumsum(n) - n for n in (na, nb, size)]
            own = [e - s[x.dg] for e, s in zip((x.ra, x.rb, x.cut + 1), starts)]
            yield pa.RecordBatch.from_arrays(
                [ids, _lists(x.a, na, pa.int32()), _lists(x.b, nb, pa.int32()), _lists(own[0], ng, pa.int32()), _lists(own[1], ng, pa.int32()), _lists(own[2], ng, pa.int64())],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "cuts"],
            )

    return _rows(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, cuts array<long>")


def _digests(path_a: str, path_b: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            x = _aligner(path_a, path_b).align(texts)
            na, nb, ng = x.per_text(x.da), x.per_text(x.db), x.per_text(x.dg)
            raw, size = x.written_groups()
            ends = np.cumsum(size)
            data = raw.tobytes()
            sha = [hashlib.sha256(data[e - s : e]).hexdigest() if s else "" for s, e in zip(size.tolist(), ends.tolist())]
            i, j, of = x.links(rule)
            pair = x.a[i] * x.vb.size + x.b[j]
            order = np.lexsort((pair, of))
            pair, of = pair[order], of[order]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(pair)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(na), pa.array(nb), pa.array(ng), pa.array(x.per_text(of)), pa.array(sha, pa.string()), *(_lists(v, x.per_text(of[at]), kind) for v, kind in ((pair[at], pa.int64()), (times, pa.int32())))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return run


DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, times and the row of each, from columns pairs and times."""
    pairs, times = batch.column("pairs"), batch.column("times")
    size = np.diff(pairs.offsets.to_numpy())
    return pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), size)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = folded = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        pair, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, back, np.concatenate([c for _, c in parts]))
        return pair, n

    def emit() -> Iterator[pa.RecordBatch]:
        pair, n = fold()
        for i in range(0, len(pair), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["pair", "c"])

    for batch in batches:
        pair, times, _ = _flat(batch)
        parts.append((pair, times))
        held += len(pair)
        if held >= folded + FOLD_AT:
            if folded > 2 * FOLD_AT:
                yield from emit()
                parts, folded = [], 0
            else:
                parts = [fold()]
                folded = len(parts[0][0])
            held = folded
    if parts:
        yield from emit()


def _score(head, best, size_b: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, count), top = head.value, best.value
        for batch in batches:
            pair, times, row = _flat(batch)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), dtype=bool)
            c = np.where(hit, count[at], 0) if len(known) else np.zeros(len(pair), np.int64)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row, times * (hit & (c == top[pair % size_b])))
            np.add.at(sums[1], row, times * c)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), batch.column("groups_sha256")], names=[*SCORED])

    return run


SCORED = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _rare(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value[0]
        for batch in batches:
            pair, times, row = _flat(batch)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            rare = known[at] != pair if len(known) else np.ones(len(pair), dtype=bool)
            ids = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[rare]]), pa.array(pair[rare]), pa.array(times[rare])], names=["row", "pair", "times"])

    return run


def link_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, links: str = "ends", head: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    links: ``ends`` links the ids of A and B that end together at a shared cut, ``group`` all ids of a group. An id pair's
    count is how many links of the corpus have it; n_best are the links whose count is the highest of their B id (ties included),
    count_sum the sum of the links' counts. groups_sha256: of ``a1,a2|b1;a3|b2,b3``, '' without tokens. A text that is null, empty or not given
    back by the tokens of either side has zeros. Repeated rows and null ids count as they stand; other columns are ignored.
    """
    if links not in ("ends", "group"):
        raise ValueError("links: ends or group")
    spark, path_a, path_b = docs.sparkSession, path_a or byte_bpe_path(), path_b or piece_path()
    size_b = _aligner(path_a, path_b).b.size
    found = written(_rows(docs).mapInArrow(_digests(path_a, path_b, links), DIGESTS).withColumn("row", F.monotonically_increasing_id()), "links")
    counts = written(found.select("pairs", "times").mapInArrow(_count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")), "counts")
    by_b = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("c").alias("top"))
    top = np.zeros(size_b, np.int64)
    for r in by_b.collect():  # one row for each id of the vocabulary at most
        top[r["b"]] = r["top"]
    bits = F.length(F.bin("c"))  # the head are the pairs whose counts have so many binary digits
    sizes = {r["bits"]: r["n"] for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("n")).collect()}
    least = 64
    while least > 1 and sum(n for b, n in sizes.items() if b >= least - 1) <= head:
        least -= 1
    frequent = counts.where(bits >= least).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast((frequent.column("pair").to_numpy(), frequent.column("c").to_numpy()))
    best = spark.sparkContext.broadcast(top)
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = found.mapInArrow(_score(known, best, size_b), kinds)
    if any(b < least for b in sizes):
        rare = found.select("row", "pairs", "times").mapInArrow(_rare(known), "row long, pair long, times long")
        rare = rare.join(counts.where(bits < least), "pair").join(F.broadcast(by_b), F.col("pair") % size_b == F.col("b"))
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("c")).alias("more_sum"))
        out = out.join(rare, "row", "left").withColumn("n_best", F.expr("n_best + coalesce(more_best, 0)")).withColumn("count_sum", F.expr("count_sum + coalesce(more_sum, 0)"))
    return out.select(*SCORED[1:])
