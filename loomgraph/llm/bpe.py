"""Byte-level BPE: text to token ids and back.

``encode`` is the production form. Each task keeps the distinct words it has met, folds the ranked
merges over a word's bytes once (always the leftmost pair of lowest rank), and strings the words'
ids together; decoding concatenates the byte pieces of the ids.

``encode_native`` is the same by Spark's higher-order functions alone, with the ranks as a literal:
distinct words, a fold of merges over each, a join back to the places of the words. Every word of
every document then goes through a shuffle, which is more disk than the input has; see the README.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import utf8

#: White space as the tokenizer library has it; engines differ in what \s is.
WHITE = r"\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MOST_CHUNKS = 300_000
MOST_WORDS = 300_000
#: Bytes from which a word's merges are taken from a heap.
LONG_WORD = 128


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def plain_classes(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, from a heap of pairs, for words whose pairs are too many to look through at each merge."""
    n = len(word)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here any more
    begin = list(range(-1, n))  # where the part that ends here begins
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int, mid: int, stop: int) -> None:
        r = ranks.get(word[i:stop])
        if r is not None:
            heapq.heappush(heap, (r, i, mid, stop))

    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid], begin[stop] = stop, 0, i
        if stop < n:
            push(i, stop, end[stop])
        if i:
            push(begin[i], i, stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost adjacent pair of lowest rank until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get, none = ranks.get, len(ranks) + (1 << 30)
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class ByteEncoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.words_of = regex.compile(plain_classes(pattern)).findall
        self.white = regex.compile(f"[{WHITE}]").match
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        out = []
        for word in self.words_of(text):
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= MOST_WORDS:
                    self.words.clear()
                ids = self.words[word] = np.array(fold(word.encode(), self.ranks), dtype="<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def _learn(self, chunk: bytes) -> bytes | None:
        """The ids of a space and what stands up to the next one; None if that begins with white space."""
        text = chunk.decode()
        if not text or self.white(text):
            return None
        if len(self.chunks) >= MOST_CHUNKS:
            self.chunks.clear()
        ids = self.chunks[chunk] = self.whole(" " + text)
        return ids

    def encode(self, raw: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A word never runs on from other characters into white space, and takes along one space at
        most in front. So where each space stands alone, the text falls apart before each space.
        """
        head, *chunks = raw.split(b" ")
        try:
            tail = b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            found = []
            for c in chunks:
                ids = self.chunks.get(c)
                if ids is None:
                    ids = self._learn(c)
                    if ids is None:
                        return self.whole(raw.decode())
                found.append(ids)
            tail = b"".join(found)
        return self.whole(head.decode()) + tail

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids = [enc.encode(x) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids (binary: little-endian unsigned 32-bit integers).

    Whole texts; null and empty texts have no ids. No special tokens: their strings are plain text.
    Repeated rows are encoded each; a null doc_id stays. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(path or rank_path(), pattern or word_pattern()), "doc_id long, ids binary")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Per row (doc_id, ids as ``encode`` gives them): doc_id, ids, decoded (binary). Null ids: empty."""
    path = path or rank_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, word_pattern())
        for batch in batches:
            out = [enc.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Round trip of each row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes)."""
    path, pattern = path or rank_path(), pattern or word_pattern()
    inner = _encode(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in inner(batches):
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


BUCKETS = 1 << 14


def encode_native(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by higher-order functions only; doc_id is unique and not null.

    The ranks are one literal: an array of small maps, found by a checksum of the pair, since a map's
    look-up reads the map from its start.
    """
    ranks = load_ranks(path or rank_path())
    import zlib

    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        table[zlib.crc32(name.encode()) % BUCKETS][name] = rank
    table_sql = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")
    pieces = F.from_json(F.lit(json.dumps([p.hex().upper() for p, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")

    def rank(x):
        return F.try_element_at(F.element_at(table_sql, (F.crc32(x.cast("binary")) % BUCKETS + 1).cast("int")), x)

    def step(parts, _):
        found = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: rank(F.concat(x, F.get(parts, i + 1))))
        at = F.array_position(found, F.array_min(found)).cast("int")
        joined = F.concat(F.slice(parts, 1, at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))
        return F.when(F.array_min(found).isNull(), parts).otherwise(joined)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("doc_id", F.posexplode(F.expr(f"regexp_extract_all(text, r\"{plain_classes(pattern or word_pattern())}\", 0)")).alias("at", "word"))
    letters = F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit("(..)"), F.lit(1))
    vocabulary = words.select("word").distinct().select("word", letters.alias("letters"))
    merged = vocabulary.select("word", F.aggregate(F.sequence(F.lit(1), F.size("letters")), F.col("letters"), step).alias("parts"))
    coded = merged.select("word", F.transform("parts", rank).alias("ids"))
    rows = words.join(coded, "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
    flat = texts.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce(F.flatten("x.ids"), F.array().cast("array<int>")).alias("ids"))

    def little_endian(i):
        h = F.lpad(F.hex(i.cast("long")), 8, "0")
        return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))

    return flat.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.unhex(F.array_join(F.transform("ids", little_endian), "")), 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), "")), 256).alias("decoded_sha256"),
    )
