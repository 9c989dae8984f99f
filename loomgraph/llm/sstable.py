"""Token ids in sorted-string-table shards, and how to look documents up in them.

A shard holds the documents of one range of doc_ids in ascending order:

    blocks   entries until a block has ``BLOCK`` bytes, compressed. An entry is the number of key bytes
             shared with the key before, the number of the others, the value's length (each a
             variable-length integer), the other key bytes, and the value: the shard's ids before
             this document (8 bytes) and the ids (2 or 4 bytes each).
    index    for each block its last key, place and length
    bloom    a Bloom filter of the keys
    footer   places and lengths of index and bloom, number of documents and ids, width of an id, magic

Numbers are little-endian. A key is empty for a null doc_id, else 8 big-endian bytes of doc_id with
the sign bit turned, so that keys sort as bytes in the order of ids, null first. A look-up asks the
filter, finds the block by binary search in the index, and reads that block alone. Rows with equal
doc_id stand next to each other, the order among them that of their texts' ids.

Shards are written under a name of their own attempt and then renamed, so that a task may be run
again; a range's final name does not depend on the attempt.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_parts, new_path, written
from .tokens import encoder, utf8, word_bpe_path

BLOCK = 1 << 18
MAGIC = b"LGSST001"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
END_ID = 2
SHARDS = "bucket int, uri string, n_docs long, n_ids long, size long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        bloom = cls(np.zeros(max(8, len(keys) * BLOOM_BITS_PER_KEY // 8 + 1), dtype=np.uint8))
        for key in set(keys):
            for p in bloom._places(key):
                bloom.bits[p >> 3] |= 1 << (p & 7)
        return bloom

    def _places(self, key: bytes) -> list[int]:
        a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 & 0xFFFFFFFF | 1
        return [(a + k * b) % (8 * len(self.bits)) for k in range(BLOOM_HASHES)]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


@dataclass
class ShardWriter:
    """Writes one shard; documents come in key order."""

    uri: str
    width: int
    before: bytes = b""
    block: bytearray = field(default_factory=bytearray)
    index: list[tuple[bytes, int, int]] = field(default_factory=list)
    keys: list[bytes] = field(default_factory=list)
    at: int = 0
    n_ids: int = 0

    def __post_init__(self) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(self.uri)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.attempt)
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.before))
            while shared < most and key[shared] == self.before[shared]:
                shared += 1
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, 8 + len(ids))
        self.block += key[shared:]
        self.block += struct.pack("<Q", self.n_ids)
        self.block += ids
        self.before = key
        self.keys.append(key)
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = self.pack.compress(bytes(self.block))
            self.out.write(raw)
            self.index.append((self.before, self.at, len(raw)))
            self.at += len(raw)
            self.block = bytearray()

    def close(self) -> tuple[int, int, int]:
        self._end_block()
        index = bytearray()
        for key, at, size in self.index:
            put_varint(index, len(key))
            index += key
            put_varint(index, at)
            put_varint(index, size)
        bloom = Bloom.of(self.keys).bits.tobytes()
        self.out.write(bytes(index))
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.attempt, self.path)
        return len(self.keys), self.n_ids, self.at + len(index) + len(bloom) + FOOTER.size


class ShardReader:
    """Reads one shard: all documents in order, or one by binary search."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw, at = self.file.read_at(index_len, index_at), 0
        self.index: list[tuple[bytes, int, int]] = []
        while at < len(raw):
            n, at = get_varint(raw, at)
            key = raw[at : at + n]
            place, at = get_varint(raw, at + n)
            length, at = get_varint(raw, at)
            self.index.append((key, place, length))
        self.bloom = Bloom(np.frombuffer(self.file.read_at(bloom_len, bloom_at), dtype=np.uint8))

    def _block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, place, length = self.index[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, place))
        at, key = 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, struct.unpack_from("<Q", data, at)[0], data[at + 8 : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, its ids as stored)."""
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document of that id, or None."""
        key = key_of(doc_id)
        if not self.bloom.may_hold(key):
            return None
        k = bisect_left(self.index, key, key=lambda x: x[0])
        if k < len(self.index):
            for found, _, ids in self._block(k):
                if found == key:
                    return np.frombuffer(ids, dtype=f"<u{self.width}").astype(np.uint32)
        return None


def _encode(path: str, end_id: int, edges: list[int], width: int):
    cut = np.array(edges, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            bucket = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cut, ids.fill_null(0).to_numpy(), side="right"))
            packed = []
            for raw in enc.encode(utf8(batch.column(1))):
                packed.append(squeeze.compress(np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id)).astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), ids, pa.array(packed, pa.binary())], names=["bucket", "doc_id", "ids"])

    return run


def _write(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[int, ShardWriter] | None = None
        expand = zstandard.ZstdDecompressor()

        def end(x: tuple[int, ShardWriter]) -> pa.RecordBatch:
            n_docs, n_ids, size = x[1].close()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([x[0]], pa.int32()), "uri": [x[1].uri], "n_docs": [n_docs], "n_ids": [n_ids], "size": [size]})

        for batch in batches:
            for bucket, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if open_ and open_[0] != bucket:
                    yield end(open_)
                    open_ = None
                if not open_:
                    # A second attempt of the task writes a file of its own; the table of shards names that of the attempt that counted.
                    open_ = (bucket, ShardWriter(f"{folder}/shard-{bucket:06d}-{uuid.uuid4().hex}.sst", width))
                open_[1].add(key_of(doc_id), expand.decompress(ids.as_buffer()))
        if open_:
            yield end(open_)

    return run


def write_sstables(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, n_shards: int | None = None) -> DataFrame:
    """Write the ids of each row of ``docs`` (doc_id, text) and return the table of shards.

    Each row's ids are those of its whole text (null: empty) by the tokenizer at ``path``, then
    ``end_id``. Shards are ranges of doc_id of about equal row counts. Columns: bucket (in the order
    of the ranges), uri, n_docs, n_ids, size. An empty table has no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    path, folder = path or word_bpe_path(), folder or new_path(spark, "sstables")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = n_shards or 4 * n_parts(spark)
    at = docs.where("isnotnull(doc_id)").agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else []
    edges = sorted(set(at or []))
    width = 2 if encoder(path).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.mapInArrow(_encode(path, end_id, edges, width), "bucket int, doc_id long, ids binary")
    placed = rows.repartition(n_parts(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return written(placed.mapInArrow(_write(folder, width), SHARDS), "shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = ShardReader(uri)
            rows: list[tuple] = []
            for key, start, ids in shard:
                wide = np.frombuffer(ids, dtype=f"<u{shard.width}").astype("<u4")
                rows.append((id_of(key), base + start, len(wide), zlib.crc32(wide.tobytes())))
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_sstables(shards: DataFrame) -> DataFrame:
    """Read all shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    spark: SparkSession = shards.sparkSession
    base, bases = 0, []
    for r in shards.select("bucket", "uri", "n_ids").orderBy("bucket").collect():  # one row for each shard
        bases.append((r["uri"], base))
        base += r["n_ids"]
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    table = spark.createDataFrame(bases, "uri string, base long").repartition(min(len(bases), n_parts(spark)))
    return table.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
