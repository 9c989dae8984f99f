"""Best-fit packing of token sequences by hierarchical residuals.

Each partition packs its own pieces, largest first, each into the fullest bin that still takes it.
Nearly full bins are final. All others are items of the next round, in which a tree merges groups of
partitions and packs again. A round has a group for every ``most`` items, if that is more than the
tree asks for, so no task gets more, whatever the input. The last round is the one with one group, or
the one after which a merge no longer takes away a hundredth of the bins: what is left then fits
nowhere, such as documents of just over half a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, utf8, word_bpe_path

CAPACITY = 4096
END_ID = 1
NEARLY_FULL = 0.995
FAN_IN = 8
#: Items that a task packs at once.
MOST_ITEMS = 50_000
#: A round that leaves more than this share of its bins unfinished is followed by one last round.
STALLED = 0.99
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = "size int, done boolean, level int, part int, number int, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Items go largest first (ties: lower number first) into the fullest bin that takes them."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes = 0  # bit r: some bin has r places free
    for k in order:
        s = sizes[k]
        above = open_sizes >> s
        if above and s:
            room = s + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_sizes &= ~(1 << room)
            bins[b].append(k)
        else:
            b, room = len(bins), capacity
            bins.append([k])
        left = room - s
        if left:
            free[left].append(b)
            open_sizes |= 1 << left
    return bins


def _emit(level: int, last: bool, items: list[tuple[int, list]], capacity: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The bins of the items, numbered from ``first``."""
    items.sort(key=lambda x: (-x[0], x[1][0][0] if x[1][0][0] is not None else -1, x[1][0][1]))
    bins = best_fit([s for s, _ in items], capacity)
    full = [sum(items[k][0] for k in b) for b in bins]
    done = [last or n >= NEARLY_FULL * capacity for n in full]
    part = TaskContext.get().partitionId()
    for i in range(0, len(bins), 512):
        some = range(i, min(i + 512, len(bins)))
        rows = [[p for k in bins[b] for p in items[k][1]] for b in some]
        flat = [p for r in rows for p in r]
        at = [n - p[3] for r in rows for n, p in zip(accumulate(p[3] for p in r), r)]
        cols = [pa.array([p[c] for p in flat], PIECE.field(c).type) for c in range(5)] + [pa.array(at, pa.int64())]
        pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), pa.StructArray.from_arrays(cols, fields=list(PIECE)))
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([full[b] for b in some], pa.int32()), pa.array([done[b] for b in some]), pa.array([level] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([first + b for b in some], pa.int32()), pieces],
            names=["size", "done", "level", "part", "number", "pieces"],
        )


def _packed(level: int, last: bool, capacity: int, most: int, items: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
    """Bins of a task's items, at most ``most`` items at once."""
    held: list[tuple[int, list]] = []
    first = 0
    for item in items:
        held.append(item)
        if len(held) >= most:
            yield from _emit(level, last, held, capacity, first)
            first, held = first + len(held), []
    yield from _emit(level, last, held, capacity, first)


def _tokenise_and_pack(path: str, capacity: int, end_id: int, most: int, last: bool):
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)

        def items() -> Iterator[tuple[int, list]]:
            for batch in batches:
                for doc_id, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                    ids = enc.one(raw) + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        yield len(part) // 4, [(doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))]

        yield from _packed(0, last, capacity, most, items())

    return run


def _repack(level: int, last: bool, capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple[int, list]]:
            for batch in batches:
                for size, pieces in zip(batch.column("size").to_pylist(), batch.column("pieces").to_pylist()):
                    yield size, [tuple(p.values()) for p in pieces]

        yield from _packed(level, last, capacity, most, items())

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = FAN_IN, most: int = MOST_ITEMS) -> DataFrame:
    """Per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are those of its whole text (null: empty) by the tokenizer at ``path``, then
    ``end_id``; so an empty text has one piece of one id. Only rows longer than ``capacity`` are cut.
    Rows with equal or null doc_id are packed each on its own. sequence_id tells the round, the task
    and the bin; offset is the place in the sequence, without gaps. An empty table gives an empty
    table. Other columns are ignored.
    """
    path = path or word_bpe_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = docs.rdd.getNumPartitions()
    rounds = [written(docs.mapInArrow(_tokenise_and_pack(path, capacity, end_id, most, parts <= 1), BINS), "bins")]
    before, last = None, parts <= 1
    while not last:
        left = rounds[-1].where("not done")
        n = left.count()
        parts = max(1, -(-parts // fan_in), -(-n // most))
        last = parts == 1 or (before is not None and n > STALLED * before)
        # Rows are dealt out in turn, so that tasks have equal numbers of them.
        rounds.append(written(left.repartition(parts).mapInArrow(_repack(len(rounds), last, capacity, 2 * most), BINS), "bins"))
        before = n
    final = rounds[0].where("done")
    for r in rounds[1:]:
        final = final.unionByName(r.where("done"))
    number = F.shiftleft(F.col("level").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("part").cast("long"), 28)).bitwiseOR(F.col("number").cast("long"))
    return final.select(number.alias("sequence_id"), F.explode("pieces").alias("p")).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
