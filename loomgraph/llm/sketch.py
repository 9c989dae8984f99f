"""Count-min sketches that partitions fill and that are merged slice by slice.

The width is a parameter, so the merged sketch, the only thing that comes to the driver and is
broadcast, has a proven size whatever the input. Counters saturate at ``LIMIT``; an estimate
never falls below the true count, or below ``LIMIT`` where that is smaller.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import n_parts

LIMIT = 255
SLICE_BITS = 20
SCHEMA = "slice int, dense boolean, counters binary"


def cells(keys: np.ndarray, depth: int, width_bits: int) -> list[np.ndarray]:
    """The place of each key in each row of a sketch with ``depth`` rows of 2**width_bits counters."""
    shift = np.uint64(64 - width_bits)
    return [(keys * np.uint64((0x632BE59BD9B4E019 * (2 * r + 1) & (1 << 64) - 1) | 1)) >> shift for r in range(depth)]


class Partial:
    """The sketch of one partition, kept as the counters that are not zero."""

    def __init__(self, depth: int, width_bits: int, compact_at: int = 1 << 22):
        self.depth, self.width_bits, self.compact_at = depth, width_bits, compact_at
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth)]
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        for parts, cell in zip(self.parts, cells(keys, self.depth, self.width_bits)):
            place, n = np.unique(cell.astype(np.uint32), return_counts=True)
            parts.append((place, np.minimum(n, LIMIT).astype(np.uint8)))
        self.held += len(keys)
        if self.held >= self.compact_at:
            self._compact()

    def _compact(self) -> None:
        for parts in self.parts:
            if len(parts) > 1:
                place = np.concatenate([p for p, _ in parts])
                n = np.concatenate([c for _, c in parts]).astype(np.int64)
                place, back = np.unique(place, return_inverse=True)
                parts[:] = [(place, np.minimum(np.bincount(back, weights=n), LIMIT).astype(np.uint8))]
        self.held = sum(len(p) for parts in self.parts for p, _ in parts) // self.depth
        self.compact_at = max(self.compact_at, 2 * self.held)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._compact()
        bits = min(SLICE_BITS, self.width_bits)
        per_row = 1 << (self.width_bits - bits)
        for r, parts in enumerate(self.parts):
            if not parts:
                continue
            place, n = parts[0]
            edges = np.searchsorted(place, np.arange(per_row + 1, dtype=np.int64) << bits)
            for k in range(per_row):
                a, b = edges[k], edges[k + 1]
                if a == b:
                    continue
                at = (place[a:b] & np.uint32((1 << bits) - 1)).astype(np.uint32)
                dense = (b - a) * 5 > (1 << bits) // 2
                if dense:
                    full = np.zeros(1 << bits, dtype=np.uint8)
                    full[at] = n[a:b]
                    raw = zlib.compress(full.tobytes(), 1)
                else:
                    raw = at.tobytes() + n[a:b].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r * per_row + k], pa.int32()), pa.array([dense]), pa.array([raw], pa.binary())], names=["slice", "dense", "counters"])


def merged(parts: DataFrame, depth: int, width_bits: int, reduce: Callable[[np.ndarray], np.ndarray] | None = None) -> list[np.ndarray]:
    """Add up the partial slices; each task adds a few slices as a stream. ``depth`` arrays come to the driver.

    reduce is applied to each merged slice before it is sent (such as: which counters reach two).
    """
    bits = min(SLICE_BITS, width_bits)
    size, per_row = 1 << bits, 1 << (width_bits - bits)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in frames:
            for k, dense, raw in zip(pdf["slice"], pdf["dense"], pdf["counters"]):
                total = sums.setdefault(k, np.zeros(size, dtype=np.uint8))
                if dense:
                    at, n = slice(None), np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
                else:
                    m = len(raw) // 5
                    at, n = np.frombuffer(raw, dtype=np.uint32, count=m), np.frombuffer(raw, dtype=np.uint8, offset=4 * m)
                total[at] = np.minimum(total[at].astype(np.uint16) + n, LIMIT).astype(np.uint8)
        for k, x in sums.items():
            yield pd.DataFrame({"slice": [k], "counters": [zlib.compress((reduce(x) if reduce else x).tobytes(), 1)]})

    n = min(n_parts(parts.sparkSession), depth * per_row)
    rows = parts.select("slice", "dense", "counters").repartition(max(1, n), "slice").mapInPandas(add, "slice int, counters binary").collect()
    unit = np.zeros(size, dtype=np.uint8)
    each = len(reduce(unit) if reduce else unit)
    out = [np.zeros(per_row * each, dtype=np.uint8) for _ in range(depth)]
    for r in rows:
        row, k = divmod(r["slice"], per_row)
        out[row][k * each : (k + 1) * each] = np.frombuffer(zlib.decompress(r["counters"]), dtype=np.uint8)
    return out


def width_for(n: float, low: int, high: int) -> int:
    """Bits of the width that has about n counters, between low and high (the proven bound)."""
    return int(min(high, max(low, math.ceil(math.log2(max(2.0, n))))))


def repeated_bits(counters: np.ndarray) -> np.ndarray:
    return np.packbits(counters >= 2, bitorder="little")


def any_bits(counters: np.ndarray) -> np.ndarray:
    return np.packbits(counters >= 1, bitorder="little")


def has_bits(bits: list[np.ndarray], keys: np.ndarray, width_bits: int) -> np.ndarray:
    """For each key, whether its bit is set in every row."""
    found = np.ones(len(keys), dtype=bool)
    for row, cell in zip(bits, cells(keys, len(bits), width_bits)):
        found &= (row[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
