"""Words, word hashes and word n-gram hashes of whole Arrow batches of texts.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. Everything is done with
numpy over the UTF-8 bytes of many documents at once, so no Python object is made per word.
Hashes are 64-bit polynomials over odd multipliers, finished by an integer mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
BYTE_MULT = 0x9E3779B97F4A7C15 | 1
WORD_MULT = 0xC2B2AE3D27D4EB4F | 1
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Growing table of powers of an odd multiplier and of its inverse, modulo 2**64."""

    def __init__(self, mult: int):
        self.mult, self.inv = mult, pow(mult, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, m in (("up", self.mult), ("down", self.inv)):
                    steps = np.full(size, m, dtype=U)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_MULT), _Powers(WORD_MULT)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 places where they start. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    ends = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents in groups of about ``size`` bytes: first and past-last row, bytes, starts."""
    data, at = buffers(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a group of documents.

    start, end: byte positions; first: for each document its first word (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool):
        self.data = (LOWER if lower else SAME)[data] if lower else data
        full = ~SPACE[data]
        begin, stop = full.copy(), full.copy()
        if len(full):
            begin[1:] &= ~full[:-1]
            stop[:-1] &= ~full[1:]
            head = at[:-1][(at[:-1] < at[1:])]
            tail = at[1:][(at[:-1] < at[1:])] - 1
            begin[head] = full[head]
            stop[tail] = full[tail]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at)
        self.counts = np.diff(self.first)
        self._sums = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            up, _ = _BYTES.get(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, dtype=U)
            x = self.data.astype(U)
            x += U(1)
            x *= up[: len(x)]
            np.cumsum(x, out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``longest`` bytes."""
        sums, (_, down) = self._prefix(), _BYTES.get(len(self.data) + 1)
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        h = (sums[end] - sums[self.start]) * down[self.start]
        h += (end - self.start).astype(U) * U(0xD6E8FEB86659FD93)
        return mix(h)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and the n + 1 places where each document's begin."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    if not bounds[-1]:
        return np.zeros(0, dtype=U), bounds
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    place = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts)
    out = (sums[place + n] - sums[place]) * down[place]
    return mix(out + U(n)), bounds


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of all runs of n entries (len(x) - n + 1 of them)."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sequence_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(U))
