"""Removal of fuzzily repeated lines: SimHash, pigeonhole blocks, edit similarity, one line kept of each group.

A line is normalised to its words (runs other than space and \\x09-\\x0D), lower-cased in A-Z and
joined by one space. Equal lines are one line from the start. A line's SimHash is a row of 64-bit
blocks. Each of its features (words of over three bytes; for lines of few such words, runs of four
bytes) votes in the block that its own hash names, and a block's bits are the majority of its votes.
So an edit reaches only the blocks of the features that it removes and adds, and by the pigeonhole
principle the others stay equal: two lines are candidates when a block is equal. The number of blocks
follows the line's length, a few features to a block; lines of lengths near a change of that
number have the blocks of both numbers, short lines have several ways of dealing features to blocks,
and of a long line's blocks the first BLOCKS are enough to meet by. Lines of up to TINY characters, whose features
are too few for that, also meet by what is left of them when one or two characters are deleted: two such
lines that are similar enough always have such a rest in common.

Candidates link when 1 - edit distance / longer length >= SIMILARITY. Of each connected group of
lines the first occurrence, by doc_id and place, stays.

Each task sends one entry for each of its block values, packed, to the task where equal values meet,
and lines that meet inside one task at once; so a block value that most lines share is one entry from
each task. Where lines meet, each is first compared to the most frequent of them and, while very many pairs
are open, to some lines of the largest group. What the found links join needs no more comparison, and all other pairs are then compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import dropped, n_parts, released, written
from ..operators.components import components
from .words import U, Words, chunks, mix, sequence_ids, signed

SIMILARITY = 0.8
#: Blocks by which a line meets others, of one number of blocks.
BLOCKS = 8
#: The fewest features of a block that counts, and their average number: for words and for runs of bytes.
WORD_BLOCK, RUN_BLOCK = (3, 5.0), (4, 6.0)
#: Lines so near (in powers of two) to a change of the number of blocks have both: similar lines differ by less.
SLACK = 0.35
#: Words of more bytes are features; lines with at least FEW_WORDS of them have blocks of words, with at most SOME_WORDS blocks of byte runs.
SHORT_WORD = 3
FEW_WORDS, SOME_WORDS = 7, 11
RUN = 4
#: Lines of one kind whose SimHashes in one block of 64 bits differ in more are no candidates.
DISTANCE = 20
#: Lines of up to so many characters meet by their rests too; the most edits between two of them follow from SIMILARITY.
TINY = 14
#: Classes of byte pairs whose counts bound an edit distance from below.
PAIR_CLASSES = 1 << 12
BLOOM_BITS = 26
LETTERS = 32
#: With how many lines of each block value the others are compared in a round; a further round is made while more than OPEN pairs for each line and block value are left.
CENTRES, OPEN = (1, 32), 8
#: Words of 64 bits that edit distances are worked out in at once, entries of their tables, and the fewest words for which that pays.
MOST_WORDS, MOST_MASKS, LEAST_WORDS = 1 << 12, 1 << 18, 160
#: Entries that a task holds before it sends them.
MOST_ENTRIES = 1 << 21
#: Rows of packed entries for each partition that they are dealt to.
SHARES = 8
RESULT = ("doc_id", "n_lines", "n_removed", "kept", "kept_sha256", "text")

VOTE_BITS = 40
#: For each byte its bits, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U).ravel()


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """All lines of a group of documents as if they were documents; the document and place of each."""
    edges, owner, place = _edges(data, at)
    return Words(data, edges, lower=True), owner, place


def _edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10) + 1
    edges = np.sort(np.concatenate([at[:-1], breaks, at[-1:]]), kind="stable")
    # A line break at a document's end starts an empty line of that document, at the same byte as the next document.
    owner = np.repeat(np.arange(len(at) - 1), np.bincount(np.searchsorted(at[1:], breaks - 1, side="right"), minlength=len(at) - 1) + 1)
    first = np.searchsorted(owner, owner)
    return edges, owner, np.arange(len(owner)) - first


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of the next."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def _majority(votes: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots that have votes (hashes, each counting once in a slot), their number, and the majority of each bit."""
    both = np.sort(slot.astype(U) << U(VOTE_BITS) | votes >> U(64 - VOTE_BITS))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    slot, votes = both >> U(VOTE_BITS), mix(both & U((1 << VOTE_BITS) - 1))
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    count = np.diff(np.append(first, len(slot)))
    ones = np.empty((len(first), 8), dtype=U)
    for k in range(8):
        ones[:, k] = np.add.reduceat(_SPREAD[(votes >> U(8 * k)).astype(np.uint8)], first)
    bits = ones.view(np.uint8).astype(np.uint16) * 2 > count[:, None]
    return slot[first].astype(np.int64), count, np.packbits(bits, axis=1).view(U).ravel()


def _blocks(features: np.ndarray, first: np.ndarray, kind: int, least: int, group: float) -> tuple[np.ndarray, np.ndarray]:
    """Block values of lines, given each line's features (hashes): (values, lines)."""
    m = np.diff(first)
    x = np.log2(np.maximum(m, 1) / group)
    middle = np.rint(x)
    values, lines = [], []
    for step in (-1, 0, 1):
        use = m >= 2 * least
        if step:
            use &= ((x - middle) * step > 0.5 - SLACK) & (middle + step >= 1)
        power = np.maximum(middle + step, 1).astype(np.int64)
        rounds = -(-BLOCKS // np.minimum(1 << np.minimum(power, 20), BLOCKS))
        for r in range(int(rounds[use].max()) if use.any() else 0):
            own = np.flatnonzero(use & (rounds > r))
            owner = np.repeat(np.arange(len(own)), m[own])
            f = mix(features[_ranges(first[:-1][own], m[own])] ^ U((2 * r + 1) * 0xA0761D6478BD642F % (1 << 64)))
            block = (f >> (U(64) - power[own][owner].astype(U))).astype(np.int64)
            some = block < BLOCKS
            if not some.any():
                continue
            slot, count, bits = _majority(mix(f[some]), owner[some] * BLOCKS + block[some])
            full = count >= least
            slot, bits = slot[full], bits[full]
            line = own[slot // BLOCKS]
            name = ((power[line] * 64 + r) * BLOCKS + slot % BLOCKS) * 2 + kind
            values.append(mix(bits ^ mix(name.astype(U))))
            lines.append(line)
    if not values:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(lines)


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words over SHORT_WORD bytes, where each line's begin."""
    long = w.end - w.start > SHORT_WORD
    return w.hashes()[long], np.concatenate(([0], np.cumsum(long)))[w.first]


def _runs(w: Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of RUN bytes of the normalised lines ``own``, which have words, and where each line's begin."""
    words = _ranges(w.first[:-1][own], w.counts[own])
    length = (w.end - w.start)[words] + 1
    flat = w.data[np.minimum(_ranges(w.start[words], length), len(w.data) - 1)].copy()
    flat[np.cumsum(length) - 1] = 32
    line_size = np.add.reduceat(length, np.cumsum(w.counts[own]) - w.counts[own])
    runs = np.maximum(line_size - (RUN - 1), 0)
    at = _ranges(np.cumsum(line_size) - line_size, runs)
    value = np.zeros(len(at), dtype=U)
    for k in range(RUN):
        value |= flat[at + k].astype(U) << U(8 * k)
    return mix(value), np.concatenate(([0], np.cumsum(runs)))


def rests(line: str, similarity: float = SIMILARITY) -> list[int]:
    """Hashes of what is left of a short line when as many characters are deleted as it may differ in from one of TINY characters at most.

    A line that is compared to a longer one may differ by what the longer one's length allows.
    """
    n = len(line)
    most = max((k for m in range(n, TINY + 1) for k in [int((1 - similarity) * m + 1e-9)] if m - n <= k), default=0)
    found = last = {line}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return [xxhash.xxh64_intdigest(x.encode(), seed=TINY) for x in found]


def _tiny_values(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The rests of the lines of up to TINY characters: (values, lines)."""
    used = np.concatenate(([0], np.cumsum(w.end - w.start)))
    size = used[w.first[1:]] - used[w.first[:-1]] + np.maximum(w.counts - 1, 0)
    values, lines = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    known: dict[bytes, np.ndarray] = {}
    for k in np.flatnonzero((w.counts > 0) & (size <= 4 * TINY)):
        raw = b" ".join(w.text(j) for j in range(w.first[k], w.first[k + 1]))
        found = known.get(raw)
        if found is None:
            text = raw.decode()
            found = known[raw] = np.array(rests(text) if len(text) <= TINY else [], dtype=U)
        if len(found):
            values.append(found)
            lines.append(np.full(len(found), k))
    return np.concatenate(values), np.concatenate(lines)


def block_values(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """What the documents of ``w`` (lines) meet by: their SimHash blocks, and the rests of the shortest: (values, lines)."""
    values, lines = _simhash_blocks(w)
    tiny, whose = _tiny_values(w)
    return np.concatenate([values, tiny]), np.concatenate([lines, whose])


def _simhash_blocks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash blocks of the documents of ``w`` (lines): (values, lines)."""
    h, first = _features(w)
    n = np.diff(first)
    counts = np.where(n >= FEW_WORDS, n, 0)
    values, lines = _blocks(h[_ranges(first[:-1], counts)], np.concatenate(([0], np.cumsum(counts))), 0, *WORD_BLOCK)
    own = np.flatnonzero((n <= SOME_WORDS) & (w.counts > 0))
    if not len(own):
        return values, lines
    more, whose = _blocks(*_runs(w, own), 1, *RUN_BLOCK)
    return np.concatenate([values, more]), np.concatenate([lines, own[whose]])


def simhash(w: Words) -> tuple[pa.Array, pa.Array]:
    """For each line, whether it is short (its features are runs of bytes), and the SimHash of all its features in one block."""
    h, first = _features(w)
    n = np.diff(first)
    short = n < FEW_WORDS
    out = np.zeros(len(n), dtype=U)
    parts = [(np.flatnonzero(~short), h[_ranges(first[:-1][~short], n[~short])], n[~short])]
    own = np.flatnonzero(short & (w.counts > 0))
    if len(own):
        runs, at = _runs(w, own)
        parts.append((own, runs, np.diff(at)))
    for lines, features, counts in parts:
        if len(features):
            slot, _, bits = _majority(mix(features), np.repeat(np.arange(len(lines)), counts))
            out[lines[slot]] = bits
    return pa.array(short), pa.array(signed(out))


#: What a task sends, packed. SEEN: lines, their documents and places. MET: lines and block values that meet inside the task, and copies.
#: ONE: one line for each block value, and its copies; negative where its lines have been sent already.
SEEN, MET, ONE = 0, 1, 2
PACKED = "share int, kind int, lines binary, keys binary, numbers binary"
ROWS = "line_id long, doc_id long, place int, key long, copies int"


class _Sender:
    """Entries of one task, dealt to shares."""

    def __init__(self, shares: int):
        self.shares, self.turn = shares, TaskContext.get().partitionId() % shares
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def row(self, kind: int, lines: np.ndarray, keys: np.ndarray, numbers: np.ndarray, share: int | None = None) -> pa.RecordBatch:
        if share is None:
            share = self.turn = (self.turn + 1) % self.shares
        return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([kind], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (lines, keys, numbers)]], names=["share", "kind", "lines", "keys", "numbers"])

    def add(self, keys: np.ndarray, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, lines))
        self.size += len(keys)
        if self.size >= MOST_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, lines = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.argsort(keys)
        keys, lines = keys[order], lines[order]
        again = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
        some = np.flatnonzero(again[:-1] | again[1:])
        lines[some] = lines[some][np.lexsort((lines[some], keys[some]))]
        at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1]))))
        copies = np.diff(np.append(at, len(keys))).astype(np.int32)
        keys, lines = keys[at], lines[at]
        again = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
        here = again[:-1] | again[1:]
        for i in range(0, int(here.sum()), 1 << 16):
            x = np.flatnonzero(here)[i : i + (1 << 16)]
            yield self.row(MET, lines[x], keys[x], copies[x])
        one = np.flatnonzero(~again[:-1])
        number = np.where(here, -copies, copies)[one]
        share = (keys[one] % U(self.shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        edges = np.searchsorted(share[order], np.arange(self.shares + 1))
        for s in np.flatnonzero(np.diff(edges)):
            x = order[edges[s] : edges[s + 1]]
            yield self.row(ONE, lines[one[x]], keys[one[x]], number[x], int(s))


def _send(shares: int):
    """One pass over the texts: occurrences of lines, and their block values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(shares)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, at in chunks(batch.column(1)):
                w, owner, place = _lines(data, at)
                line = sequence_ids(w.hashes(), w.first)
                full = w.counts > 0
                if full.any():
                    yield sender.row(SEEN, line[full], ids[i + owner[full]].astype(np.int64), place[full].astype(np.int32))
                    keys, whose = block_values(w)
                    yield from sender.add(keys, line[whose])
        yield from sender.flush()

    return run


def _rows(lines: np.ndarray, keys: np.ndarray, numbers: np.ndarray, seen: bool) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(lines), 1 << 16):
        x, y, z = (pa.array(v[i : i + (1 << 16)]) for v in (lines, keys, numbers))
        none, small = pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int32())
        yield pa.RecordBatch.from_arrays([x, y, z, none, small] if seen else [x, none, small, y, z], names=["line_id", "doc_id", "place", "key", "copies"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpacked: occurrences of lines, and the lines of each block value that two lines or more have."""
    held = []
    for batch in batches:
        for kind, *packed in zip(batch.column("kind").to_pylist(), *(batch.column(c) for c in ("lines", "keys", "numbers"))):
            lines, keys, numbers = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(packed, (np.int64, np.int64, np.int32)))
            if kind == ONE:
                held.append((lines.copy(), keys.copy(), numbers.copy()))
            else:
                yield from _rows(lines, keys, numbers, kind == SEEN)
    if held:
        lines, keys, numbers = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((lines, keys))
        lines, keys, numbers = lines[order], keys[order], numbers[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        shared = np.repeat(lines[first] != lines[first + size - 1], size) & (numbers > 0)
        yield from _rows(lines[shared], keys[shared], numbers[shared], False)


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = sketch.Partial(2, BLOOM_BITS)
    for batch in batches:
        docs, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        part.add(_spot(docs, places))
    yield from part.batches()


def _spot(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix(mix(docs.astype(np.int64).view(U)) ^ places.astype(np.uint64))


def _wanted_lines(shared):
    """The normalised lines at the places that the filter holds; only those are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = [np.frombuffer(x, dtype=np.uint8) for x in shared.value]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, data, at in chunks(batch.column(1)):
                edges, owner, place = _edges(data, at)
                hit = np.flatnonzero(sketch.has_bits(bloom, _spot(ids[i + owner], place), BLOOM_BITS) & (edges[:-1] < edges[1:]))
                if not len(hit):
                    continue
                size = edges[hit + 1] - edges[hit]
                w = Words(data[_ranges(edges[hit], size)], np.concatenate(([0], np.cumsum(size))), lower=True)
                line = sequence_ids(w.hashes(), w.first)
                texts = [b" ".join(x.split()) for x in np.split(w.data, np.cumsum(size)[:-1]) for x in [x.tobytes()]]
                full = pa.array(w.counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array(signed(line)), pa.array(texts, pa.binary()).cast(pa.string()), _bags(texts), *simhash(w)], names=["line_id", "line", "bag", "short", "simhash"]).filter(full)

    return run


def _bags(texts: list[bytes]) -> pa.Array:
    """For each text how many of its code points are in each of LETTERS classes."""
    points = [np.frombuffer(x.decode().encode("utf-32-le"), dtype=np.uint32) % LETTERS for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in points])
    bags = np.bincount(owner * LETTERS + np.concatenate(points), minlength=LETTERS * len(texts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * LETTERS), pa.array(bags))


def distance_within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether the edit distance of two strings, or lists of words, is at most ``most``: Myers' bit vectors, after common ends are cut off."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    if isinstance(a, str):
        x, y = (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (a, b))
        other = np.flatnonzero(x[:n] != y[:n])
        head = int(other[0]) if len(other) else n
        n -= head
        other = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
        tail = n - 1 - int(other[-1]) if len(other) else n
    else:
        head = next((k for k in range(n) if a[k] != b[k]), n)
        n -= head
        tail = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= most:
        return True
    if not a:
        return False
    places: dict = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for c in b:
        same = places.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(h | up)), up & h
        left -= 1
        if plus & top:
            score += 1
            if score - left > most:
                return False
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(v | plus)), plus & v
    return score <= most


def _pairs(x: str) -> np.ndarray:
    """How often each class of two neighbouring characters occurs."""
    c = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
    return np.bincount((c[:-1] * np.uint32(61) + c[1:]) & np.uint32(PAIR_CLASSES - 1), minlength=PAIR_CLASSES)


def too_far(x: str, y: str, most: int) -> bool:
    """Whether the counts of neighbouring characters alone say that more than ``most`` edits are needed: an edit changes two of them at most."""
    longer = max(len(x), len(y)) - 1
    return longer > 2 * most and int(np.minimum(_pairs(x), _pairs(y)).sum()) < longer - 2 * most


def similar(x: str, y: str, similarity: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``similarity``."""
    most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
    if too_far(x, y, most):
        return False
    a, b = x.split(" "), y.split(" ")
    # Each word that changes, comes or goes takes no more edits than the longest word and its space have characters.
    longest = 1 + max(max(map(len, a)), max(map(len, b)))
    return distance_within(a, b, most // longest) or distance_within(x, y, most)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)


def _filled(points: np.ndarray, used: np.ndarray, fill: int) -> np.ndarray:
    """A matrix with the points, in order, at the places of ``used``."""
    out = np.full(used.shape, fill, dtype=np.int64)
    out[used] = points
    return out


def distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Edit distances of pairs of texts."""
    return _distances(_points(xs), np.array([len(x) for x in xs]), _points(ys), np.array([len(x) for x in ys]))


def _word_codes(xs: list[str], ys: list[str]) -> tuple[np.ndarray, ...]:
    """The words of pairs of texts as small numbers, each pair's its own; how many each has; the size of its longest word with a space."""
    a, b, m, n, sizes = [], [], [], [], []
    for x, y in zip(xs, ys):
        code: dict[str, int] = {}
        x, y = x.split(" "), y.split(" ")
        a += [code.setdefault(w, len(code)) for w in x]
        b += [code.setdefault(w, len(code)) for w in y]
        m.append(len(x))
        n.append(len(y))
        sizes.append(1 + max(map(len, code)))
    return np.array(a), np.array(m), np.array(b), np.array(n), np.array(sizes)


def _distances(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of sequences, m and n long, of the small numbers that ``a`` and ``b`` have in order: Myers' bit vectors in words of 64 bits, of all pairs at once.

    The k-th word of a pair is a column behind the word before, whose carry it takes. Sequences are filled up in front,
    with columns that change nothing, so that all end together.
    """
    pairs, words, columns = len(m), max(1, -(-int(m.max()) // 64)), int(n.max())
    known = np.unique(a)
    code = np.full(int(max(a.max(initial=0), b.max(initial=0))) + 1, len(known), dtype=np.int64)
    code[known] = np.arange(len(known))
    some = np.arange(64 * words) < m[:, None]
    pattern = _filled(code[a], some, len(known)).reshape(pairs, words, 64).transpose(1, 0, 2)
    base = np.arange(words * pairs).reshape(words, pairs) * (len(known) + 1)
    masks = np.zeros(words * pairs * (len(known) + 1), dtype=U)
    for k in range(64):
        masks[base + pattern[:, :, k]] |= U(1 << k)
    masks[base + len(known)] = 0
    real = np.arange(columns) >= columns - n[:, None]
    text = np.ascontiguousarray(_filled(code[b], real, len(known)).T[::-1])
    first = np.ascontiguousarray(real.T).astype(U)
    up, down = np.full((words, pairs), U(0xFFFFFFFFFFFFFFFF)), np.zeros((words, pairs), dtype=U)
    more, less = np.zeros((words + 1, pairs), dtype=U), np.zeros((words + 1, pairs), dtype=U)
    one, top = U(1), U(63)
    for t in range(columns + words - 1):
        low, high = max(0, t - columns + 1), min(words, t + 1)
        if t < columns:
            more[0] = first[t]
        p, q, u, d = more[low:high], less[low:high], up[low:high], down[low:high]
        same = masks.take(base[low:high] + text[columns - 1 - t + low : columns - 1 - t + high])
        v = same | d
        same |= q
        h = same & u
        h += u
        h ^= u
        h |= same
        plus = ~(h | u)
        plus |= d
        h &= u
        carry_plus, carry_minus = plus >> top, h >> top
        plus <<= one
        plus |= p
        h <<= one
        h |= q
        np.bitwise_and(plus, v, out=d)
        plus |= v
        np.invert(plus, out=plus)
        np.bitwise_or(plus, h, out=u)
        more[low + 1 : high + 1], less[low + 1 : high + 1] = carry_plus, carry_minus
    rows = np.packbits(some.reshape(pairs, words, 64), axis=2, bitorder="little").view(U)[:, :, 0].T
    return n + np.bitwise_count(up & rows).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & rows).sum(axis=0, dtype=np.int64)


def similar_pairs(xs: list[str], ys: list[str], similarity: float) -> np.ndarray:
    """``similar`` of many pairs: those of like lengths together."""
    short, long = np.minimum(*(s := [np.array([len(x) for x in v], dtype=np.int64) for v in (xs, ys)])), np.maximum(*s)
    most = ((1 - similarity) * long + 1e-9).astype(np.int64)
    hit = np.zeros(len(xs), dtype=bool)
    left = np.flatnonzero(long - short <= most)
    left = left[np.argsort(-short[left], kind="stable")]
    at = 0
    while at < len(left):
        words = max(1, -(-int(short[left[at]]) // 64))
        end = min(len(left), at + max(1, MOST_WORDS // words))
        end = at + int(np.searchsorted(-short[left[at:end]], -0.7 * short[left[at]], side="right"))
        own = left[at:end].tolist()
        a, b = [], []
        for k in own:
            x, y = xs[k], ys[k]
            a.append(x if len(x) <= len(y) else y)
            b.append(y if len(x) <= len(y) else x)
        letters = len(set().union(*a))
        size = max(1, MOST_MASKS // (words * (letters + 1)))
        for i in range(0, len(own), size):
            k, x, y = np.array(own[i : i + size]), a[i : i + size], b[i : i + size]
            if len(k) * words < LEAST_WORDS:
                hit[k] = [similar(u, v, similarity) for u, v in zip(x, y)]
                continue
            # Each word that changes, comes or goes takes no more edits than the longest word and its space have characters.
            *codes, longest = _word_codes(x, y)
            hit[k] = _distances(*codes) * longest <= most[k]
            open_ = np.flatnonzero(~hit[k])
            if len(open_):
                hit[k[open_]] = distances([x[j] for j in open_], [y[j] for j in open_]) <= most[k[open_]]
        at = end
    return hit


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _compare(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """pairs: (a, b) of line ids. Those whose lines are similar enough, written."""
    both = pairs.join(lines.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b")
    # Dealt out by the pair, so that the comparisons of one line do not meet in one task.
    return written(both.select("a", "b", "x", "y").repartition(n_parts(pairs.sparkSession), "a", "b").mapInArrow(_similar(similarity), "a long, b long"), "links")


def _rebuild(names: list[str]):
    """The last two columns are the text and the places to drop; those before pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, kept, digests = [], [], [], []
            for text, drop in zip(*(c.to_pylist() for c in batch.columns[-2:])):
                lines = (text or "").split("\n")
                gone = {k for k in drop or () if k < len(lines)}
                out = "\n".join(x for k, x in enumerate(lines) if k not in gone)
                n_lines.append(len(lines))
                n_removed.append(len(gone))
                kept.append(out)
                digests.append(hashlib.sha256(out.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=[*names, "n_lines", "n_removed", "kept", "kept_sha256"],
            )

    return run


def line_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Occurrences (line_id, doc_id, place) of lines with words, and groups (id, component) of lines that links join, both written."""
    spark = docs.sparkSession
    shares = SHARES * n_parts(spark)
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("isnotnull(doc_id)").mapInArrow(_send(shares), PACKED)
    rows = written(sent.repartition(n_parts(spark), "share").mapInArrow(_meet, ROWS), "lines")
    seen = rows.where("isnotnull(doc_id)").select("line_id", "doc_id", "place")
    met = rows.where("isnotnull(key)").select("key", "line_id", "copies")

    wanted = seen.join(met.select("line_id").distinct(), "line_id").groupBy("line_id").agg(F.min(F.struct("doc_id", "place")).alias("spot")).select("spot.doc_id", "spot.place")
    bloom = sketch.merged(wanted.mapInArrow(_bloom, sketch.SCHEMA), 2, BLOOM_BITS, sketch.any_bits)
    shared = spark.sparkContext.broadcast([x.tobytes() for x in bloom])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("isnotnull(doc_id)").mapInArrow(_wanted_lines(shared), "line_id long, line string, bag array<int>, short boolean, simhash long")
    lines = written(texts.groupBy("line_id").agg(*[F.first(c).alias(c) for c in ("line", "bag", "short", "simhash")]), "texts")
    released(shared)

    links = tested = groups = None
    marks = lines.select("line_id", F.length("line").alias("size"), "bag", "short", "simhash")
    entries = met.groupBy("key", "line_id").agg(F.sum("copies").alias("copies"))
    sized = written(entries.join(marks.select("line_id", "size"), "line_id"), "met")
    most = f"{1 - similarity:.9f} * greatest(size, other_size) + 1e-6"
    placed = sized.withColumn("component", F.col("line_id")).withColumn("weight", F.col("copies"))
    for k, centres in enumerate(CENTRES):
        # For each block value the most frequent line, then lines of the largest group, some of a value's shares of its lines each.
        draw = F.xxhash64("line_id", "key", F.lit(k))
        share = F.pmod(draw, F.lit(centres))
        centre = placed.groupBy("key", share.alias("share")).agg(F.max(F.struct("weight", "copies", F.xxhash64("line_id", F.lit(k)) if not k else draw, "line_id", "component", "size")).alias("c")).select("key", F.col("c.line_id").alias("to"), F.col("c.component").alias("other"), F.col("c.size").alias("other_size"))
        star = placed.join(centre, "key").where(f"component <> other and abs(size - other_size) <= {most}").select(F.col("line_id").alias("from"), F.least("line_id", "to").alias("a"), F.greatest("line_id", "to").alias("b"))
        if k:
            best = star.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        else:
            best = star.groupBy("from", "a", "b").agg(F.count("*").alias("shared")).groupBy("from").agg(F.max(F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        best = written(best, "pairs")
        found = _compare(best, lines, similarity)
        links, tested = (found, best) if links is None else (links.unionByName(found), tested.unionByName(best))
        dropped(groups)
        groups = written(components(links), "groups")
        members = groups.groupBy("component").agg(F.count("*").alias("weight"))
        placed = sized.join(groups.join(members, "component").withColumnRenamed("id", "line_id"), "line_id", "left").withColumn("component", F.coalesce("component", "line_id")).withColumn("weight", F.coalesce("weight", F.lit(1)))
        counts = placed.groupBy("key", "component").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("joined"), F.count("*").alias("groups")).where("groups > 1")
        counts = written(counts, "counts")
        size, pairs = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") ** 2 - F.col("joined")) / 2), F.lit(0.0))).first()
        last, placed = sized, written(placed.join(counts.select("key"), "key"), "open")
        dropped(last, counts)
        sized = placed.select("key", "line_id", "copies", "size")
        sized.__dict__["_folder"] = placed.__dict__.pop("_folder")
        if pairs <= OPEN * size:
            break
    # Each pair of lines once: at the least of the block values that they share. A line has a bounded number of those.
    # Lines of one kind whose whole SimHashes lie far apart are not candidates, and a line of which another
    # lacks more letters than edits are allowed cannot link to it.
    left = placed.select("key", "line_id", "component").join(marks, "line_id")
    left = written(left.join(left.groupBy("line_id").agg(F.collect_list("key").alias("keys")), "line_id"), "open")
    other = left.select("key", F.col("line_id").alias("to"), *[F.col(c).alias(f"other_{c}") for c in ("component", "size", "bag", "short", "simhash", "keys")])
    near = f"(least(size, other_size) <= {TINY} or short <> other_short or bit_count(simhash ^ other_simhash) <= {DISTANCE})"
    missing = "aggregate(zip_with(bag, other_bag, (x, y) -> greatest(x - y, 0)), 0, (s, x) -> s + x)"
    fits = f"abs(size - other_size) <= {most} and {near} and {missing} + greatest(other_size - size, 0) <= {most}"
    crossed = left.join(other, "key").where(f"component < other_component and {fits} and key = array_min(array_intersect(keys, other_keys))").select(F.least("line_id", "to").alias("a"), F.greatest("line_id", "to").alias("b"))
    crossed = written(crossed.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = _compare(crossed, lines, similarity)
    if not found.isEmpty():
        groups = written(components(links.unionByName(found)), "groups")
    dropped(left, crossed, lines)
    return seen, groups


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, place): each line that is not the first of its group; places count lines of a document from 0."""
    seen, groups = line_links(docs, similarity)
    # Only lines that occur again, or are linked, can go.
    again = seen.groupBy("line_id").agg(F.count("*").alias("n")).join(groups.withColumnRenamed("id", "line_id"), "line_id", "left").where("n > 1 or isnotnull(component)").select("line_id", F.coalesce("component", "line_id").alias("group"))
    rows = seen.join(again, "line_id")
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "place")).alias("first")).select("group", F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"))
    return rows.join(first, "group").where("doc_id <> first_id or place <> first_place").select("doc_id", "place")


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the columns named in ``carry``, n_lines, n_removed, kept (text), kept_sha256.

    Lines are cut at \\n. Lines without words stay. Null and empty texts have one empty line. Rows with
    equal doc_id count as one document, so the lines at a place that goes go from each; a null doc_id
    is never cut and never first. An empty table gives an empty table. A carried column named as a
    result column is left out; other columns are ignored.
    """
    carry = tuple(c for c in carry if c.lower() not in RESULT)
    drop = repeated_lines(docs, similarity).groupBy("doc_id").agg(F.collect_set("place").alias("__drop"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    types = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in carry)
    return rows.join(drop, "doc_id", "left").mapInArrow(_rebuild(["doc_id", *carry]), f"doc_id long, {types}n_lines long, n_removed long, kept string, kept_sha256 string")
