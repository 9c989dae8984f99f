"""Collocations: phrases of two and three words that stand together more often than their parts explain.

Words that occur often enough get an entry in a dictionary table (code, lang, word, count). A code is a hash of
the language and the word that is proven to be free of collisions over all words of the corpus (else other
hashes are drawn), so that a task can encode a text without holding the dictionary: it asks a filter of bounded
size and breaks pieces at words that have no entry. What passes the filter by chance is counted too and falls
to its count. Pairs, and then triples both of whose pairs are frequent, are packed into binary keys of 16 and 24
bytes, radix-sorted and run-length counted in bounded runs in each task, dealt to the ranges between
sampled splitters, and sorted and counted there again. A key reaches its range once for each run, however common
it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, n_parts, released, written
from .sketch import SCHEMA as SKETCH
from .sketch import Partial, any_bits, has_bits, merged, width_for
from .words import CHUNK_BYTES, U, Words, chunks, mix

#: What ends a piece, and what parts the words of a piece, are `[.,;:!?\x0A-\x0D]` and `[\x20\x09]`.
BREAK, ENDS = 10, ".,;:!?"
LIKE_BREAK = np.arange(256, dtype=np.uint8)
LIKE_BREAK[list(ENDS.encode())] = BREAK
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[10:14] = True
NO_LANG = "und"

#: Keys that a task sorts at once (a run), and that a range holds unsorted at most.
RUN = 1 << 21
#: Sampled keys for each range.
SAMPLED = 64
#: Filters: rows, and bits of the width of a row at most.
DEPTH, LEAST_BITS, MOST_BITS = 3, 12, 27
#: Groups that meet in one of the next level when the first rows of each language are taken.
FAN_IN = 8


# ---- words of texts


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``size``, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def lang_seed(lang: str, draw: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=draw.to_bytes(4, "little")).digest(), "little")


def word_hashes(w: Words, draw: int) -> np.ndarray:
    """Hashes of the words; each draw reads the bytes in another permutation, so words that share a hash in one do not in the next."""
    plain = w.data
    if draw:
        w.data = np.random.default_rng(draw).permutation(256).astype(np.uint8)[plain]
    h, w.data = w.hashes(), plain
    return h


class Codes:
    """Words of a group of texts with their codes; ``joined[k]``: word k + 1 follows word k in one piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, seeds: np.ndarray, draw: int):
        self.words = w = Words(LIKE_BREAK[data], at, lower=True)
        self.doc = w.doc()
        with np.errstate(over="ignore"):
            self.code = mix(word_hashes(w, draw) + seeds[self.doc])
        breaks = np.concatenate(([0], np.cumsum(IS_BREAK[w.data])))
        self.joined = (self.doc[1:] == self.doc[:-1]) & (breaks[w.start[1:]] == breaks[w.end[:-1]])


def coded(batches: Iterator[pa.RecordBatch], draw: int) -> Iterator[tuple[Codes, list[str], np.ndarray]]:
    """Codes of (lang, text) batches, the names of languages, and the language of each text."""
    for batch in batches:
        names = batch.column(0).fill_null(NO_LANG).dictionary_encode()
        known, of = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([lang_seed(x, draw) for x in known], dtype=U)
        for i, j, data, at in chunks(batch.column(1), CHUNK_BYTES):
            found = Codes(data, at, seeds[of[i:j]], draw)
            if len(found.code):
                yield found, known, of[i:j]


# ---- the dictionary


def binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ragged(start, size)].tobytes())])


class Counts:
    """Words that a task has met, by code, with a proof that equal codes were equal words of one language."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.held, self.total, self.clash = 0, {}, False

    def add(self, found: Codes, known: list[str], of: np.ndarray) -> None:
        w = found.words
        ids = np.array([self.langs.setdefault(x, len(self.langs)) for x in known])[of]
        for lang, n in zip(ids, w.counts):
            self.total[lang] = self.total.get(lang, 0) + int(n)
        code, first, back, n = np.unique(found.code, return_index=True, return_inverse=True, return_counts=True)
        size, like, lang = w.end - w.start, first[back], ids[found.doc]
        same = np.array_equal(size, size[like]) and np.array_equal(lang, lang[like]) and np.array_equal(w.data[ragged(w.start, size)], w.data[ragged(w.start[like], size)])
        self.clash |= not same
        self.parts.append((code, n, lang[first], binaries(w.data, w.start[first], size[first])))
        self.held += len(code)

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        code, n, lang = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        word = pa.concat_arrays([p[3] for p in self.parts])
        one, first, back = np.unique(code, return_index=True, return_inverse=True)
        like = first[back]
        self.clash |= not (np.array_equal(lang, lang[like]) and pc.all(pc.equal(word, word.take(pa.array(like)))).as_py() in (True, None))
        out = one, np.bincount(back, weights=n).astype(np.int64), lang[first], word.take(pa.array(first))
        self.parts, self.held = [out], len(one)
        return out


WORDS_SCHEMA = "code long, lang string, word string, f long"


def _count_words(draw: int):
    def row_batch(code, lang, word, f) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(lang, pa.string()), word, pa.array(f, pa.int64())], names=["code", "lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def emit() -> Iterator[pa.RecordBatch]:
            code, n, lang, word = counts.fold()
            names = pa.array(list(counts.langs)).take(pa.array(lang))
            for i in range(0, len(code), 1 << 16):
                k = slice(i, i + (1 << 16))
                yield row_batch(code[k].view(np.int64), names[k], word[k].cast(pa.string()), n[k])
            counts.parts, counts.held = [], 0

        folded = 0
        for found, known, of in coded(batches, draw):
            counts.add(found, known, of)
            if counts.held > 2 * folded + RUN // 4:
                counts.fold()
                folded = counts.held
                if folded > RUN:
                    yield from emit()
                    folded = 0
        if counts.parts:
            yield from emit()
        names = list(counts.langs)
        nothing = lambda n: pa.array([None] * n, pa.string())
        seeds = np.array([lang_seed(names[k], draw) for k in counts.total], dtype=U)
        yield row_batch(seeds.view(np.int64), [names[k] for k in counts.total], nothing(len(seeds)), list(counts.total.values()))
        if counts.clash:
            yield row_batch([0], [None], nothing(1), [-1])

    return run


def dictionary(rows: DataFrame, least: int, draws: int = 8) -> tuple[DataFrame, int]:
    """(code, lang, word, f, m) of words with f >= least, and a row without a word for each language: all its words.

    Codes are those of the first draw of hashes under which no two words of the corpus share one.
    """
    n = n_parts(rows.sparkSession)
    for draw in range(draws):
        parts = rows.mapInArrow(_count_words(draw), WORDS_SCHEMA).repartition(n, "code")
        each = parts.groupBy("code", "lang", "word").agg(F.sum("f").alias("f"))
        codes = each.groupBy("code").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("f").alias("f"), F.count("*").alias("m"))
        table = written(codes.where(f"f >= {least} or f < 0 or word is null or m > 1"), "dictionary")
        if table.where("f < 0 or m > 1").isEmpty():
            return table, draw
        dropped(table)
    raise RuntimeError(f"words share codes under {draws} draws of hashes")


# ---- keys of pairs and triples


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of keys whose 64-bit words are ``columns``, by counting passes over 16-bit digits, last digit first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16, 32, 48):
            digit = (column >> U(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for 16-bit numbers
    return order


def run_lengths(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(n):
        return columns, n
    order = radix_order(columns)
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at)


class Runs:
    """Keys and counts, folded whenever they have grown by a run's size."""

    def __init__(self, width: int):
        self.width, self.parts, self.held, self.folded = width, [], 0, 0

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> None:
        self.parts.append((columns, n))
        self.held += len(n)

    def full(self) -> bool:
        return self.held >= self.folded + RUN

    def fold(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.parts:
            return [np.zeros(0, U)] * self.width, np.zeros(0, np.int64)
        columns, n = run_lengths([np.concatenate([p[0][k] for p in self.parts]) for k in range(self.width)], np.concatenate([p[1] for p in self.parts]))
        self.parts, self.held, self.folded = [(columns, n)], len(n), len(n)
        return columns, n

    def clear(self) -> None:
        self.parts, self.held, self.folded = [], 0, 0


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as rows of big-endian bytes, whose byte order is the order of keys."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">u8")) if len(columns[0]) else np.zeros((0, len(columns)), ">u8")


def unpacked(keys: pa.Array, width: int) -> list[np.ndarray]:
    _, off, data = keys.buffers()
    start = int(np.frombuffer(off, np.int32)[keys.offset])
    flat = np.frombuffer(data, ">u8", count=len(keys) * width, offset=start).reshape(-1, width)
    return [flat[:, k].astype(U) for k in range(width)]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0xC2B2AE3D27D4EB4F) + (b ^ (b >> U(31))) * U(0x9E3779B97F4A7C15))


def _key_runs(batches, width: int, draw: int, filters) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Sorted runs of the keys of ``width`` words whose words (and pairs) pass the filters."""
    (words, word_bits), pairs = filters[0].value, filters[1].value if width > 2 else None
    runs = Runs(width)
    for found, _, _ in coded(batches, draw):
        code = found.code
        known = has_bits(words, code, word_bits)
        linked = found.joined & known[1:] & known[:-1]
        if pairs is not None:
            at = np.flatnonzero(linked)
            linked[at] = has_bits(pairs[0], pair_hash(code[at], code[at + 1]), pairs[1])
            linked = linked[1:] & linked[:-1]
        at = np.flatnonzero(linked)
        runs.add([code[at + k] for k in range(width)], np.ones(len(at), np.int64))
        if runs.full():
            columns, n = runs.fold()
            if len(n) > RUN // 2:
                yield columns, n
                runs.clear()
    columns, n = runs.fold()
    if len(n):
        yield columns, n


def _sample_keys(width: int, draw: int, filters, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng(TaskContext.get().partitionId())
        kept: list[np.ndarray] = []
        for columns, n in _key_runs(batches, width, draw, filters):
            kept.append(packed(columns)[rnd.choice(len(n), min(most, len(n)), replace=False)])
        if kept:
            keys = np.concatenate(kept)
            keys = keys[rnd.choice(len(keys), min(most, len(keys)), replace=False)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in keys], pa.binary())], names=["key"])

    return run


def _dealt_keys(width: int, draw: int, filters, splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splitters.value, dtype=f"V{8 * width}").view(">u8").reshape(-1, width).astype(U)
        for columns, n in _key_runs(batches, width, draw, filters):
            low, high = np.zeros(len(cuts), np.int64), np.full(len(cuts), len(n), np.int64)
            for k in range(width):  # the cut's place among keys that begin with the same words
                for i in range(len(cuts)):
                    part = columns[k][low[i] : high[i]]
                    low[i], high[i] = low[i] + np.searchsorted(part, cuts[i, k], "left"), low[i] + np.searchsorted(part, cuts[i, k], "right")
            to = np.searchsorted(low, np.arange(len(n)), side="right").astype(np.int32)
            raw = packed(columns)
            for i in range(0, len(n), 1 << 16):
                rows = raw[i : i + (1 << 16)]
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * (8 * width)
                keys = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + len(rows)]), keys, pa.array(n[i : i + len(rows)])], names=["range", "key", "n"])

    return run


def _counted(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(width)
        for batch in batches:
            if batch.num_rows:
                runs.add(unpacked(batch.column(0), width), batch.column(1).to_numpy())
            if runs.full():
                runs.fold()
        columns, n = runs.fold()
        at = np.flatnonzero(n >= least)
        for i in range(0, len(at), 1 << 16):
            k = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k].view(np.int64)) for c in columns), pa.array(n[k])], names=[*(f"w{j + 1}" for j in range(width)), "f"])

    return run


def _filter(spark, keys: DataFrame, count: int):
    """A filter of the 64-bit keys in the first columns (pairs: of their hash); its width follows their number up to a bound."""
    bits = width_for(8 * max(1, count), LEAST_BITS, MOST_BITS)
    pair = len(keys.columns) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partial(DEPTH, bits)
        for batch in batches:
            columns = [np.asarray(c).astype(np.int64).view(U) for c in batch.columns]
            part.add(pair_hash(*columns) if pair else columns[0])
        yield from part.batches()

    return spark.sparkContext.broadcast((merged(keys.mapInArrow(run, SKETCH), DEPTH, bits, any_bits), bits))


def frequent_keys(rows: DataFrame, width: int, least: int, draw: int, filters) -> DataFrame:
    """(w1, ..., f): runs of ``width`` words that occur ``least`` times or more, counted over all rows."""
    spark, ranges = rows.sparkSession, n_parts(rows.sparkSession)
    some = rows.sample(min(1.0, SAMPLED * ranges / max(1, rows.count())), seed=13)
    most = -(-SAMPLED * ranges // max(1, some.rdd.getNumPartitions()))
    sample = sorted(bytes(r["key"]) for r in some.mapInArrow(_sample_keys(width, draw, filters, most), "key binary").collect())
    cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    splitters = spark.sparkContext.broadcast(cuts)
    dealt = rows.mapInArrow(_dealt_keys(width, draw, filters, splitters), "range int, key binary, n long").repartitionById(ranges, "range")
    schema = ", ".join(f"w{j + 1} long" for j in range(width)) + ", f long"
    out = written(dealt.select("key", "n").mapInArrow(_counted(width, least), schema), f"keys_of_{width}")
    released(splitters)
    return out


# ---- scores


def _score(a: str, l: str, r: str):
    """floor(1000000 a a / (l r)), exact for counts below 10^15."""
    a, l, r = (f"cast({x} as decimal(15, 0))" for x in (a, l, r))
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * {a} * {a}) div ({l} * {r})")


def top_rows(rows: DataFrame, group: str, spread: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``; groups are dealt into parts that meet level by level."""
    parts = n_parts(rows.sparkSession)
    while parts > 1:
        near = Window.partitionBy(group, F.pmod(F.xxhash64(spread), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most).drop("rank")
        parts //= FAN_IN
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, cover_percent: int = 50, most: int = 2000) -> DataFrame:
    """Per language its first ``most`` phrases: lang, rank, phrase, a, l, r, n, score (numbers long).

    Texts (null: empty) are lower-cased (A-Z only), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. n: all words of the language (null: ``und``). A candidate is a run of two or three words within
    a piece that occurs a >= ``least`` times; its lowest-scoring cut (ties: the first) into parts of l and r occurrences gives
    floor(1000000 a a / (l r)). One that stands in a candidate of three words with ``cover_percent`` of its count or more is
    left out. Order: score, then a, downwards, then phrase by its bytes. Repeated rows and null ids count as they stand.
    No text, no rows. Other columns of ``docs`` are ignored. Memory of a task: a run of keys, or its range of distinct keys.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table, draw = dictionary(rows, least)
    entries = table.where("word is not null").select("code", "lang", "word", "f")
    filters = [_filter(spark, entries.select("code"), entries.count())]
    pairs = frequent_keys(rows, 2, least, draw, filters)
    filters.append(_filter(spark, pairs.select("w1", "w2"), pairs.count()))
    triples = frequent_keys(rows, 3, least, draw, filters)
    released(*filters)

    one = entries.select(F.col("code").alias("w1"), "lang", F.col("word").alias("s1"), F.col("f").alias("f1"))
    two = entries.select(F.col("code").alias("w2"), F.col("word").alias("s2"), F.col("f").alias("f2"))
    known = written(pairs.join(one, "w1").join(two, "w2").select("lang", "w1", "w2", "s1", "s2", "f", "f1", "f2"), "pairs")
    dropped(pairs)
    covers = triples.select("w1", "w2", "f").union(triples.select("w2", "w3", "f")).groupBy("w1", "w2").agg(F.max("f").alias("cover"))
    short = known.join(covers, ["w1", "w2"], "left").where(f"cover is null or 100 * cover < {cover_percent} * f")
    short = short.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f", "f1", "f2").alias("score"))
    left = known.select("lang", "w1", "w2", "s1", "s2", F.col("f").alias("f12"), "f1")
    right = known.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("s2").alias("s3"), F.col("f").alias("f23"), F.col("f2").alias("f3"))
    long = triples.join(left, ["w1", "w2"]).join(right, ["w2", "w3"]).withColumn("x", _score("f", "f1", "f23")).withColumn("y", _score("f", "f12", "f3"))
    cut = lambda x, y: F.expr(f"if(x <= y, {x}, {y})")
    long = long.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), F.col("f").alias("a"), cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"), cut("x", "y").alias("score"))
    best = top_rows(short.union(long), "lang", "phrase", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    totals = table.where("word is null").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
