"""Jaccard self-join of word n-gram sets: a size-aware join of light and heavy sets.

Two sets link when ``100 * |A & B| >= percent * |A | B|``. Light (small) sets list all their
fixed-size subsets: linked sets have an equal subset of the size that their overlap needs. Heavy
(large) sets list their rarest n-grams, and linked heavy sets meet in one of those inverted lists.
The size at which sets change from light to heavy is the one of least estimated cost; the sets
just above it do both, so that light and heavy sets meet too.

Equal sets are one set from the start. A pair whose parity bitmaps differ in more bits than the
sets may differ in n-grams cannot link and goes; the others are compared exactly. Inside a list each
set first meets the list's centre among sets of about its size, and each set takes its likeliest such partner of another
component, for a few rounds. Sets that the found links have joined need no further comparison, and
the remaining pairs of a list, of different components, are then compared all. So a group of near
copies costs links in proportion to its size and no link between two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import about_words, dropped, released, written
from ..operators.components import components
from .words import U, Words, chunks, grams, mix, signed

N_WORDS = 3
PERCENT = 90
#: The sketch that tells frequent n-grams from rare ones has about a counter for 16 words, up to 2**MOST_BITS (128 MB).
MOST_BITS = 27
#: Sets above this size are never light: their subsets would be too many.
MOST_LIGHT = 40
BLOOM_BITS = 26
#: Words of 64 bits that a bitmap is folded to, for the join of all remaining pairs.
FOLDED = 4
#: Subsets and list entries that a task holds before it sends them.
MOST_KEYS = 1 << 17
#: Rounds in which components meet the centres of their lists, before all remaining pairs are compared.
ROUNDS = 4
#: Classes of set sizes for each factor e.
SIZE_CLASSES = 6


def least_overlap(s: int, percent: int) -> int:
    """The fewest n-grams that a set of s shares with any set it links to."""
    return -(-s * percent // 100)


def largest_partner(s: int, percent: int) -> int:
    return s * 100 // percent


def subset_sizes(s: int, percent: int) -> range:
    """Sizes at which a set of s meets a partner: the larger set's least overlap."""
    return range(least_overlap(s, percent), min(s, least_overlap(largest_partner(s, percent), percent)) + 1)


def subset_cost(s: int, percent: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s, percent))


def prefix_len(s: np.ndarray | int, percent: int):
    return s - (-(-s * percent // 100)) + 1


def boundary(sizes: dict[int, int], list_length: float, percent: int, most: int = MOST_LIGHT) -> int:
    """The largest light size, by cost: rows of subsets against rows and comparisons of lists."""
    best, best_cost = 0, None
    scan = {s: n * prefix_len(s, percent) * (1 + list_length) for s, n in sizes.items()}
    for b in range(most + 1):
        cost = 0.0
        for s, n in sizes.items():
            if s <= largest_partner(b, percent):
                cost += n * subset_cost(s, percent) if s <= 2 * most else float("inf")
            if s > b:
                cost += scan[s]
        if best_cost is None or cost < best_cost:
            best, best_cost = b, cost
    return best


def _doc_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, and where each document's begin."""
    w = Words(data, at, lower=True)
    h = w.hashes()
    g, first = grams(h, w.first, n)
    parts = []
    for d, words in enumerate(w.counts):
        if words >= n:
            x = np.sort(g[first[d] : first[d + 1]])
            parts.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif words:
            whole, _ = grams(h[w.first[d] : w.first[d + 1]], np.array([0, words]), int(words))
            parts.append(whole)
        else:
            parts.append(g[:0])
    return (np.concatenate(parts) if parts else g[:0]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def _set_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set's contents."""
    size = np.diff(bounds)
    total = np.zeros(len(sets) + 1, dtype=U)
    np.cumsum(mix(sets ^ U(0xA24BAED4963EE407)), out=total[1:])
    other = np.zeros(len(sets) + 1, dtype=U)
    np.cumsum(mix(sets + U(0x9FB21C651E98DF25)), out=other[1:])
    return signed(mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix((other[bounds[1:]] - other[bounds[:-1]]) + size.astype(U))))


BASE = "doc_id long, set_id long, n_shingles long, bits array<long>, slice int, dense boolean, counters binary"


def _bitmaps(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each set the parity, for each of about as many bits as it has n-grams, of those that hash there."""
    size = np.diff(bounds)
    words = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64), 1 << 10)
    first = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(size)), size)
    place = (sets >> U(6)) % (words[owner].astype(U) * U(64))
    flat = np.zeros(first[-1], dtype=U)
    np.bitwise_xor.at(flat, first[owner] + (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(flat)))


def _base(n: int, width_bits: int):
    """One pass: the set id and size of each document, and the partition's n-gram sketch."""
    names = ["doc_id", "set_id", "n_shingles", "bits", "slice", "dense", "counters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sketch.Partial(1, width_bits)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, at in chunks(batch.column(1)):
                sets, bounds = _doc_sets(data, at, n)
                part.add(sets)
                rows = j - i
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, rows), pa.array(_set_ids(sets, bounds)), pa.array(np.diff(bounds)), _bitmaps(sets, bounds), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.binary())],
                    names=names,
                )
        for b in part.batches():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), b.column(0), b.column(1), b.column(2)], names=names)

    return run


def _keys(n: int, percent: int, width_bits: int, light: int, frequent: int, shared):
    """The subsets of light sets and the inverted-list entries of heavy sets."""
    near = largest_partner(light, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                sets, bounds = _doc_sets(data, at, n)
                if not len(sets):
                    continue
                ids, size = _set_ids(sets, bounds), np.diff(bounds)
                often = counts[sketch.cells(sets, 1, width_bits)[0]]
                often = np.where(often > frequent, often, 0)
                keys, owner, held = [], [], 0
                for d in np.flatnonzero(size):
                    if held >= MOST_KEYS:
                        yield _key_rows(keys, owner, ids, size)
                        keys, owner, held = [], [], 0
                    x, s = sets[bounds[d] : bounds[d + 1]], int(size[d])
                    if s <= near:
                        for c in subset_sizes(s, percent):
                            pick = np.array(list(combinations(range(s), c)), dtype=np.int64)
                            part = mix(x)[pick].sum(axis=1, dtype=U) if c else np.zeros(1, U)
                            keys.append(mix(part ^ U(c + 1)))
                            owner.append((d, len(pick)))
                            held += len(pick)
                    if s > light:
                        p = prefix_len(s, percent)
                        rare = often[bounds[d] : bounds[d + 1]]
                        if rare.any():
                            order = np.lexsort((x, rare))[:p]
                            keys.append(x[order])
                        else:
                            keys.append(x[:p])
                        owner.append((d, len(keys[-1])))
                        held += len(keys[-1])
                if keys:
                    yield _key_rows(keys, owner, ids, size)

    return run


def _key_rows(keys: list[np.ndarray], owner: list[tuple[int, int]], ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    own = np.repeat(*np.array(owner, dtype=np.int64).T)
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(ids[own]), pa.array(size[own])], names=["key", "set_id", "size"])


def _pair_key(doc_ids: np.ndarray, set_ids: np.ndarray) -> np.ndarray:
    return mix(set_ids.astype(np.int64).view(U) ^ mix(doc_ids.astype(np.int64).view(U)))


def _bloom(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sketch.Partial(2, bits)
        for batch in batches:
            docs, sets = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            part.add(mix(docs.astype(np.int64).view(U)))
            part.add(_pair_key(docs, sets))
        yield from part.batches()

    return run


def _wanted_sets(n: int, bits: int, shared):
    """The sets that may be compared: those whose first document is in the Bloom filter, and with it the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = [np.frombuffer(x, dtype=np.uint8) for x in shared.value]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = batch.filter(pa.array(sketch.has_bits(bloom, mix(ids.view(U)), bits)))
            for i, j, data, at in chunks(some.column(1)):
                sets, bounds = _doc_sets(data, at, n)
                set_ids = _set_ids(sets, bounds)
                hit = sketch.has_bits(bloom, _pair_key(some.column(0).slice(i, j - i).to_numpy(), set_ids), bits)
                items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(signed(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids), items], names=["set_id", "items"]).filter(pa.array(hit))

    return run


class _Checker:
    """Compares pairs of sets exactly."""

    def __init__(self, docs: DataFrame, reps: DataFrame, marks: DataFrame, n: int, percent: int):
        self.docs, self.reps, self.marks, self.n, self.percent = docs, reps, marks, n, percent
        self.fits = f"least(size, other_size) * 100 >= {percent} * greatest(size, other_size)"
        differ = "aggregate(zip_with(bits, other_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        #: Whether two sets' bitmaps allow a link.
        self.near = f"(size(bits) <> size(other_bits) or {differ} * {100 + percent} <= (size + other_size) * {100 - percent})"

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b, size, other_size, ...) whose bitmaps allow a link."""
        both = pairs.join(self.marks.select(F.col("set_id").alias("a"), "bits"), "a").join(self.marks.select(F.col("set_id").alias("b"), F.col("bits").alias("other_bits")), "b")
        return both.where(self.near).select(*pairs.columns)

    def links(self, pairs: DataFrame) -> DataFrame:
        """pairs: (a, b) of set ids. Those that link, written. Only the documents whose sets are compared are cut into words again."""
        pairs = written(pairs.select("a", "b"), "fitting")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(self.reps, "set_id").select("doc_id", "set_id")
        bloom = sketch.merged(ids.mapInArrow(_bloom(BLOOM_BITS), sketch.SCHEMA), 2, BLOOM_BITS, sketch.any_bits)
        shared = pairs.sparkSession.sparkContext.broadcast([x.tobytes() for x in bloom])
        sets = written(self.docs.where("isnotnull(doc_id)").mapInArrow(_wanted_sets(self.n, BLOOM_BITS, shared), "set_id long, items array<long>"), "sets")
        both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("items").alias("y")), "b")
        both = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("total"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))
        found = written(both.where(F.expr(f"100 * shared >= {self.percent} * (total - shared)")).select("a", "b").distinct(), "links")
        dropped(pairs, sets)
        released(shared)
        return found


def ngram_join(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, width_bits: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Texts are lower-cased in A-Z only and cut into words at space and \\x09-\\x0D. A document's set
    is its distinct n-word shingles; with fewer words, the whole sequence as one. Null texts and
    texts without words have the empty set, link with nothing and are their own component. Rows
    with equal doc_id are taken as one document of each of its sets. A null doc_id has a null
    component. An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width_bits = width_bits or sketch.width_for(about_words(docs) / 16, 20, MOST_BITS)
    first = written(docs.mapInArrow(_base(n, width_bits), BASE), "base")
    base = first.where("isnull(slice)").select("doc_id", "set_id", "n_shingles", "bits")
    few = {r["n_shingles"]: r["n"] for r in base.where(f"n_shingles between 1 and {2 * MOST_LIGHT}").groupBy("n_shingles").agg(F.count("*").alias("n")).collect()}
    rest = base.where(f"n_shingles > {2 * MOST_LIGHT}").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).first()
    counters = sketch.merged(first.where("isnotnull(slice)").select("slice", "dense", "counters"), 1, width_bits)[0]
    # What a counter holds by chance, and how long a list an n-gram meets on average beyond that.
    f = np.bincount(counters, minlength=256).astype(np.float64)
    value = np.arange(256.0)
    mean = f @ value / f.sum()
    frequent = int(min(sketch.LIMIT - 1, mean + 6 * math.sqrt(mean) + 6))
    met = max(0.0, (f @ value**2) / max(1.0, f @ value) - mean)
    if rest["n"]:
        size = int(rest["m"] // rest["n"])
        few[size] = few.get(size, 0) + rest["n"]
    light = boundary(few, met, percent)
    reps = base.where("n_shingles > 0 and isnotnull(doc_id)").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))

    shared = spark.sparkContext.broadcast(counters.tobytes())
    keys = docs.select("text").mapInArrow(_keys(n, percent, width_bits, light, frequent, shared), "key long, set_id long, size long")
    lists = keys.groupBy("key").agg(F.min("set_id").alias("centre"), F.max("set_id").alias("last")).where("centre < last").select("key", "centre")
    active = written(keys.join(lists.select("key"), "key").distinct(), "lists")
    released(shared)

    marks = written(base.where("n_shingles > 0").groupBy("set_id").agg(F.first("bits").alias("bits"), F.count("*").alias("copies")), "marks")
    check = _Checker(docs, reps, marks, n, percent)
    placed = active.withColumn("component", F.col("set_id")).join(marks.select("set_id", F.col("copies").alias("weight")), "set_id")
    links = tested = groups = None
    for k in range(ROUNDS):
        # For each list and class of sizes a centre: first the set with most copies, which its near copies are nearest to,
        # then a set of the largest component, another in each round. The classes shift from round to round.
        placed = placed.withColumn("class", F.floor(F.log("size") * SIZE_CLASSES + k / ROUNDS))
        centre = placed.groupBy("key", "class").agg(F.min(F.struct(-F.col("weight"), "component", F.xxhash64("set_id", F.lit(k)), "set_id", "size")).alias("c")).select("key", "class", F.col("c.component").alias("other"), F.col("c.set_id").alias("b"), F.col("c.size").alias("other_size"))
        star = placed.join(centre, ["key", "class"]).where(f"component <> other and {check.fits}").select(F.col("set_id").alias("from"), "size", "other_size", F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b"))
        star = star.groupBy("a", "b", "from").agg(F.count("*").alias("shared"), F.first("size").alias("size"), F.first("other_size").alias("other_size"))
        star = star if tested is None else star.join(tested, ["a", "b"], "left_anti")
        best = star.groupBy("from").agg(F.max(F.struct("shared", "a", "b", "size", "other_size")).alias("p")).select("p.*").drop("shared")
        best = written(best.dropDuplicates(["a", "b"]), "pairs")
        if best.isEmpty():
            break
        found = check.links(check.fitting(best))
        best = best.select("a", "b")
        links, tested = (found, best) if links is None else (links.unionByName(found), tested.unionByName(best))
        dropped(groups)
        groups = written(components(links), "groups")
        members = groups.groupBy("component").agg(F.count("*").alias("weight"))
        placed = active.join(groups.withColumnRenamed("id", "set_id"), "set_id", "left").join(members, "component", "left").withColumn("component", F.coalesce("component", "set_id")).withColumn("weight", F.coalesce("weight", F.lit(1)))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        placed = written(placed.join(mixed, "key"), "open")
    # Also without any star: sets of neighbouring classes meet only here.
    # The join itself asks bitmaps folded to a few words; the whole ones are asked for the pairs that it leaves.
    fold = f"transform(sequence(0, least(size(bits), {FOLDED}) - 1), i -> aggregate(filter(bits, (x, j) -> j % {FOLDED} = i), 0L, (s, x) -> s ^ x))"
    ours = placed.select("key", "set_id", "size", "component").join(marks.select("set_id", F.expr(fold).alias("bits")), "set_id")
    other = ours.select("key", F.col("set_id").alias("b"), F.col("size").alias("other_size"), F.col("component").alias("other"), F.col("bits").alias("other_bits"))
    ordered = F.col("a") < F.col("b")
    crossed = ours.withColumnRenamed("set_id", "a").join(other, "key").where(f"component < other and {check.fits} and {check.near}")
    crossed = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(ordered, F.col("size")).otherwise(F.col("other_size")).alias("size"), F.when(ordered, F.col("other_size")).otherwise(F.col("size")).alias("other_size")).distinct()
    crossed = check.fitting(crossed if tested is None else crossed.join(tested, ["a", "b"], "left_anti"))
    crossed = written(crossed.select("a", "b"), "pairs")
    if not crossed.isEmpty():
        found = check.links(crossed)
        every = components(found if links is None else links.unionByName(found))
    else:
        every = spark.createDataFrame([], "id long, component long") if links is None else groups

    by_doc = reps.join(every.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = by_doc.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = by_doc.join(lowest, "component").select("set_id", "component_id")
    out = base.drop("bits").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
