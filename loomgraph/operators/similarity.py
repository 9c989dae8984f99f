"""Set similarity: MinHash signatures, banded candidate joins, exact overlap joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


NO_ITEM = (1 << 63) - 1
#: Items that are hashed at a time, so that what is worked on stays in a core's cache.
AT_ONCE = 1 << 15


def _signatures(hashes: Column, places: int) -> Column:
    """Of 64-bit hashes, as xxhash64(item), for each seed the least xxhash64(item, seed): the seed's four bytes are hashed on from there."""

    @F.pandas_udf("array<long>")
    def least(sets: pd.Series) -> pd.Series:
        p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        shift = [np.uint64(k) for k in range(64)]
        full = [k for k, x in enumerate(sets) if x is not None and len(x)]
        out = np.full((len(sets), places), NO_ITEM, dtype=np.int64)
        at = 0
        while at < len(full):
            stop, size = at, 0
            while stop < len(full) and (stop == at or size + len(sets.iloc[full[stop]]) <= AT_ONCE):
                size += len(sets.iloc[full[stop]])
                stop += 1
            some = [np.asarray(sets.iloc[k], dtype=np.int64) for k in full[at:stop]]
            starts = np.cumsum([0] + [len(x) for x in some[:-1]])
            base = np.concatenate(some).view(np.uint64) + p5 + np.uint64(4)
            for seed in range(places):
                x = base ^ np.multiply(np.uint64(seed), p1, dtype=np.uint64)
                x = ((x << shift[23]) | (x >> shift[41])) * p2 + p3
                x ^= x >> shift[33]
                x *= p2
                x ^= x >> shift[29]
                x *= p3
                x ^= x >> shift[32]
                out[full[at:stop], seed] = np.minimum.reduceat(x.view(np.int64), starts)
            at = stop
        return pd.Series(list(out))

    return least(hashes)


def minhash(rows: DataFrame, hashes: int = 128, id_col: str = "id", items_col: str = "items") -> DataFrame:
    """(id, signature): for each of the seeds the least hash of the items; an empty set has the largest value throughout."""
    return rows.select(F.col(id_col).alias("id"), _signatures(F.transform(items_col, lambda x: F.xxhash64(x)), hashes).alias("signature"))


def estimate(a, b):
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


#: Members of a class that are joined with as many of another at a time, so that a large class is many keys.
COPIES = 1000


def _members(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns of pairs (a, b, ...) of representatives, for all members of their classes, as a < b. classes: id, rep; a pair may be of one class with itself."""
    sizes = classes.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"))
    dealt = classes.join(sizes, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    parts = lambda c: sizes.select(F.col("rep").alias(c), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{c}_part"))
    ids = lambda c: dealt.select(F.col("rep").alias(c), F.col("part").alias(f"{c}_part"), F.col("id").alias(f"{c}_id"))
    every = pairs.join(parts("a"), "a").join(parts("b"), "b").join(ids("a"), ["a", "a_part"]).join(ids("b"), ["b", "b_part"]).where("a <> b or a_id < b_id")
    return every.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), *rest)


def band_pairs(signatures: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """(a, b), a < b: all ids that share all places of a band. Equal signatures meet others by their least id, for which then all its ids are put in."""
    one = written(signatures.groupBy("signature").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids")), "signatures")
    keyed = one.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.slice("signature", k * rows_per_band + 1, rows_per_band)))).alias("band", "key"))
    found = keyed.alias("x").join(keyed.alias("y"), ["band", "key"]).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    same = one.where("size(ids) > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    return _members(found.unionByName(same), one.select(F.explode("ids").alias("id"), F.col("id").alias("rep")))


def similar_pairs(rows: DataFrame, threshold: float, bands: int = 16, rows_per_band: int = 8, id_col: str = "id", items_col: str = "items") -> DataFrame:
    """(a, b, similarity): banded candidates, then Jaccard at or above the threshold. Empty sets are like none.

    Items are hashed to 64 bits once; sets are kept and compared by these. Equal sets (by two 64-bit hashes of the whole) are compared
    as one, for which then all its ids are put in: every pair of copies, and every pair of two sets' copies.
    """
    hashed = F.sort_array(F.array_distinct(F.transform(items_col, lambda x: F.xxhash64(x))))
    sets = rows.select(F.col(id_col).alias("id"), hashed.alias("items")).where("size(items) > 0")
    sets = written(sets.select("id", "items", F.struct(F.xxhash64("items"), F.xxhash64(F.lit(1), "items"), F.size("items")).alias("whole")), "sets")
    least = sets.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = written(sets.select("id", "whole").join(least, "whole").select("id", "rep", "n"), "classes")
    one = sets.select("id", "items").join(classes.where("id = rep").select("id"), "id", "left_semi")
    pairs = band_pairs(one.select("id", _signatures(F.col("items"), bands * rows_per_band).alias("signature")), bands, rows_per_band)
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    near = both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    copies = classes.where("id = rep and n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return _members(near.unionByName(copies), classes.select("id", "rep"))


def overlap_pairs(memberships: DataFrame, threshold: float, least_shared: int, measure: str = "jaccard", owner: str = "owner", item: str = "item") -> DataFrame:
    """(a, b, shared, similarity), a < b: exact overlap of the item sets of owners, by a join on the items."""
    m = memberships.select(F.col(owner).alias("owner"), F.col(item).alias("item")).distinct()
    sizes = m.groupBy("owner").agg(F.count("*").alias("size"))
    shared = m.alias("x").join(m.alias("y"), "item").where("x.owner < y.owner").groupBy(F.col("x.owner").alias("a"), F.col("y.owner").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    both = shared.join(sizes.select(F.col("owner").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("owner").alias("b"), F.col("size").alias("sb")), "b")
    value = {"jaccard": F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared")), "dice": 2 * F.col("shared") / (F.col("sa") + F.col("sb"))}[measure]
    return both.select("a", "b", "shared", value.alias("similarity")).where(F.col("similarity") >= threshold)
