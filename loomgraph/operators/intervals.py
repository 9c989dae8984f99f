"""Joins of ranges (key, start, end; both ends inside) with points and with ranges.

A range is laid out as blocks: bins of 32 at its ends and, where it covers whole bins of 1,024 or 32,768, those. So a
range of 100,000 lines is some 130 rows, and every place inside it lies in just one of its blocks. A point asks for one bin of each
size. Rows meet by (key, size, bin): a key with most of the rows is many bins, and the bins of the larger sizes, in which
many points meet few ranges, are dealt out further by a salt. Both sides are shuffled: Spark takes the size of exploded rows for that of their
file, and would send many times as much through the driver. Where only the least value of a place or a range is asked for,
blocks begin at single lines and keep their least, so that ranges are never paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5
LEVELS = 3
SALTS = 8


def valid(ranges: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose key and ends are not null and whose end is not before their start."""
    return ranges.where(" and ".join(f"`{c}` is not null" for c in [*key, start, end])).where(F.col(start) <= F.col(end))


def _run(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def blocks(start: Column, end: Column, exact: bool = False) -> Column:
    """Array of (level, bin): disjoint bins that cover the range, the larger ones wherever they lie wholly inside its bins of 32.

    exact: level 0 are single places, so the bins hold the range and nothing else.
    """
    low, high = (c.cast("long") if exact else F.shiftright(c.cast("long"), BITS) for c in (start, end))
    levels = LEVELS + exact
    tag = lambda level, bins: F.transform(bins, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
    parts, mask = [], (1 << BITS) - 1
    for level in range(levels - 1):
        up, down = F.shiftright(low + mask, BITS), F.shiftright(high + 1, BITS) - 1
        inside = (low <= high) & (up <= down)
        parts.append(tag(level, F.when(inside, F.concat(_run(low, F.shiftleft(up, BITS) - 1), _run(F.shiftleft(down + 1, BITS), high))).otherwise(_run(low, high))))
        low, high = F.when(inside, up).otherwise(F.lit(1)), F.when(inside, down).otherwise(F.lit(0))
    return F.concat(*parts, tag(levels - 1, _run(low, high)))


def _bins(at: Column, exact: bool = False) -> Column:
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(at.cast("long"), BITS * (level + (not exact))).alias("bin")) for level in range(LEVELS + exact)])


def stab(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each point with each range of its key that holds it, once: the columns of both (other than the key they have no name in common).

    Points with a null key or place and ranges that are null or reversed meet nothing.
    """
    salt = lambda c: F.when(F.col("__b.level") == 0, F.lit(0)).otherwise(c).cast("int")
    p = points.where(" and ".join(f"`{c}` is not null" for c in [*key, at])).withColumn("__b", F.explode(_bins(F.col(at))))
    p = p.withColumn("__s", salt(F.pmod(F.xxhash64(F.struct(*points.columns)), F.lit(SALTS))))
    r = valid(ranges, key, start, end).withColumn("__b", F.explode(blocks(F.col(start), F.col(end))))
    r = r.withColumn("__s", F.explode(F.when(F.col("__b.level") == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(SALTS)]))))
    return p.join(r.hint("merge"), [*key, "__b", "__s"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b", "__s")


def overlaps(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Each pair of ranges (key, start, end) of one key that share a place, once; the columns of right are named ``r_...``.

    Of two such ranges one begins inside the other: those of right that begin inside one of left, and those of left
    that begin inside one of right and after its start.
    """
    left = valid(left, key)
    right = valid(right, key).select(*key, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in key])
    later = stab(right, left, key, "r_start")
    earlier = stab(left, right, key, "start", "r_start", "r_end").where("start > r_start")
    return later.unionByName(earlier)


def _met(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of left with the ``__v`` of the row of right of their key and block; right has one row for each."""
    salt = F.when(F.col("__b.level") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("__id"), F.lit(SALTS))).cast("int")
    salts = F.when(F.col("__b.level") == 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(SALTS)]))
    return left.withColumn("__s", salt).join(right.withColumn("__s", F.explode(salts)).hint("merge"), [*key, "__b", "__s"])


def least_holding(points: DataFrame, ranges: DataFrame, key: list[str], id: str, at: str, value: Column) -> DataFrame:
    """(id, least): the least ``value`` of the ranges (key, start, end) of its key that hold a point; points in none have no row."""
    kept = valid(ranges, key).withColumn("__v", value).select(*key, F.explode(blocks(F.col("start"), F.col("end"), True)).alias("__b"), "__v").groupBy(*key, "__b").agg(F.min("__v").alias("__v"))
    asked = points.select(*key, F.col(id).alias("__id"), F.explode(_bins(F.col(at), True)).alias("__b"))
    return _met(asked, kept, key).groupBy(F.col("__id").alias(id)).agg(F.min("__v").alias("least"))


def least_held(ranges: DataFrame, points: DataFrame, key: list[str], id: str, at: str, value: Column) -> DataFrame:
    """(id, least): the least ``value`` of the points of its key that a range (key, start, end) holds; ranges without any have no row."""
    kept = points.withColumn("__v", value).select(*key, F.explode(_bins(F.col(at), True)).alias("__b"), "__v").groupBy(*key, "__b").agg(F.min("__v").alias("__v"))
    asked = valid(ranges, key).select(*key, F.col(id).alias("__id"), F.explode(blocks(F.col("start"), F.col("end"), True)).alias("__b"))
    return _met(asked, kept, key).groupBy(F.col("__id").alias(id)).agg(F.min("__v").alias("least"))
