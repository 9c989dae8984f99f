"""Connected components of a link table, by alternating star rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each id in a link, the smallest id that links reach. Ids are longs.

    Each round first ties every larger neighbour of a node to its smallest neighbour, then every
    smaller neighbour to the smallest. It ends when nothing changes: each id is then tied to the
    smallest id alone. A node with many links is only joined and aggregated, never gathered.
    Links with a null end are left out; no links give an empty table.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v and isnotnull(u) and isnotnull(v)").distinct()
    edges = written(edges, "links")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        last, edges = edges, written(small, "links")
        now = _state(edges)
        dropped(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    tied = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return tied.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
