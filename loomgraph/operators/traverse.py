"""Traversal: frontier loops of joins, each round written so that the plan stays short.

edges are (src, dst, ...) as PropertyGraph.hops gives them. Only new nodes are joined in a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seeds (id): id, distance, parent (the smallest node of the level before that reaches it; null for seeds)."""
    seen = seeds.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent")).distinct()
    seen = written(seen, "level")
    frontier = seen
    # Written once: the edges may be the result of a long plan, which each level would run again.
    hops = written(edges.select(F.col("src").alias("id"), "dst").distinct(), "hops")
    for d in range(1, depth + 1):
        reached = frontier.select("id").join(hops, "id").groupBy(F.col("dst").alias("new")).agg(F.min("id").alias("parent"))
        fresh = reached.join(seen.select(F.col("id").alias("new")), "new", "left_anti").select(F.col("new").alias("id"), F.lit(d).alias("distance"), "parent")
        frontier = written(fresh, "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse_impact(edges: DataFrame, seeds: DataFrame, depth: int, type_order: list[str]) -> DataFrame:
    """Who depends on the seeds: id, distance, and the first type, in the given order, by which it does."""
    order = F.array_position(F.array(*[F.lit(t) for t in type_order]), F.col("type"))
    back = edges.where(F.col("type").isin(type_order)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), order.alias("rank"))
    levels = bfs(back, seeds, depth)
    step = levels.select(F.col("id").alias("src"), F.col("distance").alias("from_level")).join(back, "src").select("dst", "rank", "from_level")
    found = levels.where("distance > 0").join(step, (F.col("id") == F.col("dst")) & (F.col("from_level") == F.col("distance") - 1))
    best = found.groupBy("id", "distance").agg(F.min("rank").alias("rank"))
    return best.select("id", "distance", F.get(F.array(*[F.lit(t) for t in type_order]), (F.col("rank") - 1).cast("int")).alias("relation"))


def shortest_path(edges: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """One row (hops, path): a shortest path of ids, the parent of each being the smallest; none if there is none."""
    spark = edges.sparkSession
    levels = written(bfs(edges, spark.createDataFrame([(source,)], "id long"), depth), "levels")
    path = levels.where(F.col("id") == target).select("parent", F.col("distance").alias("hops"), F.array("id").alias("path"))
    for _ in range(depth):
        up = levels.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        path = path.join(up, "parent", "left").select(F.col("next").alias("parent"), "hops", F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))
    return path.select("hops", "path")


def simple_paths(edges: DataFrame, seeds: DataFrame, sinks: DataFrame, most_nodes: int) -> DataFrame:
    """All paths without a repeated node from a seed to its first sink: path, hops."""
    ends = sinks.select(F.col("id").alias("last"), F.lit(True).alias("sink")).distinct()
    open_ = seeds.select(F.array(F.col("id").cast("long")).alias("path"), F.col("id").cast("long").alias("last"))
    done = None
    for _ in range(most_nodes - 1):
        step = open_.join(edges.select(F.col("src").alias("last"), "dst").distinct(), "last").where(~F.expr("array_contains(path, dst)"))
        grown = written(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")).join(ends, "last", "left"), "paths")
        hit = grown.where("sink").select("path", (F.size("path") - 1).alias("hops"))
        done = hit if done is None else done.unionByName(hit)
        open_ = grown.where("sink is null").select("path", "last")
        if open_.isEmpty():
            break
    return done


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, with an edge each way."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    return e.where("src < dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def bounded_cycles(edges: DataFrame, most_nodes: int) -> DataFrame:
    """Simple cycles of up to ``most_nodes`` nodes, each once, from its smallest id: path, hops."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    open_ = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    done = None
    for _ in range(most_nodes - 1):
        step = written(open_.join(e.withColumnRenamed("src", "last"), "last").where("dst >= first").select("path", "first", "dst"), "cycles")
        hit = step.where("dst = first").select("path", F.size("path").alias("hops"))
        done = hit if done is None else done.unionByName(hit)
        open_ = step.where("dst > first and not array_contains(path, dst)").select(F.concat("path", F.array("dst")).alias("path"), "first", F.col("dst").alias("last"))
    return done


def flow_scores(levels: DataFrame, edges: DataFrame, bonus: dict[str, int]) -> DataFrame:
    """id, distance, score: 100 less 15 a level, plus the bonus of the best edge type that reaches it, between 0 and 100."""
    value = F.lit(0)
    for t, b in bonus.items():
        value = F.when(F.col("type") == t, F.lit(b)).otherwise(value)
    step = levels.select(F.col("id").alias("src"), F.col("distance").alias("d")).join(edges.select("src", "dst", value.alias("bonus")), "src")
    found = levels.where("distance > 0").join(step, (F.col("dst") == F.col("id")) & (F.col("d") == F.col("distance") - 1))
    return found.groupBy("id", "distance").agg(F.max("bonus").alias("bonus")).select("id", "distance", F.least(F.lit(100), F.greatest(F.lit(0), 100 - 15 * F.col("distance") + F.col("bonus"))).alias("score"))


def topological_levels(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """id, level of an acyclic graph, by peeling nodes that nothing left enters; nodes on cycles have no row."""
    left, e, out = nodes.select("id"), edges.select("src", "dst").distinct(), None
    for level in range(most):
        free = written(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(level).alias("level")), "free")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = written(left.join(free, "id", "left_anti"), "left")
        e = written(e.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
    else:
        raise RuntimeError(f"more than {most} levels")
    return out if out is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)
