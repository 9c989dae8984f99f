"""A typed property graph kept as a node and an edge DataFrame.

nodes: id, label, name, and any other columns. edges: src, dst, type, weight, and any other columns.
Every method is a lazy DataFrame expression, so filters and column choices reach the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.predicates import glob


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def scan(self, labels: list[str] | None = None, name: str | None = None, where: Column | None = None) -> DataFrame:
        """Nodes by label, anchored name pattern and any other condition."""
        out = self.nodes
        if labels:
            out = out.where(F.col("label").isin(labels))
        if name is not None:
            out = out.where(glob(F.col("name"), name))
        return out if where is None else out.where(where)

    def hops(self, types: list[str] | None = None, direction: str = "out") -> DataFrame:
        """Edges as (src, dst, type, weight) seen along a direction: out, in or both."""
        e = self.edges.select("src", "dst", "type", "weight")
        if types:
            e = e.where(F.col("type").isin(types))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
        return {"out": e, "in": back, "both": e.unionByName(back)}[direction]

    def expand(self, frontier: DataFrame, types: list[str] | None = None, direction: str = "out") -> DataFrame:
        """frontier (id): one row for each neighbour: id, type, neighbour."""
        return frontier.select(F.col("id").alias("src")).join(self.hops(types, direction), "src").select(F.col("src").alias("id"), "type", F.col("dst").alias("neighbour"))

    def degree(self) -> DataFrame:
        """id, degree: edges out and in; a loop counts twice. Nodes without edges have no row."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count("*").alias("degree"))

    def label_stats(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("n"))

    def type_stats(self) -> DataFrame:
        return self.edges.groupBy("type").agg(F.count("*").alias("n"))

    def stats(self) -> DataFrame:
        """One row: counts, density, and least, greatest, mean and upper-median complexity of nodes above 0."""
        some = self.nodes.where("complexity > 0").select("complexity")
        # The k-th smallest by counts of each value: no sort of all rows.
        counts = some.groupBy("complexity").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("total"), F.min("complexity").alias("low"), F.max("complexity").alias("high"), F.round(F.sum(F.col("complexity") * F.col("n")) / F.sum("n"), 6).alias("mean"))
        upto = counts.alias("a").join(counts.alias("b"), F.col("b.complexity") <= F.col("a.complexity")).groupBy(F.col("a.complexity").alias("complexity")).agg(F.sum("b.n").alias("upto"))
        median = upto.crossJoin(total).where("upto > floor(total / 2)").agg(F.min("complexity").alias("median"))
        sizes = self.nodes.agg(F.count("*").alias("nodes")).crossJoin(self.edges.agg(F.count("*").alias("edges")))
        return sizes.crossJoin(total.drop("total")).crossJoin(median).select("nodes", "edges", F.round(F.col("edges") / F.col("nodes"), 6).alias("density"), "low", "high", "mean", "median")

    def induced(self, keep: DataFrame) -> DataFrame:
        """Edges with both ends in ``keep`` (id)."""
        ids = keep.select("id").distinct()
        half = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return half.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def roots(self, types: list[str] | None = None) -> DataFrame:
        """Nodes that no edge of these types enters."""
        entered = self.hops(types).select(F.col("dst").alias("id")).distinct()
        return self.nodes.join(entered, "id", "left_anti")

    def prune_isolated(self, keep_labels: list[str]) -> DataFrame:
        """Nodes with an edge, or of a label that stays anyway."""
        touched = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        marked = self.nodes.join(touched.withColumn("touched", F.lit(True)), "id", "left")
        return marked.where(F.col("touched") | F.col("label").isin(keep_labels)).drop("touched")

    def orphan_edges(self) -> DataFrame:
        """Edges with an end that is no node."""
        ids = self.nodes.select("id")
        no_src = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst", "type")
        no_dst = self.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "type")
        return no_src.union(no_dst).distinct()

    def duplicate_names(self) -> DataFrame:
        """label, name, n, ids: names that several nodes of a label have."""
        return self.nodes.where("name <> ''").groupBy("label", "name").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")

    def integrity(self) -> DataFrame:
        """issue, n: what is wrong, in rows."""
        checks = [
            ("duplicate_name", self.duplicate_names()),
            ("missing_name", self.nodes.where("name is null or name = ''")),
            ("orphan_edge", self.orphan_edges()),
        ]
        out = None
        for name, rows in checks:
            part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
            out = part if out is None else out.unionByName(part)
        return out

    def upsert(self, rows: DataFrame) -> PropertyGraph:
        """Nodes replaced or added by (label, name); ids of replaced nodes stay."""
        fresh = rows.join(self.nodes.select("label", "name", F.col("id").alias("old")), ["label", "name"], "left").withColumn("id", F.coalesce("old", "id")).drop("old")
        kept = self.nodes.join(rows.select("label", "name").distinct(), ["label", "name"], "left_anti")
        return PropertyGraph(kept.unionByName(fresh, allowMissingColumns=True), self.edges)

    def remove(self, ids: DataFrame) -> PropertyGraph:
        """Without these nodes (id) and their edges."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), edges)
