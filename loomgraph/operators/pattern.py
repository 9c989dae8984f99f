"""Graph patterns as joins over a binding table.

    Pattern(graph).node("a", "Method").hop("CALLS").node("b", "Function").where("b.complexity > 10")
        .select("a.name", "count(b.id) as n")

Each variable is a struct column of the binding table. ``hop`` may have bounds (a walk of several
edges, no edge twice) and may be optional (an outer join). ``select`` groups by its plain items if
any item is an aggregate. Expressions are Spark SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph

AGGREGATE = re.compile(r"^\s*(count|sum|avg|min|max|collect_list|collect_set)\s*\(", re.IGNORECASE)


class Pattern:
    def __init__(self, graph: PropertyGraph, rows: DataFrame | None = None, last: str | None = None):
        self.graph, self.rows, self.last = graph, rows, last
        self._hop: tuple | None = None

    def _copy(self, rows: DataFrame, last: str) -> Pattern:
        return Pattern(self.graph, rows, last)

    def _nodes(self, name: str, label: str | None, /, **equal) -> DataFrame:
        nodes = self.graph.scan([label] if label else None)
        for k, v in equal.items():
            nodes = nodes.where(F.col(k) == v)
        return nodes.select(F.struct(*nodes.columns).alias(name))

    def node(self, name: str, label: str | None = None, /, **equal) -> Pattern:
        """A node by label and properties; after ``hop`` the node that the edge leads to."""
        nodes = self._nodes(name, label, **equal)
        if self.rows is None:
            return self._copy(nodes, name)
        if self._hop is None:
            raise ValueError("two nodes need a hop between them")
        types, direction, low, high, optional = self._hop
        edges = self.graph.hops(types, direction).select("src", "dst", "type", "weight").withColumn("__e", F.struct("src", "dst", "type"))
        steps = edges.select("src", "dst", F.array("__e").alias("__walk"), F.struct("type", "weight").alias("__last"))
        walks = steps if low <= 1 else None
        for n in range(2, high + 1):
            nxt = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"), "__e", "type", "weight")
            steps = steps.join(nxt, "dst").where(~F.array_contains("__walk", F.col("__e"))).select("src", F.col("to").alias("dst"), F.concat("__walk", F.array("__e")).alias("__walk"), F.struct("type", "weight").alias("__last"))
            if n >= low:
                walks = steps if walks is None else walks.unionByName(steps)
        ends = walks.join(nodes.withColumn("dst", F.col(name)["id"]), "dst").select("src", name, F.struct(F.col("__last.type").alias("type"), F.col("__last.weight").alias("weight"), F.size("__walk").alias("hops")).alias(f"{self.last}_{name}"))
        rows = self.rows.withColumn("src", F.col(self.last)["id"]).join(ends, "src", "left" if optional else "inner").drop("src")
        return self._copy(rows, name)

    def hop(self, types: str | list[str] | None = None, direction: str = "out", low: int = 1, high: int = 1, optional: bool = False) -> Pattern:
        out = self._copy(self.rows, self.last)
        out._hop = ([types] if isinstance(types, str) else types, direction, low, high, optional)
        return out

    def where(self, condition: str) -> Pattern:
        """Rows for which the condition is true; null is not."""
        return self._copy(self.rows.where(condition), self.last)

    def select(self, *items: str, distinct: bool = False) -> DataFrame:
        plain = [i for i in items if not AGGREGATE.match(i)]
        if len(plain) == len(items):
            out = self.rows.selectExpr(*items)
            return out.distinct() if distinct else out
        return self.rows.groupBy(*[F.expr(i) for i in plain]).agg(*[F.expr(i) for i in items if AGGREGATE.match(i)])
