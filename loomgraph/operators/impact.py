"""What a change reaches: sinks along data flow, tests, routes and processes, and files by their dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change_risk
from ..storage import dropped, written

#: Parts of a path's risk, and the ladder of a report.
STEP_RISK, STEPS_RISK, SINK_RISK, SOURCE_RISK = 10, 50, 30, 20
LADDER = [(90, "critical"), (70, "high"), (40, "medium")]


def _towards(hops: DataFrame, sinks: DataFrame, max_depth: int) -> DataFrame:
    """src, dst, left: the hops (src, dst) from whose end a sink (id) is less than ``max_depth`` hops away, and how many. A table that ``written`` made goes."""
    near = fresh = written(sinks.select(F.col("id").alias("dst"), F.lit(0).alias("left")), "near")
    for k in range(1, max_depth):
        back = hops.join(fresh.select("dst"), "dst").select(F.col("src").alias("dst")).distinct().join(near.select("dst"), "dst", "left_anti")
        fresh = written(back.withColumn("left", F.lit(k)), "near")
        if fresh.isEmpty():
            break
        near = near.unionByName(fresh)
    out = written(hops.join(near, "dst").select("src", "dst", "left"), "hops")
    dropped(hops)
    return out


def dataflow_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, max_depth: int = 10) -> DataFrame:
    """source, sink, path, sanitized, risk: for each source and each sink it reaches within ``max_depth`` edges, the first of its shortest paths.

    All of edges (src, dst), sources, sinks and sanitizers (id). A sink ends its path. A node keeps one path for each source: of the
    level on which it is first met the least by its ids; so what a longer or later path would pass does not count. A path with a
    sanitizer on it (a sink that is one as well counts) has half the risk.

    A level goes only to nodes from which a sink is near enough for the levels that are left, so the last goes to sinks only. That leaves out no
    path: what is too far when it is first met is too far on every later level.
    """
    hops = _towards(written(edges.select("src", "dst").where("src <> dst").distinct(), "hops"), sinks.select("id").distinct(), max_depth)
    ends = sinks.select(F.col("id").alias("node"), F.lit(True).alias("sink")).distinct()
    clean = sanitizers.select(F.col("id").alias("node"), F.lit(True).alias("clean")).distinct()
    front = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(False).alias("sanitized")).distinct()
    seen = front = written(front, "front")
    found = None
    for level in range(1, max_depth + 1):
        step = front.join(hops.where(F.col("left") <= max_depth - level).withColumnRenamed("src", "node"), "node").select("source", F.col("dst").alias("node"), "path", "sanitized")
        step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min(F.struct("path", "sanitized")).alias("p"))
        met = step.join(ends, "node", "left").join(clean, "node", "left")
        met = met.select("source", "node", F.concat("p.path", F.array("node")).alias("path"), (F.col("p.sanitized") | F.col("clean").isNotNull()).alias("sanitized"), F.col("sink").isNotNull().alias("sink"))
        met = written(met, "met")
        if met.isEmpty():
            break
        seen = seen.select("source", "node").unionByName(met.select("source", "node"))
        hit = met.where("sink")
        found = hit if found is None else found.unionByName(hit)
        front = met.where("not sink").drop("sink")
    if found is None:
        found = front.where("false").withColumn("sink", F.lit(True))
    score = F.least(F.size("path") * STEP_RISK, F.lit(STEPS_RISK)) + SINK_RISK + SOURCE_RISK
    risk = F.least(F.lit(100), F.when(F.col("sanitized"), F.floor(score * 0.5)).otherwise(score)).cast("int")
    return found.select("source", F.col("node").alias("sink"), "path", "sanitized", risk.alias("risk"))


def taint_report(paths: DataFrame, by: str = "source") -> DataFrame:
    """by, paths, sinks, sanitizers (any path has one), risk: the ladder step of the largest risk."""
    level = F.lit("low")
    for least, name in reversed(LADDER):
        level = F.when(F.col("top") >= least, name).otherwise(level)
    out = paths.groupBy(by).agg(F.count("*").alias("paths"), F.count_distinct("sink").alias("sinks"), F.bool_or("sanitized").alias("sanitizers"), F.max("risk").alias("top"))
    return out.withColumn("risk", level).drop("top")


def affected_routes(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """method, path, handler, consumers: routes that are changed or that a changed node handles, once for each method and path.

    nodes: id, label, qname, method, path (of routes; no method is GET). edges: src, dst, type. Handlers come by HANDLES_ROUTE edges, and
    consumers, by name, over the route's CALLS edges; a route that is changed itself has neither, and comes first. Of several handlers the first by id counts.
    """
    routes = nodes.where("label = 'Route'").select(F.col("id").alias("route"), F.col("qname").alias("own"), F.coalesce("method", F.lit("GET")).alias("method"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"))
    ids = changed.select("id").distinct()
    direct = routes.join(ids.withColumnRenamed("id", "route"), "route").where("path <> ''").select("method", "path", F.lit(0).alias("rank"), F.col("route").alias("by"), F.col("own").alias("handler"), F.lit(None).cast("bigint").alias("of"))
    names = nodes.select(F.col("id").alias("src"), F.col("qname").alias("handler"))
    handled = edges.where("type = 'HANDLES_ROUTE'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(names, "src", "left").join(routes.withColumnRenamed("route", "dst"), "dst")
    handled = handled.select("method", "path", F.lit(1).alias("rank"), F.col("src").alias("by"), F.coalesce("handler", F.concat(F.lit("node-"), F.col("src"))).alias("handler"), F.col("dst").cast("bigint").alias("of"))
    first = direct.unionByName(handled).groupBy("method", "path").agg(F.min(F.struct("rank", "by", "of", "handler")).alias("f"))
    rows = first.select("method", "path", "f.handler", F.col("f.of").alias("src"))
    callees = nodes.select(F.col("id").alias("dst"), F.col("qname").alias("consumer"))
    used = edges.where("type = 'CALLS'").join(rows.select("src").distinct(), "src", "left_semi").join(callees, "dst", "left")
    used = used.groupBy("src").agg(F.array_sort(F.collect_set(F.coalesce("consumer", F.concat(F.lit("node-"), F.col("dst"))))).alias("consumers"))
    return rows.join(used, "src", "left").select("method", "path", "handler", F.coalesce("consumers", F.array().cast("array<string>")).alias("consumers"))


def affected_processes(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """process, severity, steps: processes that are changed (blocked) or have a changed step (degraded), with the names of such steps, sorted.

    nodes: id, label, name. A process has its steps by STEP_IN_PROCESS edges from it. Processes of one name are one.
    """
    ids = changed.select("id").distinct()
    blocked = nodes.where("label = 'Process'").join(ids, "id", "left_semi").select(F.col("name").alias("process"), F.lit(True).alias("own"), F.lit(None).cast("string").alias("step"))
    steps = edges.where("type = 'STEP_IN_PROCESS'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    steps = steps.join(nodes.select(F.col("id").alias("src"), F.col("name").alias("process")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("step")), "dst", "left")
    every = blocked.unionByName(steps.select("process", F.lit(False).alias("own"), "step"))
    out = every.groupBy("process").agg(F.bool_or("own").alias("own"), F.array_sort(F.collect_list("step")).alias("steps"))
    return out.select("process", F.when(F.col("own"), "blocked").otherwise("degraded").alias("severity"), "steps")


def affected_tests(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """test, symbol, impact: each test with a TESTS edge to a changed node once, with the first such node; direct if the test is changed itself."""
    ids = changed.select("id").distinct()
    hit = edges.where("type = 'TESTS'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("test")).agg(F.min("dst").alias("symbol"))
    own = ids.select(F.col("id").alias("test"), F.lit(True).alias("own"))
    return hit.join(nodes.select(F.col("id").alias("test")), "test", "left_semi").join(own, "test", "left").select("test", "symbol", F.when(F.col("own"), "direct").otherwise("indirect").alias("impact"))


def file_dependencies(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("IMPORTS", "CALLS")) -> DataFrame:
    """file, inbound, outbound, total of files whose symbols have such edges. nodes: id, file."""
    e = edges.where(F.col("type").isin(*types))
    of = nodes.where("file is not null").select("id", "file")
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("into")).unionByName(e.select(F.col("dst").alias("id"), F.lit(1).alias("into")))
    # Counted by node before the join, so that a node with most of the edges is one row.
    by_node = ends.groupBy("id").agg(F.sum("into").alias("inbound"), F.sum(1 - F.col("into")).alias("outbound"))
    out = of.join(by_node, "id").groupBy("file").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"))
    return out.withColumn("total", F.col("inbound") + F.col("outbound"))


def structure_report(nodes: DataFrame, most: int = 15) -> DataFrame:
    """label, n, percent (whole) of the first ``most`` labels, and a row of a null label for all others together if there are any."""
    counts = nodes.groupBy("label").agg(F.count("*").alias("n"))  # one row for each label
    w = Window.orderBy(F.desc("n"), "label")
    rows = counts.withColumn("r", F.row_number().over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    head = rows.where(F.col("r") <= most).select("label", "n", F.round(100 * F.col("n") / F.col("all")).cast("int").alias("percent"))
    rest = rows.where(F.col("r") > most).agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(None).cast("string").alias("label"), "n", F.lit(None).cast("int").alias("percent"))
    return head.unionByName(rest)


def graph_health(nodes: DataFrame, edges: DataFrame, containers: tuple[str, ...] = ("File", "Folder", "Project")) -> DataFrame:
    """One row: nodes, edges, density (per cent, two places), isolated, isolated_percent, density_level, isolated_level."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    lone = nodes.where(~F.col("label").isin(*containers)).join(touched, "id", "left_anti").agg(F.count("*").alias("isolated"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(lone)  # three single rows
    n = F.col("nodes").cast("double")
    out = counts.withColumn("density", F.when(n > 1, F.round(F.col("edges") / (n * (n - 1)) * 10000) / 100).otherwise(0.0)).withColumn("isolated_percent", F.when(n > 0, F.round(100 * F.col("isolated") / n)).otherwise(0.0).cast("int"))
    step = lambda c, low, high, names: F.when(F.col(c) < low, names[0]).when(F.col(c) < high, names[1]).otherwise(names[2])
    return out.withColumn("density_level", step("density", 1, 5, ("healthy", "moderate", "dense"))).withColumn("isolated_level", step("isolated_percent", 5, 20, ("healthy", "moderate", "high")))


def architecture(nodes: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """part, name, qname of a project's overview: modules and routes all, the first classes, exported functions and interfaces by id.

    nodes: id, label, name, qname, exported. caps: how many at most of class, entry_point and interface.
    """
    most = {"class": 20, "entry_point": 20, "interface": 10} | (caps or {})
    slices = {"module": F.col("label") == "Module", "class": F.col("label") == "Class", "entry_point": (F.col("label") == "Function") & F.col("exported"), "interface": F.col("label") == "Interface", "route": F.col("label") == "Route"}
    out = None
    for part, cond in slices.items():
        rows = nodes.where(cond)
        rows = rows.orderBy("id").limit(most[part]) if part in most else rows
        rows = rows.select(F.lit(part).alias("part"), "name", "qname")
        out = rows if out is None else out.unionByName(rows)
    return out


def reachable_sinks(paths: DataFrame) -> DataFrame:
    """source, sink, paths, shortest (nodes): paths of ``dataflow_paths`` (or any with source, sink, path) by their sink."""
    return paths.groupBy("source", "sink").agg(F.count("*").alias("paths"), F.min(F.size("path")).alias("shortest"))


def suggested_owners(nodes: DataFrame, edges: DataFrame, changed: DataFrame, most: int = 5) -> DataFrame:
    """owner: the first ``most`` distinct folders, by name, of files whose symbols call a changed one. nodes: id, file; a file without a folder has none."""
    callers = edges.where("type = 'CALLS'").join(changed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    files = nodes.join(callers, "id", "left_semi").where(F.col("file").contains("/")).select(F.regexp_replace("file", "/[^/]*$", "").alias("owner")).distinct()
    return files.orderBy("owner").limit(most)


def change_report(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """One row: impacted, tests, routes, processes, files, level, risk, effort of a change (id) of nodes (id, label, name, qname, file, method, path).

    impacted: who reaches a changed node over CALLS and IMPORTS within ``depth``. level: critical from 20 impacted or 3 processes on, high from 10 or 2,
    medium from 3 or 1. effort: high over 10 changed files, medium over 5.
    """
    from .traverse import bfs

    back = edges.where("type in ('CALLS', 'IMPORTS')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    levels = bfs(back, changed.select("id").distinct(), depth).where("distance > 0")
    own = nodes.join(changed.select("id").distinct(), "id", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(levels, "impacted").crossJoin(one(affected_tests(nodes, edges, changed), "tests")).crossJoin(one(affected_routes(nodes, edges, changed), "routes"))  # single rows
    row = row.crossJoin(one(affected_processes(nodes, edges, changed), "processes")).crossJoin(own.agg(F.count_distinct("file").alias("files"), F.count("*").alias("symbols")))
    level = F.when(F.expr("impacted >= 20 or processes >= 3"), "critical").when(F.expr("impacted >= 10 or processes >= 2"), "high").when(F.expr("impacted >= 3 or processes >= 1"), "medium").otherwise("low")
    row = row.withColumn("level", level)
    risk = change_risk(F.col("level"), F.col("symbols"), F.col("impacted"), F.col("processes"), F.col("files"))
    effort = F.when(F.col("files") > 10, "high").when(F.col("files") > 5, "medium").otherwise("low")
    return row.withColumn("risk", risk).withColumn("effort", effort).drop("symbols")


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """id, way (in, out), type, other, name: of each node (id) its first ``most`` neighbours each way, by edge type and id.

    Neighbours are ranked in parts before they are ranked as a whole, so a node with most of the edges is no one task's work.
    """
    e = edges.select("src", "dst", "type").distinct()
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("way"), "type").unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("way"), "type"))
    rows = both.join(ids.select("id").distinct(), "id", "left_semi").join(nodes.select(F.col("id").alias("other"), "name"), "other")
    part = F.pmod(F.xxhash64("other"), F.lit(64))
    for keys in (["id", "way", part], ["id", "way"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("type", "other"))).where(F.col("r") <= most).drop("r")
    return rows.select("id", "way", "type", "other", "name")
