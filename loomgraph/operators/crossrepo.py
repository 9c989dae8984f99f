"""Across repositories: blast radius, dependency chains, symbol traces, federated search, duplicates, breaking changes, routes, standards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .traverse import bfs

#: Edge weights of impact levels, and labels of symbols.
WEIGHTS = {"critical": 10, "high": 7, "medium": 4}
SYMBOL_LABELS = ["Function", "Class", "Interface", "TypeAlias", "Enum", "Method"]
TRACED = "CROSS_REPO_"


def severity(weight: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(WEIGHTS.items()):
        out = F.when(weight >= least, name).otherwise(out)
    return out


def blast_radius(edges: DataFrame, sources: DataFrame, most_depth: int = 100) -> DataFrame:
    """repo, depth, kind (direct, transitive), severity, critical: what changes in the sources (id) reach over edges (src, dst, weight).

    severity is that of the heaviest edge into a repo from anywhere; critical: an edge of weight 7 or more leads there from a source.
    """
    levels = bfs(edges, sources, most_depth).where("distance > 0")
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.max("weight").alias("weight"))
    sure = edges.where(F.col("weight") >= WEIGHTS["high"]).join(sources.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(True).alias("critical")).distinct()
    out = levels.join(into, "id").join(sure, "id", "left")
    kind = F.when(F.col("distance") == 1, "direct").otherwise("transitive")
    return out.select(F.col("id").alias("repo"), F.col("distance").alias("depth"), kind.alias("kind"), severity(F.col("weight")).alias("severity"), F.coalesce("critical", F.lit(False)).alias("critical"))


def dependency_chains(edges: DataFrame, sources: DataFrame, most_depth: int = 50) -> DataFrame:
    """path, depth, criticality: all paths without a repeated repo from a source (id) to a repo that nothing leaves, over edges (src, dst, weight).

    criticality is that of the heaviest edge that touches a repo of the path. A path longer than ``most_depth`` is an error, not a cut.
    """
    steps = written(edges.select("src", "dst").distinct(), "steps")
    leads = steps.select(F.col("src").alias("last"), F.lit(True).alias("leads")).distinct()
    touch = edges.select(F.col("src").alias("repo"), "weight").unionByName(edges.select(F.col("dst").alias("repo"), "weight")).groupBy("repo").agg(F.max("weight").alias("weight"))
    heavy = lambda df: df.join(touch.withColumnRenamed("repo", "last"), "last", "left").withColumn("top", F.greatest(F.coalesce("top", F.lit(0)), F.coalesce("weight", F.lit(0)))).drop("weight")
    start = sources.select(F.array("id").alias("path"), F.col("id").alias("last"), F.lit(0).alias("top"))
    front, done = written(heavy(start), "front"), None
    for _ in range(most_depth):
        grown = front.join(steps.withColumnRenamed("src", "last"), "last").where(~F.expr("array_contains(path, dst)")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"), "top")
        grown = written(heavy(grown).join(leads, "last", "left"), "front")
        ended = grown.where("leads is null")
        done = ended if done is None else done.unionByName(ended)
        front = grown.where("leads").drop("leads")
        if front.isEmpty():
            return done.select("path", (F.size("path") - 1).alias("depth"), severity(F.col("top")).alias("criticality"))
    raise RuntimeError(f"chains of more than {most_depth} steps")


def trace_symbol(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, repos: list[str] | None = None) -> DataFrame:
    """source, target_repo, target, kind, depth, confidence of symbols of other repos that a seed (repo, symbol) leads to by one or two edges.

    nodes: id, repo, qname, name; edges: src, dst, type. A seed means the nodes of its repo whose name is the symbol or whose qualified name
    has it in it, case aside. Only edges whose type begins with CROSS_REPO_ and ends in another repo (of ``repos``, if given) count; the second
    starts from where the first ended.
    """
    n = nodes.where(F.col("repo").isin(*repos)) if repos else nodes
    cross = edges.where(F.col("type").startswith(TRACED)).select("src", "dst", "type").distinct()
    end = lambda p: n.select(F.col("id").alias(f"{p}_id"), F.col("repo").alias(f"{p}_repo"), F.col("qname").alias(f"{p}_qname"))
    wanted = seeds.select(F.col("repo").alias("a_repo"), F.lower("symbol").alias("wanted"))
    named = n.select(F.col("id").alias("a_id"), F.col("repo").alias("a_repo"), F.col("qname").alias("a_qname"), F.lower("name").alias("low"), F.lower("qname").alias("qlow"))
    a = named.join(wanted, "a_repo").where((F.col("low") == F.col("wanted")) | F.contains("qlow", "wanted")).select("a_id", "a_repo", "a_qname").distinct()
    one = a.join(cross, a["a_id"] == cross["src"]).withColumnRenamed("dst", "b_id").withColumnRenamed("type", "t1").drop("src").join(end("b"), "b_id").where("b_repo <> a_repo")
    two = one.join(cross, one["b_id"] == cross["src"]).withColumnRenamed("dst", "c_id").drop("src").join(end("c"), "c_id").where("c_repo <> b_repo")
    first = one.select(F.col("a_qname").alias("source"), F.col("b_repo").alias("target_repo"), F.col("b_qname").alias("target"), F.col("t1").alias("kind"), F.lit(1).alias("depth"), F.lit("high").alias("confidence"))
    second = two.select(F.col("a_qname").alias("source"), F.col("c_repo").alias("target_repo"), F.col("c_qname").alias("target"), F.concat(F.lit("transitive_"), F.col("type")).alias("kind"), F.lit(2).alias("depth"), F.lit("medium").alias("confidence"))
    return first.unionByName(second).distinct()


def federated_search(scored: DataFrame, nodes: DataFrame, most: int = 50, repos: list[str] | None = None, group: str | None = None) -> DataFrame:
    """id, repo, name, relevance, rank, in_repo: the first ``most`` hits, after 5 ``most`` were asked for, with how many of them each repo has.

    scored: id, score of a full-text search. Where it found more than ``most``, only symbols (SYMBOL_LABELS) stay. repos and group
    (a repo's name or its beginning) filter the hits that were fetched. relevance is score / 20.
    """
    fetched = scored.orderBy(F.desc("score"), "id").limit(5 * most)  # a top list
    hits = fetched.join(nodes.select("id", "repo", "label", "name"), "id").withColumn("found", F.count("*").over(Window.partitionBy()))
    kept = hits.where((F.col("found") <= most) | F.col("label").isin(*SYMBOL_LABELS))
    if repos:
        kept = kept.where(F.col("repo").isin(*repos))
    if group:
        kept = kept.where(F.col("repo").startswith(group))
    top = kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)
    return top.select("id", "repo", "name", (F.col("score") / 20).alias("relevance"), "rank", F.count("*").over(Window.partitionBy("repo")).alias("in_repo"))


def find_symbol(nodes: DataFrame, name: str) -> DataFrame:
    """id, repo, qname, match: symbols and variables whose name or qualified name has ``name`` in it; exact if one of them is ``name``."""
    labels = [*SYMBOL_LABELS, "Variable"]
    exact = (F.col("name") == name) | (F.col("qname") == name)
    hit = F.contains(F.lower("name"), F.lit(name.lower())) | F.contains(F.lower("qname"), F.lit(name.lower()))
    rows = nodes.where((F.col("qname") == name) | (F.col("label").isin(*labels) & hit)).withColumn("match", F.when(exact, "exact").otherwise("partial"))
    first = Window.partitionBy("repo", "qname").orderBy((F.col("match") != "exact").cast("int"), "id")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("id", "repo", "qname", "match")


def exact_jaccard(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of ids with sets (id, items: distinct) whose Jaccard likeness is ``least`` or more; empty sets have none.

    Two such sets share one of the first n - ceil(least n) + 1 items of each in any common order: here by how few sets hold an item,
    so the keys are the rare ones. Sizes must fit too. Candidates are few, and each is compared in full.
    """
    rows = written(sets.select("id", "items").where("size(items) > 0"), "sets")
    flat = rows.select("id", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = flat.groupBy("item").agg(F.count("*").alias("df"))
    ordered = flat.join(often, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"))
    prefix = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    keyed = written(ordered.select("id", "n", F.explode(F.transform(prefix, lambda x: x["item"])).alias("item")), "keyed")
    pairs = keyed.alias("x").join(keyed.alias("y"), "item").where("x.id < y.id").where((F.col("x.n") >= least * F.col("y.n")) & (F.col("y.n") >= least * F.col("x.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= least)


def cross_repo_duplicates(symbols: DataFrame, least: float = 0.8) -> DataFrame:
    """repo_a, file_a, files_a, repo_b, file_b, files_b, similarity (two places): files of two repos, repo_a < repo_b, whose symbols are alike.

    symbols: repo, file, label, name (null: the file has none and stands for itself). A file is the set of its ``label:name``. Files of one repo with equal
    sets are one row, named by the first and counted, so copies are not paired with each other.
    """
    token = F.when(F.col("name").isNotNull(), F.concat_ws(":", "label", "name"))
    sets = symbols.groupBy("repo", "file").agg(F.array_sort(F.collect_set(token)).alias("items"))
    sets = sets.withColumn("items", F.when(F.size("items") == 0, F.array("file")).otherwise(F.col("items")))
    classes = sets.groupBy("items").agg(F.min(F.struct("repo", "file")).alias("first"))
    members = sets.groupBy("repo", "items").agg(F.min("file").alias("file"), F.count("*").alias("files"))
    classes = written(classes.select(F.xxhash64("items", "first").alias("id"), "items"), "classes")
    members = written(members.join(classes, "items").select("id", "repo", "file", "files"), "members")
    pairs = exact_jaccard(classes, least)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    side = lambda p: members.select(*[F.col(c).alias("a" if c == "id" and p == "a" else "b" if c == "id" else f"{c}_{p}") for c in members.columns])
    out = both.join(side("a"), "a").join(side("b"), "b").where("repo_a < repo_b")
    return out.select("repo_a", "file_a", "files_a", "repo_b", "file_b", "files_b", F.round("similarity", 2).alias("similarity"))


def breaking_changes(before: DataFrame, after: DataFrame, uses: DataFrame) -> DataFrame:
    """symbol, change, new_name, repos: what a change of symbols breaks, and in how many repos. uses: symbol, repo.

    before, after: symbol, params (names in order), required (how many must be given), returns, body (a checksum). A symbol that is gone is
    ``removed``, or ``renamed`` if a new one has its body (the least such name). One that stayed and is used: ``signature_changed`` (parameters or
    return type differ), ``return_type_changed``, ``parameter_added_required`` (more must be given), ``parameter_removed`` (one is no longer there).
    """
    old = before.select("symbol", *[F.col(c).alias(f"o_{c}") for c in ("params", "required", "returns", "body")], F.lit(True).alias("had"))
    new = after.select("symbol", *[F.col(c).alias(f"n_{c}") for c in ("params", "required", "returns", "body")], F.lit(True).alias("has"))
    both = written(old.join(new, "symbol", "full_outer"), "both")
    fresh = both.where("had is null").groupBy(F.col("n_body").alias("o_body")).agg(F.min("symbol").alias("new_name"))
    used = uses.groupBy("symbol").agg(F.count_distinct("repo").alias("repos"))
    gone = both.where("has is null").join(fresh, "o_body", "left").select("symbol", F.when(F.col("new_name").isNull(), "removed").otherwise("renamed").alias("change"), "new_name")
    kept = both.where("had and has")
    returns = ~F.col("o_returns").eqNullSafe(F.col("n_returns"))
    found = F.array(
        F.when(returns | ~F.col("o_params").eqNullSafe(F.col("n_params")), F.lit("signature_changed")),
        F.when(returns, F.lit("return_type_changed")),
        F.when(F.col("n_required") > F.col("o_required"), F.lit("parameter_added_required")),
        F.when(F.size(F.array_except("o_params", "n_params")) > 0, F.lit("parameter_removed")),
    )
    modified = kept.join(used.select("symbol"), "symbol", "left_semi").select("symbol", F.explode(F.array_compact(found)).alias("change"), F.lit(None).cast("string").alias("new_name"))
    return gone.unionByName(modified).join(used, "symbol", "left").select("symbol", "change", "new_name", F.coalesce("repos", F.lit(0)).alias("repos"))


@dataclass(frozen=True)
class RouteRule:
    """How a framework writes a route: a pattern and its groups of the method and the path (0: ``method`` holds, or the path is /)."""

    framework: str
    languages: tuple[str, ...]
    pattern: str
    path_group: int
    method_group: int = 0
    method: str = "GET"


def detect_routes(files: DataFrame, rules: list[RouteRule]) -> DataFrame:
    """file, line, framework, method (upper case), path of routes that rules find in files (file, language, text), each once for a line.

    A path without a leading / gets one.
    """
    lines = files.select("file", "language", F.posexplode(F.split("text", "\n", -1)).alias("at", "code"))
    out = None
    for r in rules:
        pick = lambda g, rest: F.regexp_extract_all("code", F.lit(r.pattern), F.lit(g)) if g else F.transform(F.regexp_extract_all("code", F.lit(r.pattern), F.lit(0)), lambda _: F.lit(rest))  # noqa: E731, B023
        hits = lines.where(F.col("language").isin(*r.languages) & F.col("code").rlike(r.pattern))
        pairs = F.arrays_zip(pick(r.method_group, r.method).alias("method"), pick(r.path_group, "/").alias("path"))
        rows = hits.select("file", (F.col("at") + 1).alias("line"), F.lit(r.framework).alias("framework"), F.explode(pairs).alias("p"))
        path = F.when(F.col("p.path").startswith("/"), F.col("p.path")).otherwise(F.concat(F.lit("/"), F.col("p.path")))
        rows = rows.select("file", "line", "framework", F.upper("p.method").alias("method"), path.alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def applicable_standards(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """standard, files, evidence: standards for which some path (file) matches the rule's pattern, how many do, and the first of them."""
    hits = F.array_compact(F.array(*[F.when(F.col("file").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return files.select("file", F.explode(hits).alias("standard")).groupBy("standard").agg(F.count_distinct("file").alias("files"), F.min("file").alias("evidence"))


def lenses(findings: dict[str, DataFrame], rank: dict[str, int], most: int = 10) -> DataFrame:
    """lens, file, line, severity, message: the findings (file, line, severity, message) of each lens, and a lens ``synthesis`` of those that
    most lenses share: one row for each file and line that two or more lenses name, with the gravest severity, in ``message`` the lenses; the
    first ``most`` by the number of lenses, then severity, file and line. rank: severities, the gravest highest.
    """
    every = None
    for name, df in findings.items():
        rows = df.select(F.lit(name).alias("lens"), "file", "line", "severity", "message")
        every = rows if every is None else every.unionByName(rows)
    table = F.create_map(*[x for s, k in rank.items() for x in (F.lit(s), F.lit(k))])
    weight = F.coalesce(F.try_element_at(table, F.col("severity")), F.lit(0))
    shared = every.groupBy("file", "line").agg(F.array_sort(F.collect_set("lens")).alias("names"), F.max(F.struct(weight.alias("w"), "severity")).alias("s")).where("size(names) > 1")
    top = shared.orderBy(F.desc(F.size("names")), F.desc("s.w"), "file", "line").limit(most)
    return every.unionByName(top.select(F.lit("synthesis").alias("lens"), "file", "line", F.col("s.severity").alias("severity"), F.array_join("names", ", ").alias("message")))
