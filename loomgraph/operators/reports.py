"""Roll-ups and reports: files, hotspots, change clusters, owners, trends, risk, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate
from . import intervals


#: From where on a file is risky (total complexity, symbols), a folder's effort is high or medium (files), and a change has a
#: reason of risk (direct, indirect, tests, processes, direct and indirect together) or is of high or medium risk (reasons).
RISKY_TOTAL, RISKY_SYMBOLS = 10, 20
EFFORT = {"high": 10, "medium": 5}
MANY_DIRECT, MANY_INDIRECT, MANY_TESTS, SOME_PROCESSES, WIDE = 10, 20, 5, 1, 31
CLASSES = {"high": 3, "medium": 1}


def file_rollup(symbols: DataFrame) -> DataFrame:
    """Per file: symbols, total and average complexity; risky over a total of 10 or over 20 symbols."""
    c = F.coalesce("complexity", F.lit(0))
    out = symbols.groupBy("file").agg(F.count("*").alias("symbols"), F.sum(c).alias("total"), F.avg(c).alias("average"))
    return out.withColumn("risky", (F.col("total") > RISKY_TOTAL) | (F.col("symbols") > RISKY_SYMBOLS))


def hotspots(nodes: DataFrame, degree: DataFrame, most: int = 50, least: int = 10) -> DataFrame:
    """Nodes (id, complexity) over ``least`` in complexity or degree (id, degree): the first ``most`` by complexity, then degree."""
    rows = nodes.join(degree, "id", "left").select("id", F.coalesce("complexity", F.lit(0)).alias("complexity"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return rows.where((F.col("complexity") > least) | (F.col("degree") > least)).orderBy(F.desc("complexity"), F.desc("degree"), "id").limit(most)


def change_clusters(changed: DataFrame) -> DataFrame:
    """Changed files (path) by folder: their number, and the effort it means."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return changed.groupBy(folder.alias("folder")).agg(F.count("*").alias("files")).withColumn("effort", F.when(F.col("files") > EFFORT["high"], "high").when(F.col("files") > EFFORT["medium"], "medium").otherwise("low"))


def rolling(reports: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Each report with the mean of the last ``n`` of its key, and the half (recent: the first floor(count / 2) from the end) it is in."""
    w = Window.partitionBy(key)
    last = w.orderBy(order).rowsBetween(-(n - 1), 0)
    from_end = F.row_number().over(w.orderBy(F.desc(order)))
    return reports.withColumn("mean", F.avg(value).over(last)).withColumn("half", F.when(from_end <= F.floor(F.count("*").over(w) / 2), "recent").otherwise("older"))


def attach(rows: DataFrame, group: str, order: str, is_owner, owner: str) -> DataFrame:
    """Each row with the last owner row's value before it in its group, or its own (the as-of form of an attachment)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("owner", F.last(F.when(is_owner, F.col(owner)), ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row (key, at, ...) with the last right ``value`` of its key at or before ``at``: one window over both, no range join."""
    both = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__side", F.lit(1))
    both = both.unionByName(right.select(key, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def risk(counts: DataFrame) -> DataFrame:
    """Per id, from (id, direct, indirect, tests, processes): the reasons that hold, and the class of their number."""
    total = F.col("direct") + F.col("indirect")
    flags = [(F.col("direct") >= MANY_DIRECT, "many direct"), (F.col("indirect") >= MANY_INDIRECT, "many indirect"), (F.col("tests") >= MANY_TESTS, "many tests"), (F.col("processes") >= SOME_PROCESSES, "in a process"), (total >= WIDE, "wide")]
    reasons = F.array_compact(F.array(*[F.when(test, name) for test, name in flags]))
    return counts.select("id", F.array_join(reasons, ", ").alias("reasons"), F.size(reasons).alias("n_reasons"), F.when(F.size(reasons) >= CLASSES["high"], "high").when(F.size(reasons) >= CLASSES["medium"], "medium").otherwise("low").alias("class"))


def shared_contracts(symbols: DataFrame) -> DataFrame:
    """Names (name, repo) that at least two repositories have."""
    return symbols.groupBy("name").agg(F.count_distinct("repo").alias("repos")).where("repos >= 2")


def type_compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per name and property (name, property, type) of two versions: removed is breaking; another type, or an added one, a warning."""
    x, y = old.withColumnRenamed("type", "was"), new.withColumnRenamed("type", "becomes")
    both = x.join(y, ["name", "property"], "full").where("not (was <=> becomes)")
    change = F.when(F.col("becomes").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("changed")
    return both.select("name", "property", change.alias("change"), F.when(F.col("becomes").isNull(), "breaking").otherwise("warning").alias("level"))


def breaking(changes: DataFrame, uses: DataFrame) -> DataFrame:
    """Per repository that uses (repo, name) a name with a breaking change (name, level): how many such names."""
    return uses.distinct().join(changes.where("level = 'breaking'").select("name").distinct(), "name").groupBy("repo").agg(F.count("*").alias("broken"))


def alignment(uses: DataFrame, recommended: DataFrame) -> DataFrame:
    """Per package: the repositories (package, repo, version) whose version is not the recommended one (package, version)."""
    rows = uses.join(recommended.withColumnRenamed("version", "best"), "package").where("version <> best")
    return rows.groupBy("package", "best").agg(F.array_join(F.array_sort(F.collect_set(F.col("repo").cast("string"))), ",").alias("repos"))


def folders(files: DataFrame) -> DataFrame:
    """(folder, parent, files): every folder above the files (path), with the number of files under it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = files.where(F.col("path").contains("/")).select(F.explode(up).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("files")).withColumn("parent", F.when(F.col("folder").contains("/"), F.regexp_replace("folder", "/[^/]*$", "")))


def affected(edges: DataFrame, changed: DataFrame, kind: str, name) -> DataFrame:
    """Sources of ``kind`` edges into changed nodes (id), once for each ``name``: (name, id of the first, targets)."""
    rows = edges.where(F.col("type") == kind).join(changed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return rows.groupBy(name.alias("name")).agg(F.min("src").alias("id"), F.count_distinct("dst").alias("targets"))


def merge_comments(comments: DataFrame, least: int = 3) -> DataFrame:
    """Comments (id, path, category, start, end) of which no earlier one (by id) of the path and category shares ``least`` lines.

    Two ranges share so many lines where they still meet once their ends are that much less one earlier. Ids are unique.
    """
    keys = ["path", "category"]
    short = comments.select("id", *keys, "start", (F.col("end") - (least - 1)).alias("end"))
    points = intervals.valid(short, keys)
    first = intervals.least_holding(points, short, keys, "id", "start", F.col("id")).unionByName(intervals.least_held(short, points, keys, "id", "start", F.col("id")))
    return comments.join(first.where("least < id").select("id").distinct(), "id", "left_anti")


def project_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project, kind (label, language, edge), value, n: how often each occurs in each project. nodes: id, project, label, language; an edge counts for its source's project."""
    by = lambda df, kind, col: df.groupBy("project", F.col(col).alias("value")).agg(F.count("*").alias("n")).select("project", F.lit(kind).alias("kind"), "value", "n")
    # Edges are counted by source and type first, so that a source with most of them is one row.
    typed = edges.groupBy("src", "type").agg(F.count("*").alias("c")).join(nodes.select(F.col("id").alias("src"), "project"), "src")
    types = typed.groupBy("project", F.col("type").alias("value")).agg(F.sum("c").alias("n")).select("project", F.lit("edge").alias("kind"), "value", "n")
    return by(nodes, "label", "label").unionByName(by(nodes.where("language is not null"), "language", "language")).unionByName(types)


def clusters(nodes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, n, language: nodes (id, language) of each cluster and the language of the first by id that has one."""
    return nodes.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("id"))).alias("language"))


def by_module(stats: DataFrame) -> DataFrame:
    """module, files, added, removed of files (file, added, removed) by their first folder (``.`` without one)."""
    module = F.when(F.col("file").contains("/"), F.regexp_extract("file", "^/?([^/]+)/", 1)).otherwise(".")
    return stats.groupBy(module.alias("module")).agg(F.count_distinct("file").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


#: Buckets of complexity, by their first value.
BUCKETS = {"1-5": 1, "6-10": 6, "11-20": 11, "21-50": 21, "50+": 51}


def complexity_distribution(scores: DataFrame) -> DataFrame:
    """bucket, n, percent (whole), low, high, mean (two places) of scores (id, score) over 0, by BUCKETS."""
    bucket = F.lit(None).cast("string")
    for name, least in BUCKETS.items():
        bucket = F.when(F.col("score") >= least, name).otherwise(bucket)
    rows = scores.where("score > 0").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 2).alias("mean"))
    return rows.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("int"))  # at most five rows


def package_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, a < b: first folders of files that IMPORTS and CALLS join both ways. nodes: id, file."""
    top = F.regexp_extract("file", "^/?([^/]+)/", 1)
    of = nodes.where(top != "").select("id", top.alias("package"))
    e = edges.where("type in ('IMPORTS', 'CALLS')").select("src", "dst").distinct().join(of.select(F.col("id").alias("src"), F.col("package").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("package").alias("b")), "dst")
    steps = e.where("a <> b").select("a", "b").distinct()
    return steps.where("a < b").join(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def implementations(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """interface, class, methods: what has an IMPLEMENTS edge to an interface (id), with how many HAS_METHOD edges leave it."""
    found = edges.where("type = 'IMPLEMENTS'").join(of.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("interface"), F.col("src").alias("class")).distinct()
    methods = edges.where("type = 'HAS_METHOD'").select("src", "dst").distinct().groupBy(F.col("src").alias("class")).agg(F.count("*").alias("methods"))
    return found.join(nodes.select(F.col("id").alias("class")), "class", "left_semi").join(methods, "class", "left").select("interface", "class", F.coalesce("methods", F.lit(0)).alias("methods"))


def external_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, uses: ends of edges that are no node of the project, and how many edges lead there."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("uses")).join(nodes.select("id"), "id", "left_anti")


def compressed_turns(turns: DataFrame, prefix: int = 1, recent: int = 2) -> DataFrame:
    """conv_id, zone, n, tokens: the first ``prefix`` turns (frozen), the last ``recent`` of the others (recent), and what stands between (middle). turns: conv_id, turn, text."""
    w = Window.partitionBy("conv_id")
    zone = F.when(F.row_number().over(w.orderBy("turn")) <= prefix, "frozen").when(F.row_number().over(w.orderBy(F.desc("turn"))) <= recent, "recent").otherwise("middle")
    rows = turns.select("conv_id", zone.alias("zone"), token_estimate(F.col("text")).alias("tokens"))
    return rows.groupBy("conv_id", "zone").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def report_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change (added, removed) of the findings of two reports."""
    a, b = before.select("id").distinct(), after.select("id").distinct()
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("removed")))
