"""References to symbols: scope and inheritance resolution, callers by line, matches across projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def _first(symbols: DataFrame, *keys: str) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.min("id").alias("target"))


def elsewhere(symbols: DataFrame) -> DataFrame:
    """(name, file, target, other): the first symbol of a name and its file, and the first one in any other file.

    Two rows of a name are enough to find a symbol outside a given file, so a common name stays small.
    """
    by_file = _first(symbols, "name", "file").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("target"))).where("r <= 2")
    first = by_file.where("r = 1").drop("r")
    return first.join(by_file.where("r = 2").select("name", F.col("target").alias("other")), "name", "left")


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Per reference (id, file, name): target and tier: 1 the imported file's symbol, 2 one of another file, 3 its own file's; null without any.

    symbols: (id, file, name). imports: (file, name, target_file). Ties go to the smallest id.
    """
    local = _first(symbols, "name", "file")
    imported = imports.join(local.select("name", F.col("file").alias("target_file"), "target"), ["name", "target_file"]).groupBy("file", "name").agg(F.min("target").alias("t1"))
    far = elsewhere(symbols).select("name", F.col("file").alias("first_file"), F.col("target").alias("first"), "other")
    rows = refs.join(imported, ["file", "name"], "left").join(far, "name", "left").join(local.withColumnRenamed("target", "t3"), ["name", "file"], "left")
    rows = rows.withColumn("t2", F.when(F.col("first_file") != F.col("file"), F.col("first")).otherwise(F.col("other")))
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    return rows.select("id", F.coalesce("t1", "t2", "t3").alias("target"), tier.alias("tier"))


def inherit(heritage: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Per (id, file, base): the base's symbol by qualified name, else in a file that is imported, else in the same file."""
    qualified = symbols.groupBy(F.col("qname").alias("base")).agg(F.min("id").alias("q"))
    local = _first(symbols, "name", "file")
    files = imports.select("file", "target_file").distinct()
    imported = files.join(local.withColumnRenamed("file", "target_file"), "target_file").groupBy("file", F.col("name").alias("base")).agg(F.min("target").alias("i"))
    own = local.select("file", F.col("name").alias("base"), F.col("target").alias("s"))
    rows = heritage.join(qualified, "base", "left").join(imported, ["file", "base"], "left").join(own, ["file", "base"], "left")
    return rows.select("id", F.coalesce("q", "i", "s").alias("target"))


def callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per reference (id, file, line): the first symbol by (line_start, id) of its file whose lines hold it.

    Symbols without lines, or whose last line comes before the first, hold nothing.
    """
    ranges = symbols.select("file", F.col("line_start").alias("start"), F.col("line_end").alias("end"), "id")
    return intervals.least_holding(refs, ranges, ["file"], "id", "line", F.struct("start", "id")).select("id", F.col("least.id").alias("caller"))


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (id, project, path) and routes (id, project, path) of other projects with an equal path: the first route by id wins."""
    return match_elsewhere(calls, routes.withColumnRenamed("path", "key"), "path")


def match_elsewhere(calls: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    found = elsewhere(targets.select("id", F.col("project").alias("file"), F.col("key").alias("name")))
    rows = calls.withColumnRenamed(column, "name").join(found.withColumnRenamed("file", "first_file"), "name")
    target = F.when(F.col("first_file") != F.col("project"), F.col("target")).otherwise(F.col("other"))
    return rows.select("id", target.alias("target")).where("isnotnull(target)")


def match_channels(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """(channel, emitter, listener): projects that emit on and listen to one channel, each pair once."""
    return emits.distinct().join(listens.distinct().withColumnRenamed("project", "listener"), "channel").where("project <> listener").select("channel", F.col("project").alias("emitter"), "listener")


def classify(rows: DataFrame, column: str, rules: list[tuple[str, str]], to: str = "kind") -> DataFrame:
    """``rows`` with the name of the first rule (name, pattern) that ``column`` matches, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(F.col(column).rlike(pattern), name).otherwise(out)
    return rows.withColumn(to, out)
