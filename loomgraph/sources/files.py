"""Files, configuration, diffs and graph exports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import file_pattern
from ..graph import PropertyGraph

#: File name endings and their languages.
LANGUAGES = {
    "c": "c", "cpp": "cpp", "cs": "csharp", "css": "css", "go": "go", "html": "html", "java": "java", "js": "javascript",
    "json": "json", "jsx": "javascript", "kt": "kotlin", "md": "markdown", "php": "php", "py": "python", "rb": "ruby", "rs": "rust",
    "scala": "scala", "sh": "bash", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescript", "xml": "xml",
    "yaml": "yaml", "yml": "yaml",
}


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = 10 << 20) -> DataFrame:
    """path (below root), size, language, sha256, content of the files that are not empty, too large or ignored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length").between(1, most_bytes))
    out = files.withColumn("path", F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("file://", "") + "/", ""))
    for p in ignore or []:
        out = out.where(~F.col("path").rlike(file_pattern(p)) & ~F.col("path").rlike(file_pattern("**/" + p)))
    return out.select("path", F.col("length").alias("size"), language(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"), "content")


def config_entries(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, line, key, value of ``key = value`` and ``key: value`` lines; comments and section heads are left out."""
    flat = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "row"))
    form = r"^\s*([A-Za-z_][\w.\-]*)\s*[=:]\s*(.*?)\s*$"
    return flat.where(F.col("row").rlike(form) & ~F.col("row").rlike(r"^\s*[#;\[]")).select("id", (F.col("at") + 1).alias("line"), F.regexp_extract("row", form, 1).alias("key"), F.regexp_extract("row", form, 2).alias("value"))


def json_entries(rows: DataFrame, id_col: str, json_col: str, depth: int = 10) -> DataFrame:
    """id, key, value: a JSON object flattened to dotted keys, by one explosion for each level."""
    def level(v: DataFrame) -> DataFrame:
        return v.select("id", "key", F.from_json("value", "map<string,string>").alias("m"), "value")

    kept, left = None, rows.select(F.col(id_col).alias("id"), F.lit("").alias("key"), F.col(json_col).alias("value"))
    for _ in range(depth):
        split = level(left)
        done = split.where("key <> '' and not coalesce(value like '{%', false)").select("id", "key", "value")
        kept = done if kept is None else kept.unionByName(done)
        left = split.where("coalesce(value like '{%', false)").select("id", "key", F.explode("m").alias("k", "value")).select("id", F.concat_ws(".", F.when(F.col("key") != "", F.col("key")), "k").alias("key"), "value")
    return kept


def diff_lines(diffs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, file, kind (added, removed, context), line of the new file, text, of unified diffs."""
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "row"))
    w = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("file", F.last(F.when(F.col("row").startswith("+++ "), F.regexp_extract("row", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(w))
    rows = rows.withColumn("hunk", F.sum(F.when(F.col("row").startswith("@@"), 1).otherwise(0)).over(w)).withColumn("head", F.when(F.col("row").startswith("@@"), F.regexp_extract("row", r"\+(\d+)", 1).cast("int")))
    body = rows.where("hunk > 0").withColumn("first", F.first("head", ignorenulls=True).over(Window.partitionBy("id", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    body = body.where(~F.col("row").startswith("@@") & ~F.col("row").rlike(r"^(?:---|\+\+\+|diff |index )"))
    kind = F.when(F.col("row").startswith("+"), "added").when(F.col("row").startswith("-"), "removed").otherwise("context")
    body = body.withColumn("kind", kind)
    step = F.sum(F.when(F.col("kind") != "removed", 1).otherwise(0)).over(Window.partitionBy("id", "hunk").orderBy("at"))
    return body.withColumn("line", F.col("first") + step - 1).select("id", "file", "kind", "line", F.expr("substr(row, 2)").alias("text"))


def diff_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("id", "file").agg(F.sum(F.when(F.col("kind") == "added", 1).otherwise(0)).alias("added"), F.sum(F.when(F.col("kind") == "removed", 1).otherwise(0)).alias("removed"))


def export_graph(graph: PropertyGraph, folder: str) -> None:
    """Compressed Parquet with a checksum of each row."""
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        df.withColumn("checksum", F.sha2(F.to_json(F.struct(*df.columns)), 256)).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def import_graph(spark: SparkSession, folder: str) -> tuple[PropertyGraph, DataFrame]:
    """The graph, and the rows (table, n) whose checksum no longer fits."""
    out, bad = [], None
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{folder}/{name}")
        plain = [c for c in df.columns if c != "checksum"]
        wrong = df.where(F.sha2(F.to_json(F.struct(*plain)), 256) != F.col("checksum")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        bad = wrong if bad is None else bad.unionByName(wrong)
        out.append(df.drop("checksum"))
    return PropertyGraph(*out), bad


def symbol_index(nodes: DataFrame, folder: str | None = None) -> DataFrame:
    """file_path, symbols: the symbols of each file, as documents of an index; written as JSON if a folder is given."""
    out = nodes.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("id", "label", "name"))).alias("symbols"))
    if folder:
        out.write.mode("overwrite").json(folder)
    return out


def dot_lines(cross: DataFrame) -> DataFrame:
    """Lines of a DOT graph of (src_repo, dst_repo, type, n)."""
    return cross.select(F.format_string('"%s" -> "%s" [label="%s (%d)"];', "src_repo", "dst_repo", "type", "n").alias("line"))
