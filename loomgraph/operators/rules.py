"""Rules over lines of text, and tables of findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    pattern: str


#: Severities and what they weigh.
SEVERITY_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 1), text. Null texts have no lines."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "text")).select("id", (F.col("at") + 1).alias("line"), "text")


def line_findings(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line, rule, category, severity: each line with each rule it breaks. Rules are expressions of one pass, not a join."""
    hits = F.array(*[F.when(F.col("text").rlike(r.pattern), F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"))) for r in rules])
    return lines(docs, id_col, text_col).select("id", "line", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r")).select("id", "line", "r.rule", "r.category", "r.severity")


def compliance(results: DataFrame) -> DataFrame:
    """score, weighted of (rule, severity, passed)."""
    weight = F.lit(0)
    for s, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    return results.agg(F.round(F.avg(F.col("passed").cast("double")) * 100, 6).alias("score"), F.round(F.sum(weight * F.col("passed").cast("int")) / F.sum(weight) * 100, 6).alias("weighted"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tables of standards by rule; where both have a rule the second's counts."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("__p")))).where("__r = 1").drop("__p", "__r")


def recommendations(findings: DataFrame, k: int = 20) -> DataFrame:
    """file, category, n, score: groups of findings by .5 severity + .3 spread + .2 ease, best first."""
    weight = F.lit(0)
    for s, w in SEVERITY_WEIGHTS.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    groups = findings.groupBy("file", "category").agg(F.count("*").alias("n"), F.max(weight).alias("worst"), F.countDistinct("rule").alias("rules"))
    score = F.round(0.5 * F.col("worst") / 5 + 0.3 * F.least(F.col("n") / 10, F.lit(1.0)) + 0.2 / F.col("rules"), 6)
    return groups.select("file", "category", "n", score.alias("score")).orderBy(F.desc("score"), "file", "category").limit(k)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:
    """id, title, level, start, end: each heading to the line before the next one, or the last line."""
    all_lines = lines(docs, id_col, text_col)
    counts = docs.select(F.col(id_col).alias("id"), F.size(F.split(text_col, "\n", -1)).alias("last"))
    heads = all_lines.where(F.col("text").rlike(heading)).select("id", F.col("line").alias("start"), F.regexp_extract("text", heading, 2).alias("title"), F.length(F.regexp_extract("text", heading, 1)).alias("level"))
    w = Window.partitionBy("id").orderBy("start")
    return heads.withColumn("next", F.lead("start").over(w)).join(counts, "id").select("id", "title", "level", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("end"))


def complexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, branches (1 + decision words), depth (the deepest nesting of braces), lines."""
    marks = F.transform(F.regexp_extract_all(text_col, F.lit("([{}])"), F.lit(1)), lambda c: F.when(c == "{", 1).otherwise(-1))
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")), lambda s: s["most"])
    return docs.select(F.col(id_col).alias("id"), (1 + F.regexp_count(text_col, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?"))).alias("branches"), depth.alias("depth"), F.size(F.split(text_col, "\n", -1)).alias("lines"))
