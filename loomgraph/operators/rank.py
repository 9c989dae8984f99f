"""PageRank, and scores that weigh eight signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written
from .retrieval import weighted_mean

#: Signals and their weights.
WEIGHTS = {"bm25": 0.2, "semantic": 0.25, "signature": 0.1, "ast_profile": 0.1, "module": 0.05, "page_rank": 0.05, "min_hash": 0.1, "exact": 0.15}
AST_PROFILE = 0.5


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, write_every: int = 5) -> DataFrame:
    """(id, rank): ``rounds`` steps of power iteration; ranks add up to 1.

    nodes: id; edges: src, dst, weight. A node hands its rank on by the weights of its edges; what nodes without a way out hold is
    shared by all. Edges with an end that is no node are left out. A round is one join and one aggregation, and a one-row sum for
    what is shared; it is written every few rounds.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    steps = inside.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    out = steps.groupBy("src").agg(F.sum("w").alias("total")).where("total > 0")
    steps = written(steps.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "steps")
    rank = base = written(ids.join(out.select(F.col("src").alias("id"), F.lit(True).alias("leads")), "id", "left").select("id", F.coalesce("leads", F.lit(False)).alias("leads"), F.lit(1.0 / n).alias("rank")), "rank")
    for r in range(rounds):
        stuck = rank.agg(F.sum(F.when(~F.col("leads"), F.col("rank")).otherwise(0.0)).alias("stuck"))  # one row
        got = steps.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = rank.select("id", "leads").join(got, "id", "left").crossJoin(F.broadcast(stuck))
        rank = new.select("id", "leads", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") / n)).alias("rank"))
        if (r + 1) % write_every == 0 or r + 1 == rounds:
            last, base = base, written(rank, "rank")
            rank = base
            dropped(last)
    return rank.select("id", "rank")


def signature_match(query: list[str], tokens: Column) -> Column:
    """Jaccard likeness of the query's words and those of a signature (an array)."""
    q = F.array(*[F.lit(x) for x in sorted(set(query))])
    own = F.array_distinct(tokens)
    both = F.size(F.array_intersect(q, own))
    return F.when(F.size(F.array_union(q, own)) == 0, 0.0).otherwise(both / F.size(F.array_union(q, own)))


def module_proximity(query: list[str], path: Column) -> Column:
    """The share of the query's words that stand somewhere in the path."""
    found = sum((F.when(F.contains(F.lower(path), F.lit(t)), 1).otherwise(0) for t in query), F.lit(0))
    return found / len(query) if query else F.lit(0.0)


def bag_cosine(query: list[str], tokens: Column) -> Column:
    """Cosine of the word counts of the query and of a text (an array of words); 0 if either has none."""
    wanted = sorted(set(query))
    counts = [F.size(F.filter(tokens, (lambda w: lambda x: x == w)(w))) for w in wanted]
    dot = sum((query.count(w) * c for w, c in zip(wanted, counts)), F.lit(0))
    own = F.aggregate(F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda x: x == t))), F.lit(0).cast("long"), lambda s, c: s + c * c)
    length = sum(query.count(w) ** 2 for w in wanted) ** 0.5
    return F.when((own == 0) | F.lit(length == 0), 0.0).otherwise(dot / (F.sqrt(own) * length))


def min_hashes(tokens: Column, n: int) -> Column:
    """A signature of n: for each i the least MD5 of ``i:token``; null without tokens."""
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(F.array_distinct(tokens), lambda t: F.md5(F.concat(i.cast("string"), F.lit(":"), t).cast("binary"))))))


def agreement(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.least(F.size(a), F.size(b))


def multi_signal(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """(id, score) of rows with the columns of WEIGHTS, each a signal from 0 to 1 or null; a missing column or value takes no part.

    page_rank is the raw rank, ten times of which counts, at most 1. ast_profile: a row that has one (not null) counts AST_PROFILE.
    bm25 is a score of any size; it counts as score / (score + 1). Rows under ``least`` are left out.
    """
    have = {c: F.col(c) for c in WEIGHTS if c in rows.columns}
    if "page_rank" in have:
        have["page_rank"] = F.least(10 * F.col("page_rank"), F.lit(1.0))
        have["page_rank"] = F.when(F.col("page_rank").isNotNull(), have["page_rank"])
    if "ast_profile" in have:
        have["ast_profile"] = F.when(F.col("ast_profile").isNotNull(), AST_PROFILE)
    if "bm25" in have:
        have["bm25"] = F.col("bm25") / (F.col("bm25") + 1)
    score = weighted_mean({c: (v, WEIGHTS[c]) for c, v in have.items()})
    return rows.select("id", score.alias("score")).where(F.col("score") >= least)
