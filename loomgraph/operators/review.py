"""Review comments: similar ones merged in order, and lines found again in a new text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, written
from . import intervals

#: Severities from the most severe on.
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def words(text: Column) -> Column:
    """The distinct lower-case words between white space; a null text is an empty one, which is one empty word."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1))


def word_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_comments(comments: DataFrame, above: float = 0.7) -> DataFrame:
    """(a, b): ids, a < b, of comments (id, path, start, end, w: word sets) of one path that share a line and are alike by more than ``above``.

    Two such sets share one of the first n - ceil(above n) + 1 of their words in any order; here long words come first,
    so that common ones are seldom keys. Only comments of a path with such a word in common are compared.
    """
    n = F.size("w")
    rare_first = F.transform(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x["x"])
    keyed = comments.withColumn("word", F.explode(F.slice(rare_first, 1, (n - F.ceil(n * above) + 1).cast("int")))).select("path", "word", "id", "start", "end", "w")
    pairs = intervals.overlaps(keyed, keyed, ["path", "word"]).where("id < r_id")
    return pairs.where(word_jaccard(F.col("w"), F.col("r_w")) > above).select(F.col("id").alias("a"), F.col("r_id").alias("b")).distinct()


def first_seeds(links: DataFrame, most: int = 1000) -> DataFrame:
    """(id, seed) of taken ids: in order of id, each that is not taken yet becomes a seed and takes all later ones it is linked with (a < b).

    By rounds: an id without an earlier open neighbour is a seed. What it takes is closed, and so are their links.
    Ids that no row holds are seeds. Similarity need not be transitive: what is linked with a taken id only is not taken by it.
    """
    every = open_ = written(links.select("a", "b"), "links")
    taken = None
    for _ in range(most):
        if open_.isEmpty():
            break
        seeds = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = written(open_.join(seeds, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "taken")
        taken = now if taken is None else taken.unionByName(now)
        gone = now.select(F.col("id").alias("b"))
        rest = open_.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti")
        last, open_ = open_, written(rest, "links")
        if last is not every:
            dropped(last)
    else:
        raise RuntimeError(f"seeds did not settle in {most} rounds")
    if taken is None:
        return every.select(F.col("b").alias("id"), F.col("a").alias("seed")).where("false")
    by_seed = every.join(taken.select(F.col("id").alias("a")), "a", "left_anti")
    return by_seed.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("seed"))


def merge_similar(comments: DataFrame, above: float = 0.7) -> DataFrame:
    """One row for each group of similar comments: seed, id (the most severe, then the first), path, start, end, severity, content, merged.

    comments: id (unique), path, start, end, severity, content. In order of id a comment that none has taken takes all later ones
    of its path that share a line with it and whose words are alike by more than ``above`` (Jaccard). start and end span the
    group, merged is its size, content joins the contents in order. A comment without lines or path stays alone. Equal comments
    on equal lines act as one, so they are not paired.
    """
    rows = comments.withColumn("w", F.array_sort(words(F.col("content"))))
    like = ["path", "start", "end", "w"]
    same = written(rows.groupBy(*like).agg(F.min("id").alias("first")), "same")
    seeds = written(first_seeds(similar_comments(same.withColumnRenamed("first", "id"), above)), "seeds")
    lone = F.col("path").isNull() | F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("end"))
    null_safe = [rows[c].eqNullSafe(same[c]) for c in like]
    of = rows.join(same.hint("merge"), null_safe[0] & null_safe[1] & null_safe[2] & null_safe[3]).select(rows["id"], rows["path"], rows["start"], rows["end"], "severity", "content", "first")
    of = of.join(seeds.withColumnRenamed("id", "first").hint("merge"), "first", "left").withColumn("seed", F.when(lone, F.col("id")).otherwise(F.coalesce("seed", "first")))
    severity = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.lit(99))
    top = F.min(F.struct(severity.alias("rank"), "id", "severity", "path")).alias("top")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "; ")
    out = of.groupBy("seed").agg(top, F.min("start").alias("start"), F.max("end").alias("end"), text.alias("content"), F.count("*").alias("merged"))
    return out.select("seed", "top.id", "top.path", "start", "end", "top.severity", "content", "merged")


# ---- lines found again


def _rising(pairs: DataFrame) -> DataFrame:
    """Of (path, gap, old, new) the pairs of a longest run of each gap that rises in both; a group holds two numbers for each unique line of one file."""
    from bisect import bisect_left

    import pandas as pd

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("old").reset_index(drop=True)
        ends, at, before = [], [], []
        for i, new in enumerate(rows["new"]):
            k = bisect_left(ends, new)
            ends[k : k + 1], at[k : k + 1] = [new], [i]
            before.append(at[k - 1] if k else -1)
        kept, i = [], at[-1] if at else -1
        while i >= 0:
            kept.append(i)
            i = before[i]
        return rows.loc[sorted(kept), ["path", "old", "new"]]

    return pairs.groupBy("path", "gap").applyInPandas(longest, "path string, old long, new long")


def _gaps(lines: DataFrame, anchors: DataFrame, side: str) -> DataFrame:
    """lines (path, line, text) with the anchors before and after: o0, n0, o1, n1 (old and new line numbers)."""
    marks = anchors.select("path", F.col(side).alias("line"), F.lit(None).cast("string").alias("text"), F.struct("old", "new").alias("a"))
    rows = lines.select("path", "line", "text", F.lit(None).cast("struct<old:bigint,new:bigint>").alias("a")).unionByName(marks)
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("p", F.last("a", ignorenulls=True).over(by)).withColumn("q", F.first("a", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    return rows.where("a is null").select("path", "line", "text", F.col("p.old").alias("o0"), F.col("p.new").alias("n0"), F.col("q.old").alias("o1"), F.col("q.new").alias("n1"))


def align_lines(old: DataFrame, new: DataFrame, rounds: int = 3) -> DataFrame:
    """(path, old, new): which line of the old text is which of the new. old and new: path, line (from 1), text, of the same paths.

    Anchors are lines that are unique in both texts and lie on a longest rising run; in the gaps between anchors the same is done again
    for lines that are unique there, ``rounds`` times at most. Then equal lines next to an anchor, or to a line found so, follow
    downwards, and the rest upwards. Nothing that is found crosses anything else. The start and the end of a file are anchors.
    """
    old, new = (x.select("path", F.col("line").cast("long").alias("line"), F.coalesce("text", F.lit("")).alias("text")) for x in (old, new))
    size = lambda x, name: x.groupBy("path").agg((F.max("line") + 1).alias(name))
    ends = size(old, "old").join(size(new, "new"), "path")
    both = ends.select("path")
    old, new = written(old.join(both, "path", "left_semi"), "old"), written(new.join(both, "path", "left_semi"), "new")
    anchors = written(ends.select("path", F.lit(0).cast("long").alias("old"), F.lit(0).cast("long").alias("new")).unionByName(ends), "anchors")
    for _ in range(rounds):
        left = _gaps(old.join(anchors.select("path", F.col("old").alias("line")), ["path", "line"], "left_anti"), anchors, "old")
        right = _gaps(new.join(anchors.select("path", F.col("new").alias("line")), ["path", "line"], "left_anti"), anchors, "new")
        once = lambda rows, name: rows.groupBy("path", F.col("o0").alias("gap"), "text").agg(F.count("*").alias("c"), F.min("line").alias(name)).where("c = 1").drop("c")
        found = written(_rising(once(left, "old").join(once(right, "new"), ["path", "gap", "text"]).select("path", "gap", "old", "new")), "found")
        if found.isEmpty():
            break
        anchors = written(anchors.unionByName(found), "anchors")
    left = _gaps(old.join(anchors.select("path", F.col("old").alias("line")), ["path", "line"], "left_anti"), anchors, "old")
    target = new.select("path", F.col("line").alias("to"), F.col("text").alias("to_text"))
    down = left.withColumn("to", F.col("n0") + F.col("line") - F.col("o0")).join(target, ["path", "to"], "left")
    same = F.coalesce((F.col("text") == F.col("to_text")) & (F.col("to") < F.col("n1")), F.lit(False))
    gap = Window.partitionBy("path", "o0")
    down = down.withColumn("ok", F.min(F.when(same, 1).otherwise(0)).over(gap.orderBy("line"))).withColumn("taken", F.sum("ok").over(gap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    up = down.drop("to_text").withColumn("back", F.col("n1") - (F.col("o1") - F.col("line"))).join(target.withColumnRenamed("to", "back"), ["path", "back"], "left")
    # Upwards only past what came down from above.
    free = F.coalesce((F.col("text") == F.col("to_text")) & (F.col("back") > F.col("n0") + F.col("taken")) & (F.col("ok") == 0), F.lit(False))
    up = up.withColumn("risen", F.min(F.when(free, 1).otherwise(0)).over(gap.orderBy(F.desc("line"))))
    placed = up.withColumn("new", F.when(F.col("ok") == 1, F.col("to")).when(F.col("risen") == 1, F.col("back"))).where("new is not null")
    inner = anchors.join(ends.withColumnRenamed("old", "last").withColumnRenamed("new", "new_last"), "path").where("old > 0 and old < last")
    return placed.select("path", F.col("line").alias("old"), "new").unionByName(inner.select("path", "old", "new"))


def tokens(text: Column) -> Column:
    """The distinct words of letters, digits and ``_`` of two characters or more."""
    return F.array_distinct(F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda x: F.length(x) > 1))


def relocate(comments: DataFrame, old: DataFrame, new: DataFrame, least: float = 0.3, sure: float = 0.6) -> DataFrame:
    """id, new_line, confidence of comments (id, path, line): where their lines of the old text stand in the new one.

    high: the line is aligned (``align_lines``). Else, of the new lines between the aligned lines around it, the one that shares the largest
    part of the old line's tokens (ties: the first): medium from ``sure`` on, low from ``least`` on. Else, or when the file is gone: lost
    (new_line null).
    """
    pairs = written(align_lines(old, new), "pairs")
    at = comments.select("id", "path", F.col("line").cast("long").alias("old"))
    exact = written(at.join(pairs, ["path", "old"], "left"), "exact")
    rest = exact.where("new is null").select("id", "path", F.col("old").alias("line")).join(old.select("path", F.col("line").cast("long").alias("line"), "text"), ["path", "line"])
    ends = new.groupBy("path").agg((F.max("line") + 1).alias("new"), F.lit(1 << 40).cast("long").alias("old"))
    marks = pairs.select("path", "old", "new").unionByName(ends.select("path", "old", "new")).unionByName(ends.select("path", F.lit(0).cast("long").alias("old"), F.lit(0).cast("long").alias("new")))
    keyed = _gaps(rest.select("path", "line", F.to_json(F.struct("id", "text")).alias("text")), marks, "old")
    asked = keyed.withColumn("x", F.from_json("text", "id long, text string")).select("path", F.col("x.id").alias("id"), tokens(F.col("x.text")).alias("want"), (F.col("n0") + 1).alias("start"), (F.col("n1") - 1).alias("end"))
    place = new.select("path", F.col("line").cast("long").alias("to"), tokens(F.coalesce("text", F.lit(""))).alias("have"))
    near = intervals.stab(place, asked.where(F.size("want") > 0), ["path"], "to").withColumn("share", F.size(F.array_intersect("want", "have")) / F.size("want"))
    best = near.where(F.col("share") >= least).groupBy("id").agg(F.max(F.struct("share", (-F.col("to")).alias("back"))).alias("m"))
    out = exact.join(best, "id", "left")
    line = F.coalesce("new", -F.col("m.back"))
    sureness = F.when(F.col("new").isNotNull(), "high").when(F.col("m.share") >= sure, "medium").when(F.col("m").isNotNull(), "low").otherwise("lost")
    return out.select("id", line.alias("new_line"), sureness.alias("confidence"))
