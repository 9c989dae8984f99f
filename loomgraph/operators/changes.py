"""Comparing two states of a table, projects with each other, and versions of what they use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import version
from ..storage import written


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change of two (path, checksum) tables. A new path with the checksum of one that went is a rename of it (the least such path)."""
    both = before.select("path", F.col("checksum").alias("old")).join(after.select("path", F.col("checksum").alias("new")), "path", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    marked = both.withColumn("change", state)
    gone = marked.where("change = 'deleted'").groupBy(F.col("old").alias("new")).agg(F.min("path").alias("from_path"))
    arrived = marked.where("change = 'added'").groupBy("new").agg(F.min("path").alias("path"))
    renamed = arrived.join(gone, "new").select("path", "from_path")
    out = marked.join(renamed, "path", "left").join(renamed.select(F.col("from_path").alias("path"), F.lit(True).alias("left_for")), "path", "left")
    return out.where("left_for is null").select("path", F.when(F.col("from_path").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "from_path")


def contract_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change, severity of two (name, signature, exported) tables."""
    old = before.select("name", F.col("signature").alias("s0"), F.col("exported").alias("e0"), F.lit(1).alias("had"))
    new = after.select("name", F.col("signature").alias("s1"), F.col("exported").alias("e1"), F.lit(1).alias("has"))
    both = old.join(new, "name", "full_outer")
    entry = lambda when, change, severity: F.when(when, F.struct(F.lit(change).alias("change"), severity.alias("severity")))
    kept = F.col("had").isNotNull() & F.col("has").isNotNull()
    found = F.array(
        entry(F.col("has").isNull(), "removed", F.lit("critical")),
        entry(F.col("had").isNull(), "added", F.lit("low")),
        entry(kept & ~F.col("s0").eqNullSafe(F.col("s1")), "signature_changed", F.lit("high")),
        entry(kept & ~F.col("e0").eqNullSafe(F.col("e1")), "visibility_changed", F.when(~F.coalesce("e1", F.lit(False)), F.lit("high")).otherwise(F.lit("medium"))),
    )
    return both.select("name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select("name", "c.change", "c.severity")


def version_matrix(uses: DataFrame) -> DataFrame:
    """package, repos, versions (a map of repo to version) of packages that two or more repos use. uses: repo, package, version."""
    return uses.groupBy("package").agg(F.countDistinct("repo").cast("int").alias("repos"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("repo", "version")))).alias("versions")).where("repos >= 2")


def version_conflicts(uses: DataFrame) -> DataFrame:
    """package, versions, severity, recommended of packages with more than one version."""
    parsed = uses.withColumn("v", version(F.col("version")))
    out = parsed.groupBy("package").agg(
        F.countDistinct("version").alias("versions"), F.countDistinct("v.major").alias("majors"), F.countDistinct("v.major", "v.minor").alias("minors"), F.max(F.struct("v", "version")).alias("best")
    )
    severity = F.when(F.col("majors") > 1, "major").when(F.col("minors") > 1, "minor").otherwise("patch")
    return out.where("versions > 1").select("package", "versions", severity.alias("severity"), F.col("best.version").alias("recommended"))


def upgrade_safety(col: Column, target: str) -> Column:
    """Whether going to ``target`` is neither a step down nor over a major version."""
    now, then = version(col), version(F.lit(target))
    return (then >= now) & (then["major"] == now["major"])


def near_names(a: DataFrame, b: DataFrame, most: int = 2) -> DataFrame:
    """(left, right, distance) of names (name) of two tables at an edit distance of 1 to ``most``.

    Names meet by shared pieces, not all with all: of most + 1 pieces of a name, one is unchanged and
    moves by at most ``most`` places; lengths differ by at most that many.
    """
    pieces = most + 1

    def cut(df: DataFrame, shifts: bool) -> DataFrame:
        n = F.length("name")
        if not shifts:
            starts = [F.floor(n * k / pieces) for k in range(pieces)]
            ends = [F.floor(n * (k + 1) / pieces) for k in range(pieces)]
            keys = F.array(*[F.struct(F.lit(k).alias("k"), n.alias("n"), F.substr(F.col("name"), s + 1, e - s).alias("piece")) for k, (s, e) in enumerate(zip(starts, ends))])
            return df.select(F.col("name").alias("left"), F.explode(keys).alias("key"))
        other = F.sequence(F.greatest(F.lit(0), n - most), n + most)

        def moved(m: Column, k: int) -> Column:
            start, size = F.floor(m * k / pieces), F.floor(m * (k + 1) / pieces) - F.floor(m * k / pieces)
            at = lambda d: F.struct(F.lit(k).alias("k"), m.cast("int").alias("n"), F.substr(F.col("name"), F.greatest(F.lit(0), start + d) + 1, size).alias("piece"))
            return F.transform(F.sequence(F.lit(-most), F.lit(most)), at)

        keys = F.flatten(F.transform(other, lambda m: F.flatten(F.array(*[moved(m, k) for k in range(pieces)]))))
        return df.select(F.col("name").alias("right"), F.explode(F.array_distinct(keys)).alias("key"))

    left, right = a.select("name").where("isnotnull(name)").distinct(), b.select("name").where("isnotnull(name)").distinct()
    pairs = cut(left, False).join(cut(right, True).hint("merge"), "key").select("left", "right").distinct()
    return pairs.withColumn("distance", F.levenshtein("left", "right", most)).where("distance > 0")


#: Names up to this length meet by what is left of them when letters are deleted; longer ones by unchanged pieces.
SHORT_NAME = 24


def _deletions(name: Column, lost: int) -> Column:
    """What is left of a string when ``lost`` of its letters, or all it has, are deleted."""
    def less(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))

    left = F.array(name)
    for _ in range(lost):
        left = F.array_distinct(F.flatten(F.transform(left, lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array(x)))))
    return left


def _gaps(name: Column, gaps: int) -> Column:
    """Array of (at, rest, out) for every choice of one or two places of a string: the places, what is left, and the letters there."""
    n = F.length(name)
    cut = lambda x, i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))
    letter = lambda i: F.substr(name, i, F.lit(1))
    places = F.when(n >= gaps, F.sequence(F.lit(1), n - gaps + 1)).otherwise(F.array().cast("array<int>"))
    if gaps == 1:
        return F.transform(places, lambda i: F.struct(F.array(i).alias("at"), cut(name, i).alias("rest"), F.array(letter(i)).alias("out")))
    two = lambda i, j: F.struct(F.array(i, j).alias("at"), cut(cut(name, j), i).alias("rest"), F.array(letter(i), letter(j)).alias("out"))
    return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i + 1, n), lambda j: two(i, j))))


def _substituted(left: DataFrame, right: DataFrame, gaps: int) -> DataFrame:
    """(left, right, distance) of names of one length that differ in just one or two places: they meet only by those places, so once."""
    def keyed(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col("name").alias(c), F.length("name").alias("n"), F.explode(_gaps(F.col("name"), gaps)).alias("g")).select(c, "n", "g.at", "g.rest", F.col("g.out").alias(f"{c}_out"))

    pairs = keyed(left, "left").join(keyed(right, "right").hint("merge"), ["n", "at", "rest"])
    for k in range(gaps):
        pairs = pairs.where(F.col("left_out")[k] != F.col("right_out")[k])
    return pairs.select("left", "right", F.lit(gaps).cast("int").alias("distance"))


def near_names_by_deletion(a: DataFrame, b: DataFrame, most: int = 2) -> DataFrame:
    """(left, right, distance) of distinct names (name) of two tables at an edit distance of 1 to ``most``: the result of ``near_names``.

    Names of one length that differ in one or two places meet by the other places, once for each pair. Of all others the longer one
    and the shorter one have a common rest when they lose ``most`` letters and as many less as they differ in length; those of one length
    one letter less, since a letter is both put in and left out. A rest is a key of its own, so no length or
    piece that many names share gathers them. Names longer than SHORT_NAME, whose rests would be too many, meet by pieces.
    """
    left, right = a.select("name").where("isnotnull(name)").distinct(), b.select("name").where("isnotnull(name)").distinct()
    brief = lambda df: df.where(F.length("name") <= SHORT_NAME)
    n = F.length("name")

    def rests(df: DataFrame, c: str, lost: int, longer: int = 0) -> DataFrame:
        return brief(df).select(F.col("name").alias(c), (n + longer).alias("n"), F.explode(_deletions(F.col("name"), lost)).alias("rest"))

    short = None
    for gaps in range(1, min(most, 2) + 1):
        part = _substituted(brief(left), brief(right), gaps)
        short = part if short is None else short.unionByName(part)
    other = rests(left, "left", most - 1).join(rests(right, "right", most - 1).hint("merge"), ["n", "rest"])
    apart = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("left", i, F.lit(1)) != F.substr("right", i, F.lit(1)))
    met = [other.where("left <> right").where(F.size(apart) > min(most, 2)).select("left", "right")]
    for by in range(1, most + 1):
        for one, two, x, y in ((left, right, "left", "right"), (right, left, "right", "left")):
            met.append(rests(one, x, most).join(rests(two, y, most - by, by).hint("merge"), ["n", "rest"]).select("left", "right"))
    pairs = reduce(DataFrame.unionByName, met).withColumn("distance", F.levenshtein("left", "right", most)).where("distance > 0")
    short = short.unionByName(pairs.distinct())
    tail = lambda df: df.where(F.length("name") > SHORT_NAME - most)
    long = near_names(tail(left), tail(right), most).where(F.greatest(F.length("left"), F.length("right")) > SHORT_NAME)
    return short.unionByName(long)


def match_symbols(symbols: DataFrame, most: int = 2) -> DataFrame:
    """source_repo, source, target_repo, target, rule, confidence of exported symbols of two repos (the first by name): the first rule that holds.

    symbols: repo, name, qname, route. exact_name (1.0): equal names; similar_name (0.7): lower-case names at an edit distance up
    to ``most``; api_pattern (0.85): equal routes. Symbols without a name match by no rule but the route.
    """
    rows = symbols.select("repo", "name", "qname", "route").distinct()
    end = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    lower = rows.withColumn("low", F.lower("name"))
    names = written(lower.select(F.col("low").alias("name")).distinct(), "names")
    pairs = near_names_by_deletion(names, names, most).select(F.col("left").alias("a_low"), F.col("right").alias("b_low"))
    a, b = end(lower, "a"), end(lower, "b")
    exact = a.join(b, F.col("a_name") == F.col("b_name")).withColumn("rule", F.lit("exact_name"))
    # Names that differ in case only are similar too, at distance 0.
    cased = a.join(b, F.col("a_low") == F.col("b_low")).where("a_name <> b_name").withColumn("rule", F.lit("similar_name"))
    similar = pairs.join(a, "a_low").join(b, "b_low").withColumn("rule", F.lit("similar_name"))
    far = F.col("a_low").isNull() | F.col("b_low").isNull() | (F.levenshtein("a_low", "b_low") > most)
    routed = a.join(b, F.col("a_route") == F.col("b_route")).where("a_route <> ''").where(far).withColumn("rule", F.lit("api_pattern"))
    every = exact.unionByName(cased).unionByName(similar).unionByName(routed).where("a_repo < b_repo")
    confidence = F.when(F.col("rule") == "exact_name", 1.0).when(F.col("rule") == "similar_name", 0.7).otherwise(0.85)
    return every.select(F.col("a_repo").alias("source_repo"), F.col("a_qname").alias("source"), F.col("b_repo").alias("target_repo"), F.col("b_qname").alias("target"), "rule", confidence.alias("confidence"))


def cross_edges(edges: DataFrame, repo_of: DataFrame) -> DataFrame:
    """Edges between repos: src_repo, dst_repo, type, n. repo_of: id, repo."""
    a, b = repo_of.select(F.col("id").alias("src"), F.col("repo").alias("src_repo")), repo_of.select(F.col("id").alias("dst"), F.col("repo").alias("dst_repo"))
    return edges.join(a, "src").join(b, "dst").where("src_repo <> dst_repo").groupBy("src_repo", "dst_repo", "type").agg(F.count("*").alias("n"))


def coupling(cross: DataFrame, repos: int) -> DataFrame:
    """repo, fan_in, fan_out, coupling = (in + out) / (2 repos - 2)."""
    fan_out = cross.groupBy(F.col("src_repo").alias("repo")).agg(F.countDistinct("dst_repo").alias("fan_out"))
    fan_in = cross.groupBy(F.col("dst_repo").alias("repo")).agg(F.countDistinct("src_repo").alias("fan_in"))
    both = fan_out.join(fan_in, "repo", "full_outer").select("repo", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.withColumn("coupling", F.round((F.col("fan_in") + F.col("fan_out")) / (2 * repos - 2), 3))
