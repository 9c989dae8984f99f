"""Ranked retrieval: weighted field matches, BM25, vectors, rank fusion."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, search_tokens
from ..storage import dropped, shared_dir, written


def field_search(rows: DataFrame, terms: list[str], weights: dict[str, float], id_col: str = "id") -> DataFrame:
    """(id, score): the best field weight of each term found, and 3 for each term found at all; rows without a hit are left out."""
    score, hits = F.lit(0.0), F.lit(0)
    for t in terms:
        found = [F.when(F.coalesce(F.lower(F.col(c)).contains(t.lower()), F.lit(False)), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items()]
        best = F.greatest(*found) if len(found) > 1 else found[0]
        score, hits = score + best, hits + F.when(best > 0, 1).otherwise(0)
    return rows.select(F.col(id_col).alias("id"), (score + 3 * hits).alias("score")).where("score > 0")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len)."""
    words = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text_col)).alias("t"))
    flat = words.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return flat.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def _equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with a query term; a repeated query term counts each time.

    Scans all texts, twice; for more than one query write an index (``build_index``) and ask that.
    """
    wanted = sorted(set(query))
    words = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text_col)).alias("t"))
    counted = words.select("id", F.size("t").alias("len"), *[F.size(F.filter("t", _equals(w))).alias(f"tf{i}") for i, w in enumerate(wanted)])
    facts = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        score = score + query.count(w) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # The facts are one row.
    return counted.crossJoin(F.broadcast(facts)).select("id", score.alias("score")).where("score > 0")


#: Postings of a bucket, about, from which the number of buckets follows.
BUCKET_ROWS = 2_000_000
MOST_BUCKETS = 1 << 16
#: Two characters pick a bucket's group and all of a term its place in the group, so a prefix of two characters is one group.
GROUPS = 32


def _group(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, 2).cast("binary")) % GROUPS).cast("int")


def _bucket(term: Column, parts: int) -> Column:
    return (_group(term) * parts + F.pmod(F.xxhash64(term), F.lit(parts))).cast("int")


def files_state(rows: DataFrame) -> str:
    """The names, sizes and times of the files that a table read from a folder has now, as one string."""
    spark, state = rows.sparkSession, []
    for name in sorted(rows.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        state.append(f"{name} {found.getLen()} {found.getModificationTime()}")
    return "\n".join(state)


@dataclass(frozen=True)
class Index:
    """An inverted index in a folder: postings (bucket, term, id, tf, len) in a folder for each bucket, sorted by term, and the documents' lengths.

    parts: buckets in each group of terms, as many as the postings called for when it was built.
    """

    folder: str
    parts: int = 1

    def postings(self, spark, terms: list[str], prefixes: bool = False) -> DataFrame:
        """The postings in the buckets of the terms, or in the groups of prefixes of at least two characters; others are not read."""
        rows = spark.read.parquet(f"{self.folder}/postings")
        probe = spark.range(1).select(*[(_group(F.lit(t)) if prefixes else _bucket(F.lit(t), self.parts)).alias(f"b{k}") for k, t in enumerate(terms)]).first()
        wanted = {b for g in set(probe) for b in range(g * self.parts, (g + 1) * self.parts)} if prefixes else set(probe)
        return rows.where(F.col("bucket").isin(sorted(wanted)))

    def facts(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/lengths").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def _write_postings(rows: DataFrame, folder: str) -> None:
    """Buckets are spread over tasks by id too, so that a frequent term is no one task's work."""
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "term", "id").write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> Index:
    """Write the index of all rows. parts: buckets in each group; by the total length of the documents if not given."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/index"
    words = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text_col)).alias("t"))
    words.select("id", F.size("t").alias("len")).write.parquet(f"{folder}/lengths")
    total = spark.read.parquet(f"{folder}/lengths").agg(F.sum("len")).first()[0] or 0
    parts = parts or max(1, min(MOST_BUCKETS // GROUPS, -(-total // (GROUPS * BUCKET_ROWS))))
    _write_postings(postings(docs, id_col, text_col).withColumn("bucket", _bucket(F.col("term"), parts)), folder)
    return Index(folder, parts)


def refresh_index(index: Index, changed: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index without the documents ``removed`` (id) and with those of ``changed`` in place of what they were, as a new index.

    Only the buckets with a term of such a document, before or after, are read and written anew; the files of the others are copied as they are.
    """
    spark = changed.sparkSession
    gone = written(removed.select("id").unionByName(changed.select(F.col(id_col).alias("id"))).distinct(), "gone")
    folder = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/index"
    words = changed.select(F.col(id_col).alias("id"), F.size(search_tokens(F.col(text_col))).alias("len"))
    spark.read.parquet(f"{index.folder}/lengths").join(gone, "id", "left_anti").unionByName(words).write.parquet(f"{folder}/lengths")
    fresh = written(postings(changed, id_col, text_col).withColumn("bucket", _bucket(F.col("term"), index.parts)), "fresh")
    old = spark.read.parquet(f"{index.folder}/postings")
    touched = {r["bucket"] for r in old.join(gone, "id", "left_semi").select("bucket").union(fresh.select("bucket")).distinct().collect()}  # bucket numbers
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    source, target = fs_path(f"{index.folder}/postings"), fs_path(f"{folder}/postings")
    fs = source.getFileSystem(conf)
    fs.mkdirs(target)
    for part in fs.listStatus(source):
        name = part.getPath().getName()
        if name.startswith("bucket=") and int(name.removeprefix("bucket=")) not in touched:
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part.getPath(), fs, fs_path(f"{folder}/postings/{name}"), False, conf)
    rows = old.where(F.col("bucket").isin(sorted(touched))).join(gone, "id", "left_anti").unionByName(fresh)
    _write_postings(rows, folder)
    dropped(gone, fresh)
    return Index(folder, index.parts)


def index_search(spark, index: Index, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) as ``bm25`` has it, from the postings of the query's terms alone."""
    counts = F.create_map(*[x for t in sorted(set(query)) for x in (F.lit(t), F.lit(query.count(t)))])
    rows = index.postings(spark, sorted(set(query))).where(F.col("term").isin(sorted(set(query))))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # at most one row for each term of the query
    rows = rows.join(F.broadcast(df), "term").crossJoin(F.broadcast(index.facts(spark)))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = counts[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy("id").agg(F.sum(part).alias("score"))


def prefix_search(spark, index: Index, prefixes: list[str]) -> DataFrame:
    """(id, hits) of documents with a term for each of the prefixes (two characters or more); hits counts such terms' occurrences."""
    rows = index.postings(spark, prefixes, prefixes=True)
    which = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(k)) for k, p in enumerate(prefixes)]))
    found = rows.select("id", "tf", F.explode(which).alias("k")).groupBy("id").agg(F.sum("tf").alias("hits"), F.count_distinct("k").alias("k"))
    return found.where(F.col("k") == len(prefixes)).select("id", "hits")


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.0) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("score")).where(F.col("score") > least), k)


def ranked(scored: DataFrame) -> DataFrame:
    """A top list with its places; the list is bounded, so one window holds it."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of bounded top lists: the sum of weight / (k + rank)."""
    out = None
    for scored, weight in lists:
        part = ranked(scored).select("id", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def weighted_mean(signals: dict[str, tuple[Column, float]]) -> Column:
    """The mean of the signals there are, by weight."""
    total = weight = F.lit(0.0)
    for col, w in signals.values():
        total = total + F.coalesce(col * w, F.lit(0.0))
        weight = weight + F.when(col.isNull(), F.lit(0.0)).otherwise(F.lit(w))
    return F.when(weight == 0, F.lit(0.0)).otherwise(total / weight)


def hashed_embedding(docs: DataFrame, dim: int = 768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bucket, value): character 3-grams hashed into signed buckets, of unit length."""
    padded = F.concat(F.lit("  "), F.lower(F.col(text_col)), F.lit("  "))
    # Characters as an array: a place in a long string is found by counting from its start.
    letters = docs.select(F.col(id_col).alias("id"), F.split(padded, "").alias("c")).where(F.size("c") > 2)
    grams = letters.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 3), lambda i: F.concat(F.get("c", i), F.get("c", i + 1), F.get("c", i + 2)))).alias("g"))
    h = F.xxhash64("g")
    sums = grams.select("id", F.pmod(h, F.lit(dim)).alias("bucket"), F.when(F.pmod(F.shiftrightunsigned(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")).groupBy("id", "bucket").agg(F.sum("sign").alias("value"))
    norm = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return sums.join(norm.where("norm > 0"), "id").select("id", "bucket", (F.col("value") / F.col("norm")).alias("value"))


def embed_missing(docs: DataFrame, stored: DataFrame, dim: int = 768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashed embeddings (id, bucket, value) of the documents that ``stored`` (id, ...) has none of; the others are not read into features."""
    return hashed_embedding(docs.join(stored.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti"), dim, id_col, text_col)
