"""Exact dedup of whole texts by a content sort, with Spark's own functions only.

Texts are range-partitioned between sampled splitters by their first bytes and a hash of the whole, and
sorted in each partition by those and then by all bytes, so that equal texts are neighbours; a window
over the sorted rows compares neighbours in full. Sort keys for the splitters have a bounded length
however long the texts are. A text with so many copies that one partition would hold too many (seen in
a sample, whose miss costs balance and not rows) is dealt into parts by doc_id; the parts' heads, a bounded
number, are compared in full once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, n_parts, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES = 64
#: Sampled rows for each partition, and how many of them make a text one of many copies: it has about an eighth of a partition's share.
SAMPLED, MANY = 400, 50
PARTS_A_SHARE = 8


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _many_copies(rows: DataFrame, n: int, total: int) -> DataFrame:
    """tie, parts: hashes of texts with very many copies and how many parts each is dealt into. At most 8 n rows, about 16 n parts."""
    share = max(1, total // (PARTS_A_SHARE * n))
    sampled = min(1.0, SAMPLED * n / max(1, total))
    some = rows.sample(sampled, seed=11) if sampled < 1 else rows
    counts = some.groupBy("tie").agg(F.count("*").alias("seen")).where(f"seen >= {MANY}")
    return counts.select("tie", F.ceil(F.col("seen") / sampled / share).cast("int").alias("parts"))


def content_dedup(docs: DataFrame, keep: str = "smallest", parts: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; keep_id is the smallest (or largest) doc_id
    among equal texts, group_size the number of their rows. A null text is an empty one and equals it. A null doc_id
    is never kept unless all rows of a text have none (keep_id is then null). Of rows that repeat with one doc_id
    and text just one is kept. An empty table gives no rows; other columns of ``docs`` are ignored. ``parts``:
    partitions of the sort, spark.sql.shuffle.partitions if not given.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    n = parts or n_parts(docs.sparkSession)
    best, order = (F.min, F.asc_nulls_last) if keep == "smallest" else (F.max, F.desc_nulls_last)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("tie", F.xxhash64("norm"))
    many = written(_many_copies(rows, n, docs.count()), "many_copies")
    dealt = rows.join(F.broadcast(many), "tie", "left").select(
        "doc_id",
        "norm",
        "tie",
        F.substring(F.col("norm").cast("binary"), 1, PREFIX_BYTES).alias("prefix"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(-1)).cast("int").alias("part"),
    )
    keys = ["prefix", "tie", "part"]
    in_order = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "norm", order("doc_id"))
    same = Window.partitionBy(*keys, "norm")
    copies = in_order.select(
        "doc_id",
        "tie",
        "part",
        best("doc_id").over(same).alias("part_keep"),
        F.count("*").over(same).alias("part_size"),
        F.row_number().over(same.orderBy(order("doc_id"))).alias("copy"),
        "norm",
    )
    found = written(
        copies.select("doc_id", "tie", "part", "part_keep", "part_size", "copy", F.sha2("norm", 256).alias("text_sha256"), F.when(F.expr("part >= 0 and copy = 1"), F.col("norm")).alias("head")),
        "copies",
    )
    dropped(many)
    heads = Window.partitionBy("tie", "head")
    whole = found.where("head is not null").select("tie", "part", "part_keep", "text_sha256", best("part_keep").over(heads).alias("whole_keep"), F.sum("part_size").over(heads).alias("whole_size"))
    f, w = found.alias("f"), F.broadcast(whole).alias("w")
    on = [F.col(f"f.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("tie", "part", "part_keep", "text_sha256")]
    keep_id = F.when(F.col("w.tie").isNull(), F.col("f.part_keep")).otherwise(F.col("w.whole_keep"))
    return f.join(w, on[0] & on[1] & on[2] & on[3], "left").select(
        "f.doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("w.whole_size", "f.part_size").alias("group_size"),
        (F.expr("f.copy = 1") & F.col("f.part_keep").eqNullSafe(keep_id)).alias("kept"),
        "f.text_sha256",
    )
