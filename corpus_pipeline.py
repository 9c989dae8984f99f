"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before it kept, and returns a
DataFrame. All but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.line_dedup import line_dedup
from loomgraph.llm.ngram_join import ngram_join
from loomgraph.llm.packing import pack
from loomgraph.llm.substring_dedup import substring_dedup
from loomgraph.llm.toxicity import toxicity_filter
from loomgraph.storage import delete, recorded, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stage's own contract; the defaults of ngram_join are those of op3 (three words, 90 %).
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


#: Folders of the tables that the stage before wrote on its way.
_made: list[str] = []


def _stage(f):
    """A stage's own tables go when the next stage begins, since its result has then been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f is not drop_toxic.__wrapped__:
            delete(spark, _made)
        _made.clear()
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run_stage


def _with_text(kept: DataFrame) -> DataFrame:
    """The documents with ``kept`` as their text; n_chars follows the text."""
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic; all others stay as they are."""
    return toxicity_filter(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier line of the corpus."""
    return _with_text(line_dedup(docs, carry=("lang", "source")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that links of five-word shingles, Jaccard 0.8, connect."""
    copies = ngram_join(docs, n=SHINGLE_WORDS, percent=SHINGLE_PERCENT).where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


@_stage
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 50 words or more that an earlier document has."""
    return _with_text(substring_dedup(docs, carry=("lang", "source")))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the exact ones can be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
