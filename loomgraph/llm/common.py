"""Shared folders, written tables and partition counts for the training-data operators."""

from __future__ import annotations

import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, written

__all__ = ["about_words", "dropped", "n_parts", "new_path", "released", "shared_dir", "written"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/{name}"


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def about_words(docs: DataFrame) -> float:
    """A rough count of the words of all texts, to size sketches by."""
    return (docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) / 6.0


def released(*values: Broadcast) -> None:
    """Take broadcast values from the executors; a task that is run again fetches them anew."""
    for v in values:
        v.unpersist()
