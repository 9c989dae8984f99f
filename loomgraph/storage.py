"""Tables written between the steps of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_recorders: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none (tests), a temporary folder is made once and set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    folder = f"{shared_dir(df.sparkSession)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.__dict__["_folder"] = folder
    for recorder in _recorders:
        recorder.append(folder)
    return out


def delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and that no later step reads."""
    for t in tables:
        folder = t.__dict__.pop("_folder", None) if t is not None else None
        if folder:
            delete(t.sparkSession, [folder])


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``written`` makes meanwhile."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)
