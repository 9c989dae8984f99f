"""An index of files that follows a stream of their changes.

Each batch writes what it changed as one folder of each table, named by the batch's number, and last the list of files it
changed; a batch counts once that list is there. A batch that is run again, whole or after it was cut off, replaces its own
folders and sees only earlier batches, so it leaves the same tables. A row is current when its batch is the last one that changed its file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import postings

#: Fixed value: a line that defines a symbol.
DEFINES = r"^\s*(?:export\s+)?(?:async\s+)?(function|class|def|interface)\s+(\w+)"


def symbols(files: DataFrame) -> DataFrame:
    """path, label, name, line of the symbols that lines of files (path, text) define."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "code"))
    return lines.where(F.col("code").rlike(DEFINES)).select("path", F.regexp_extract("code", DEFINES, 1).alias("label"), F.regexp_extract("code", DEFINES, 2).alias("name"), (F.col("at") + 1).alias("line"))


def words(files: DataFrame) -> DataFrame:
    """path, term, tf, len: the postings of files (path, text)."""
    return postings(files, "path", "text").withColumnRenamed("id", "path")


@dataclass
class FileIndex:
    """Tables in ``folder``, one for each extractor: a function of files (path, text) that gives rows with their path."""

    spark: SparkSession
    folder: str
    extractors: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=lambda: {"symbols": symbols, "postings": words})

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _exists(self, *parts: str) -> bool:
        path = self._path(*parts)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batches(self, before: int | None = None) -> list[int]:
        """Numbers of the batches that count, before a given one."""
        path = self._path("files")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")] if fs.exists(path) else []
        done = [b for b in found if self._exists("files", f"batch={b}", "_SUCCESS")]
        return sorted(b for b in done if before is None or b < before)

    def _read(self, table: str, batches: list[int]) -> DataFrame | None:
        paths = [f"{self.folder}/{table}/batch={b}" for b in batches]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths) if paths else None

    def versions(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """path, batch, hash (null: removed): the last version of each file, or of the files of ``of`` (path)."""
        log = self._read("files", self._batches(before))
        if log is None:
            return self.spark.createDataFrame([], "path string, batch long, hash string")
        if of is not None:
            log = log.join(of.select("path").distinct(), "path", "left_semi")
        last = log.groupBy("path").agg(F.max_by(F.struct("batch", "hash"), "batch").alias("v"))
        return last.select("path", F.col("v.batch").cast("long").alias("batch"), F.col("v.hash").alias("hash"))

    def apply(self, events: DataFrame, batch: int) -> None:
        """Take in events (path, text (null: removed), at): of each path the latest counts; one whose text is as before is skipped."""
        names = ("at", "text")
        latest = events.groupBy("path").agg(F.max_by(F.struct(*names), F.struct("at", F.col("text").isNotNull(), "text")).alias("r")).select("path", "r.text")
        latest = latest.withColumn("hash", F.sha2("text", 256))
        known = self.versions(batch, latest).select("path", F.col("hash").alias("was"), F.lit(True).alias("had"))
        changed = latest.join(known, "path", "left").where("not hash <=> was or (had is null and hash is not null)").where("had is not null or hash is not null").select("path", "text", "hash")
        staged = f"{self.folder}/staged/batch={batch}"
        changed.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema(changed.schema).parquet(staged)
        for table, extract in self.extractors.items():
            extract(rows.where("hash is not null").select("path", "text")).write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")
        rows.select("path", "hash").write.mode("overwrite").parquet(f"{self.folder}/files/batch={batch}")
        path = self._path("staged", f"batch={batch}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def current(self, table: str) -> DataFrame:
        """The rows of a table that hold now, without the batch's number. Before the first batch: of an empty text."""
        rows = self._read(table, self._batches())
        if rows is None:
            return self.extractors[table](self.spark.createDataFrame([], "path string, text string"))
        live = self.versions().where("hash is not null").select("path", "batch")
        return rows.withColumn("batch", F.col("batch").cast("long")).join(live, ["path", "batch"], "left_semi").drop("batch")

    def compact(self, into: str) -> FileIndex:
        """The current rows as one batch of an index in another folder, numbered as the last batch, so that the stream goes on there."""
        batches = self._batches()
        last = batches[-1] if batches else 0
        for table in self.extractors:
            self.current(table).write.mode("overwrite").parquet(f"{into}/{table}/batch={last}")
        self.versions().where("hash is not null").select("path", "hash").write.mode("overwrite").parquet(f"{into}/files/batch={last}")
        return FileIndex(self.spark, into, self.extractors)

    def follow(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply each micro-batch of a stream of events; ``trigger`` is that of the stream, all that is there at once if not given."""
        out = events.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).start()
