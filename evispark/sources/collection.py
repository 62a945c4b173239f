"""A collection of embedded chunks: a Parquet folder with upserts by chunk id."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import fits
from ..session import checkpointed


# Error classes of Spark for a folder that is not there or holds no file yet ...
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
# ... and for files that are there but are no readable Parquet.
DAMAGED = ("CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "FAILED_READ_FILE")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none.  Any other failure is an error:
    a table that cannot be read right now must not be taken for an empty one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if any(m in str(problem) for m in MISSING):
            return None
        raise


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Reuse a stage's table; build and write it if it is missing, damaged, or on ``force``."""
    if not force:
        try:
            found = read_if_present(spark, path)
            if found is not None:
                found.limit(1).count()
                return found
        except Exception as problem:
            if not any(m in str(problem) for m in DAMAGED):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


CONTROL = ["c_writer", "c_batch"]
ORDER = ["c_at", "c_row"]     # when the batch was first written, and the row's place in it


class Collection:
    """Plain batches, partitioned by writer and batch number; reading keeps the newest row per id.

    An append is a writer of its own, a stream is one writer with its epochs as batches.  Writing a batch again overwrites only that
    batch and keeps its time, so a replay adds nothing, and writers never touch each other's rows.  Within a batch, the
    later row of an id wins; of batches with one time, the one of the greater writer name.  No state is kept but the rows.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "guidelines"):
        self.spark, self.path, self.name = spark, path, name

    def append(self, chunks: DataFrame, batch: int = 0, writer: str | None = None) -> dict[str, int]:
        """Write one batch, of a new writer unless one is named; the counts are observed while it is written."""
        before, at = None, time.time_ns()
        if writer is not None:
            raw = read_if_present(self.spark, self.path)
            before = None if raw is None else raw.where((F.col("c_writer") == writer) & (F.col("c_batch") == batch)).select("c_at").first()
        return self._write(chunks, before[0] if before else at, batch, writer or f"append-{uuid.uuid4().hex}", "dynamic")

    def _write(self, chunks: DataFrame, at: int, batch: int, writer: str, overwrite: str) -> dict[str, int]:
        seen = Observation()
        flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int"))
        observed = chunks.observe(seen, F.count(F.lit(1)).alias("added"), flag("is_urgent").alias("urgent"),
                                  flag("has_recommendation").alias("recommendations"))
        (observed.withColumns({"c_row": F.monotonically_increasing_id(), "c_at": F.lit(at).cast("long"), "c_writer": F.lit(writer),
                               "c_batch": F.lit(batch).cast("long")}).write.mode("overwrite")
         .option("partitionOverwriteMode", overwrite).partitionBy(*CONTROL).parquet(self.path))
        return {k: v or 0 for k, v in seen.get.items()}

    def read(self) -> DataFrame | None:
        """Newest row per chunk id.

        Only ids that are there more than once take part in a join, on narrow rows; conditions on the result reach the scan.
        """
        raw = read_if_present(self.spark, self.path)
        if raw is None:
            return None
        place = F.struct("c_at", "c_writer", "c_row")
        again = checkpointed(raw.groupBy("chunk_id").agg(F.max(place).alias("c_newest"), F.count(F.lit(1)).alias("c_n")).where(
            "c_n > 1").select(F.col("chunk_id").alias("c_id"), "c_newest"))
        if again.isEmpty():
            return raw.drop(*ORDER, *CONTROL)
        rows = raw.join(F.broadcast(again) if fits(again) else again, F.col("chunk_id") == F.col("c_id"), "left")
        return rows.where(F.col("c_newest").isNull() | (place == F.col("c_newest"))).drop("c_id", "c_newest", *ORDER, *CONTROL)

    def count(self) -> int:
        raw = read_if_present(self.spark, self.path)
        return 0 if raw is None else raw.agg(F.count_distinct("chunk_id")).first()[0]

    def ingest(self, chunks: DataFrame, force: bool = False) -> dict[str, int]:
        """Write only into an empty collection, unless forced; forced, it is overwritten (by rows that are not read from it)."""
        raw = read_if_present(self.spark, self.path)
        full = raw is not None and not raw.isEmpty()
        if full and not force:
            return {"added": 0, "urgent": 0, "recommendations": 0}
        return self._write(chunks, time.time_ns(), 0, f"append-{uuid.uuid4().hex}", "static")

    def clear(self) -> None:
        """Drop all rows, keep the table: one empty batch holds its schema."""
        raw = read_if_present(self.spark, self.path)
        if raw is None:
            return
        empty = self.spark.createDataFrame([], raw.drop(*CONTROL).schema)
        self.reset()
        empty.write.parquet(f"{self.path}/c_writer=none/c_batch=0")

    def reset(self) -> None:
        """Drop the table."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
