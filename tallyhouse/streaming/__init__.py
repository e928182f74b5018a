"""Structured Streaming operators (R-01 to R-03).

Arrival order stands in for file order, and rows later than the watermark are
dropped; a batch run over all files keeps them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import digest

#: The epoch is a Thursday: Monday weeks start four days later.
WEEK = ("7 days", "7 days", "4 days")


def read_stream(spark: SparkSession, folder: str, schema: str, names: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, by name, with a declared schema."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicate(payments: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """R-02: the first arrival of each key within the watermark."""
    return payments.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def weekly_kpis(orders: DataFrame, delay: str = "7 days") -> DataFrame:
    """R-03: revenue and orders per store and ISO week.

    In append mode a week is told once, when the watermark has passed its end,
    and then leaves the state; in complete mode all weeks stay.
    """
    windowed = orders.withWatermark("created_at", delay).groupBy(F.window("created_at", *WEEK), "store_id")
    return windowed.agg(F.sum("subtotal").alias("revenue"), F.count(F.lit(1)).alias("orders")).select(
        "store_id", F.col("window.start").cast("date").alias("period_start"), F.col("revenue").cast("double").alias("revenue"), "orders"
    )


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """R-01: one idempotent write per micro-batch, keyed by the batch number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to Parquet files; waits for the end."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(stream: DataFrame, target: str, checkpoint: str) -> None:
    """An aggregate over all that is there now; each batch replaces the whole result."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


_SEALED = "fingerprint string, batch_id long, attempt string, rows long, sealed_at timestamp"


def sealing_writer(root: str) -> Callable[[DataFrame, int], None]:
    """A writer for :func:`ingest` and :func:`run_sealed`: one sealed snapshot per batch, under its input fingerprint (L-02).

    A batch is written to a folder of its own attempt, fingerprinted from what
    was written, and sealed by a row of the manifest. Inputs that are sealed
    already seal nothing, whichever batch number or checkpoint they come with,
    so a replay or a restart changes nothing, and a reader sees whole batches.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark, attempt = df.sparkSession, uuid.uuid4().hex
        df.write.parquet(f"{root}/data/attempt={attempt}")
        back = spark.read.schema(df.schema).parquet(f"{root}/data/attempt={attempt}")
        found = digest(back).first()
        mark = hashlib.sha256(f"{found.rows}|{found.checksum}|{df.schema.simpleString()}".encode()).hexdigest()
        if found.rows and sealed(spark, root).filter(F.col("fingerprint") == mark).limit(1).count() == 0:
            row = spark.createDataFrame([(mark, batch, attempt, found.rows)], "fingerprint string, batch_id long, attempt string, rows long")
            row.withColumn("sealed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")

    return write


def sealed(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: a row for each sealed batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _SEALED)
    return spark.read.schema(_SEALED).parquet(f"{root}/manifest")


def read_sealed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all sealed batches; what a crashed attempt left behind is not read."""
    first = sealed(spark, root).groupBy("fingerprint").agg(F.min(F.struct("sealed_at", "attempt"))["attempt"].alias("attempt"))
    rows = spark.read.schema(f"{schema}, attempt string").parquet(f"{root}/data")
    return rows.join(first.select("attempt"), "attempt", "left_semi").drop("attempt")


def run_sealed(stream: DataFrame, root: str, checkpoint: str):
    """All that is there now, in append mode, to sealed batches; returns the ended query."""
    query = stream.writeStream.outputMode("append").foreachBatch(sealing_writer(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batch_writer(root: str) -> Callable[[DataFrame, int], None]:
    """A writer for :func:`ingest`: a replayed batch replaces its own files."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/batch_id={batch}")

    return write
