"""Immutable snapshots: Parquet by store, sealed by a manifest written last (S-09 to S-11)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMAS, StoreTables

#: Stores whose files a task has open at once.
OPEN_STORES = 16
_SEAL = "snapshot_id string, attempt string, fingerprint string, table string, store_id string, rows long, checksum decimal(38,0), status string, sealed_at timestamp"


def digest(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and an order-free checksum; a sum of hashes, so that repeated rows count too."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    total = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), total.alias("checksum"))


def _base(root: str, table: str, snapshot_id: str, attempt: str) -> str:
    return f"{root}/{table}/snapshot_id={snapshot_id}/attempt={attempt}"


@contextmanager
def _open_files(spark: SparkSession, key: str = "spark.sql.maxConcurrentOutputFileWriters"):
    """A task keeps the files of up to ``OPEN_STORES`` stores open instead of sorting its rows by store; Spark sorts what comes beyond."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(OPEN_STORES, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_snapshot(tables: StoreTables, root: str, snapshot_id: str, fingerprint: str | None = None, later: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}) -> None:
    """All tables, then the manifest; without a manifest a snapshot doesn't exist.

    Every attempt has folders of its own and the manifest names the one it
    sealed: what a crashed attempt left behind is never read. Tables named in
    ``later`` are made from others as these are written: the function gets a
    reader of them by name.
    """
    attempt = uuid.uuid4().hex
    spark = tables.orders.sparkSession

    def write(name: str) -> DataFrame:
        # each task writes what it has of each store: a table is not shuffled again only to have fewer files
        table = later[name](lambda n: _read(spark, root, n, snapshot_id, attempt)) if name in later else getattr(tables, name)
        table.write.partitionBy("store_id").parquet(_base(root, name, snapshot_id, attempt))
        return digest(_read(spark, root, name, snapshot_id, attempt), "store_id").select(
            F.lit(snapshot_id).alias("snapshot_id"),
            F.lit(attempt).alias("attempt"),
            F.lit(fingerprint).cast("string").alias("fingerprint"),
            F.lit(name).alias("table"),
            "store_id",
            "rows",
            "checksum",
            F.lit("completed").alias("status"),
            F.current_timestamp().alias("sealed_at"),
        )

    # the tables don't depend on each other, so their jobs fill the cluster together
    with _open_files(spark), ThreadPoolExecutor(4) as pool:
        seals = list(pool.map(write, [n for n in SCHEMAS if n not in later])) + list(pool.map(write, later))
    reduce(DataFrame.unionByName, seals).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _read(spark: SparkSession, root: str, name: str, snapshot_id: str, attempt: str) -> DataFrame:
    columns = [c.split(" ")[0] for c in SCHEMAS[name].replace("decimal(19,4)", "decimal").split(", ")]
    return spark.read.schema(SCHEMAS[name]).parquet(_base(root, name, snapshot_id, attempt)).select(*columns)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per completed snapshot, table and store; empty where nothing was sealed yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _SEAL)
    return spark.read.schema(_SEAL).parquet(f"{root}/manifest")


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """L-05: completed snapshots, newest first, with their stores and rows."""
    of_one = manifest(spark, root).groupBy("snapshot_id", "attempt").agg(
        F.max("fingerprint").alias("fingerprint"), F.countDistinct("store_id").alias("stores"), F.sum("rows").alias("rows"), F.max("sealed_at").alias("sealed_at")
    )
    return of_one.orderBy(F.desc("sealed_at"), "snapshot_id")


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str, check: bool = True) -> StoreTables:
    """The first sealed attempt; refused if there is none or it differs from its seal."""
    sealed = manifest(spark, root).filter(F.col("snapshot_id") == snapshot_id)
    first = sealed.agg(F.min(F.struct("sealed_at", "attempt")).alias("a")).first().a
    if first is None:
        raise ValueError(f"snapshot {snapshot_id} is not completed")
    tables = {name: _read(spark, root, name, snapshot_id, first.attempt) for name in SCHEMAS}

    def differs(name: str) -> bool:
        """Stores that the seal and the table do not have in common; the table is read once."""
        was = sealed.filter((F.col("table") == name) & (F.col("attempt") == first.attempt)).select("store_id", "rows", "checksum", F.lit(1).alias("side"))
        both = was.unionByName(digest(tables[name], "store_id").withColumn("side", F.lit(-1)))
        return not both.groupBy("store_id", "rows", "checksum").agg(F.sum("side").alias("side")).filter("side <> 0").isEmpty()

    if check:
        # the tables don't depend on each other, so their jobs fill the cluster together
        with ThreadPoolExecutor(4) as pool:
            for name, wrong in zip(SCHEMAS, pool.map(differs, SCHEMAS)):
                if wrong:
                    raise ValueError(f"table {name} of snapshot {snapshot_id} differs from its seal")
    return StoreTables(**tables)


def find_snapshot(spark: SparkSession, root: str, fingerprint: str) -> str | None:
    """L-02: a completed snapshot of the same inputs."""
    found = manifest(spark, root).filter((F.col("status") == "completed") & (F.col("fingerprint") == fingerprint))
    return found.agg(F.min("snapshot_id").alias("s")).first().s


def write_reports(reports: DataFrame, quality: DataFrame, path: str) -> None:
    """S-11: one analysis document and one data-quality document per store."""
    reports.select("store_id", "report").write.mode("errorifexists").partitionBy("store_id").text(f"{path}/analysis")
    quality.select("store_id", "data_quality").write.mode("errorifexists").partitionBy("store_id").text(f"{path}/data_quality")
