"""Shared-folder tables that cut lineage, and sizes read from the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which executors share too."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result no longer depends on shuffle files, so a lost executor costs
    only the tasks that were running on it.
    """
    path = f"{folder(df.sparkSession)}/tallyhouse/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the folder behind a result of ``table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder_of in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder_of)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have, whatever their case."""
    taken, made, i = {c.lower() for c in df.columns}, [], 0
    while len(made) < n:
        if f"_t{i}" not in taken:
            made.append(f"_t{i}")
        i += 1
    return made


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_key(column: str = "text"):
    """128-bit identity of a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))
