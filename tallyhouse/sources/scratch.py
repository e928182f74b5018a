"""A shared folder for written intermediates of the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        if named.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named.rstrip('/')}/tallyhouse"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path of its own."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that all queries of an application find again."""
    return f"{root(spark)}/{name}-{spark.sparkContext.applicationId}"


def table(df: DataFrame, name: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a plain scan, whatever it was made from."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the application that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_table(df: DataFrame) -> None:
    """``remove`` of the folder behind what :func:`table` gave."""
    spark = df.sparkSession
    named = [spark._jvm.java.net.URI(name).getPath() for name in df.inputFiles()[:1]]
    for path in named:
        parts = path.split("/")[:-1]
        while "=" in parts[-1]:  # a partition's folder
            parts.pop()
        remove(spark, f"{root(spark)}/{parts[-1]}")


@contextmanager
def settings(spark: SparkSession, **named: str) -> Iterator[None]:
    """The session's settings while something is written: ``a__b`` is ``spark.sql.a.b``."""
    keys = {f"spark.sql.{name.replace('__', '.')}": value for name, value in named.items()}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def short_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written meanwhile leaves no shuffle files behind; otherwise they stay until the driver collects its garbage."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")
