"""Contiguous shards of near-equal byte size, native Spark.

Rows get a global order by range partitioning on their id. Totals of the
partitions give each partition its starting byte and row; running sums inside
a partition do the rest. Nothing but one row per partition and one per shard
is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the table into ``n_shards`` runs whose byte sizes are near equal.

    A row's size is the UTF-8 length of its text plus 1 (null text: 1). The
    order is by id, nulls first, repeated ids in reading order. A row goes to
    the shard in whose share of the total its first byte falls:
    ``start * n_shards / total``, so a shard differs from an equal share by
    less than its two border rows, and a row longer than a share leaves the
    shards it spans empty.

    Returns id, size, text_crc32, shard, slot (0, 1, ... within the shard).
    Other columns of the input, whatever their names, are not read. An empty
    table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
    ).withColumn("seq", F.monotonically_increasing_id())
    # the tie column spreads a repeated or missing id over partitions
    placed = (
        rows.repartitionByRange(scratch.shuffle_partitions(docs.sparkSession), F.col("id").asc_nulls_first(), "seq")
        .withColumn("part", F.spark_partition_id())
    )
    # written once: both passes below must see the same placement
    placed = scratch.table(placed, "sharding")
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row0"),
        F.sum("part_bytes").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    inside = W.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "seq")
    ranked = (
        placed.withColumn("byte", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "part")  # one row for each shuffle partition
        .select(
            "id",
            "size",
            "crc",
            (F.col("row0") + F.col("row")).alias("row"),
            F.expr(f"int((byte0 + byte) * {int(n_shards)} div total)").alias("shard"),
        )
    )
    # the first row of each shard follows from each partition's first row of it
    firsts = ranked.groupBy("shard").agg(F.min("row").alias("first_row"))
    return ranked.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first_row")).alias("slot")
    )
