import zlib

from pyspark.sql import functions as F

from tallyhouse.llm import sharding

from .helpers import SCHEMA, table


def test_shards_are_contiguous_and_even(spark):
    docs = table(spark).withColumn("size", F.lit("clash")).withColumn("part", F.lit(1))
    got = sharding.shard_by_bytes(docs, 4).toPandas()
    data = docs.toPandas()
    assert len(got) == len(data)
    sizes = data.text.map(lambda t: len((t or "").encode()) + 1)
    assert got["size"].sum() == sizes.sum()
    assert sorted(got.text_crc32) == sorted(zlib.crc32((t or "").encode()) for t in data.text)
    got = got.sort_values(["shard", "slot"])
    start = got["size"].cumsum() - got["size"]
    assert (got.shard == start * 4 // sizes.sum()).all()
    for _, g in got.groupby("shard"):
        assert list(g.slot) == list(range(len(g)))
    ids = [-1 if x != x else x for x in got.doc_id]
    assert ids == sorted(ids)


def test_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA), 4).count() == 0
