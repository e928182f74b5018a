import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import line_dedup
from tallyhouse.llm.cuckoo import CuckooFilter

from .helpers import SCHEMA, rows, table

LOW = {c: c + 32 for c in range(65, 91)}


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOW)


def brute(data, limit):
    count = Counter(k for _, t, *_ in data for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        stay = [x for x in lines if count[key(x)] < limit]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def data():
    extra = [(500 + i, f" Shared Line\n own {i}\nÉ\t\nSHARED line \n{'rare' if i < 3 else 'x'}\n", "en", "s", 0) for i in range(12)]
    return rows(5, 40) + extra


def test_equals_brute_force(spark):
    docs = table(spark, data()).withColumn("key", F.lit("clash")).withColumn("lines", F.lit("clash"))
    got = line_dedup.drop_report(docs, line_dedup.build_index(docs, 5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data(), 5)
    texts = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in line_dedup.drop_lines(docs, line_dedup.build_index(docs, 5)).collect())
    assert texts == Counter(x[3] for x in brute(data(), 5))


def test_large_filters_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    docs = table(spark, data())
    got = line_dedup.drop_report(docs, line_dedup.build_index(docs, 5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data(), 5)
    monkeypatch.setattr(line_dedup, "PART_LINES", 4)  # a shard in several parts
    index = line_dedup.build_index(docs, 5)
    assert index.shards > 1
    got = line_dedup.drop_report(docs, index).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data(), 5)


def test_filters_hold_back_what_is_rare(spark):
    docs = table(spark, data())
    index = line_dedup.build_index(docs, 5)
    keys = index.counts.select(F.lit(b"k").alias("key"), "hi", "lo")
    assert index.frequent().count() <= line_dedup._through_filters(keys, index).count() < index.counts.count() / 2


def test_insert_then_delete_restores(spark):
    old, new = data()[:30], data()[30:]
    first = line_dedup.build_index(table(spark, old), 5)
    grown = line_dedup.update_index(first, table(spark, new))
    assert sorted(map(tuple, line_dedup.drop_report(table(spark, data()), grown).collect()), key=repr) == brute(data(), 5)
    back = line_dedup.update_index(grown, table(spark, new), delete=True)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, first.counts.collect()))
    assert sorted(map(tuple, line_dedup.drop_report(table(spark, old), back).collect()), key=repr) == brute(old, 5)


def test_filter():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(-(2**62), 2**62, (2, 3000))
    f = CuckooFilter.build(hi, lo)
    assert f.contains(hi, lo).all()
    assert f.contains(*rng.integers(-(2**62), 2**62, (2, 20000))).mean() < 0.01
    for a, b in zip(hi[:1000].tolist(), lo[:1000].tolist()):
        assert f.delete(a, b)
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(hi[1000:], lo[1000:]).all()
    assert f.contains(hi[:1000], lo[:1000]).mean() < 0.01


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.drop_report(empty, line_dedup.build_index(empty)).count() == 0
