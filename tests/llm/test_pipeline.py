import hashlib
import random

import pytest

import corpus_pipeline as cp
from .helpers import SCHEMA, rows
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_classes
from .test_quality import base

ITEM = "item_id long, text string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(0)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = fresh(40)
    data = []
    for i in range(60):
        data.append((i, "\n".join([fresh(70), "Read More", fresh(30)]), "en", f"s{i % 2}", 0))
    data += [(100 + i, data[0][1].replace("Read More", f"edit{i}"), "en", "s0", 0) for i in range(5)]  # near copies
    data += [(200 + i, data[1][1], "en", "s1", 0) for i in range(5)]  # copies
    data += [(300 + i, f"{fresh(60)} {item} {fresh(60)}", "en", "s0", 0) for i in range(4)]  # leaks
    data += [(400 + i, fresh(20), "en", "s0", 0) for i in range(4)]  # short
    data += [(500 + i, t, *r) for i, (_, t, *r) in enumerate(rows(3, 5))]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "ab cd")], ITEM).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), data, item


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_each_stage_by_brute_force(spark, made, tmp_path):
    folder, data, item = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, kept = docs.schema, data
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.schema == schema, name
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        got = sorted(rows_of(out), key=repr)
        if n == 0:
            # "Read More" is in more than ten texts of both hosts
            ok = [x for x in kept if (b := base(x[1]))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
            want = [(i, t.replace("Read More\n", ""), *r) for i, t, *r in ok]
            assert {x[0] for x in got} == {x[0] for x in want}
            assert got == sorted(want, key=repr)
        elif n == 1:
            want = sorted((x[0], x[3]) for x in brute_lines(kept, 10))
            assert sorted((x[0], hashlib.sha256((x[1] or "").encode()).hexdigest()) for x in got) == want
        elif n == 2:
            classes = brute_classes(kept)
            assert sorted(x[0] for x in got) == sorted(min(c, key=lambda i: (i is None, i)) for c in classes)
        elif n == 3:
            assert {x[0] for x in kept} - {x[0] for x in got} == {x[0] for x in kept if item in x[1]}
        else:
            assert {x[0] for x in got} == {x[0] for x in kept} and all(len(x[2]) == x[1] > 0 for x in got)
        docs, kept = out, got


def test_run(spark, made):
    folder, data, item = made
    got = {r.doc_id for r in cp.run(spark, folder).collect()}
    assert set(range(2, 60)) <= got and not got & {*range(100, 105), *range(200, 205), *range(300, 304), *range(400, 404)}
