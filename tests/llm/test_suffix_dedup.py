import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import suffix_dedup as sd

from .helpers import SCHEMA, rows, table


def brute(data, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t, *_ in data]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] += 1
    out = []
    for (i, *_), raw in zip(data, raws):
        gone = np.zeros(len(raw) + 1, np.int64)
        for j in range(len(raw) - length + 1):
            if seen[raw[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        out.append((i, len(raw), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def planted(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(n) for n in (30, 40, 60, 200)] + ["ab" * 150, "z" * 500]
    data = []
    for i in range(80):
        parts = [fresh(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [p[a : len(p) - rng.randrange(0, 40)], fresh(rng.randrange(0, 30))]
        data.append((i, " ".join(parts), "en", "s", 0))
    return data + [(i + 100, data[i][1], "en", "s", 0) for i in range(5)] + [(i, t if t is None or len(t) < 20000 else t[:15000], *r) for i, t, *r in rows(2, 10)]


@pytest.mark.parametrize("contexts", [1500, 3])
def test_equals_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(sd, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(sd, "SHARD_BYTES", 20_000)
    data = planted()
    docs = table(spark, data).withColumn("key", F.lit("clash")).withColumn("runs", F.lit("clash"))
    got = sd.remove_repeats(docs, 200).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, 200)


@pytest.mark.parametrize("length", [5, 40, 100, 300, 400])
def test_other_lengths(spark, monkeypatch, length):
    monkeypatch.setattr(sd, "SHARD_CONTEXTS", 5)
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    data = [(i, "".join(rng.choice("ijklmn") for _ in range(300)) + passage[i * 20 :] + str(i), "en", "s", 0) for i in range(6)]
    got = sd.remove_repeats(table(spark, data), length).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, length)


def test_refused_length(spark):
    with pytest.raises(ValueError):
        sd.remove_repeats(table(spark), 0)


def test_kept_bytes(spark):
    data = planted(1)
    got = sd.remove_repeats(table(spark, data), 200, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_common_context_is_one_row_of_its_shard(spark, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_CONTEXTS", 3)
    plans, write = [], sd.scratch.table

    def watch(df, name):
        if name == "suffix-found":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(sd.scratch, "table", watch)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(120))
    data = [(i, f"{rng.random()} {passage} {rng.random()}", "en", "s", 0) for i in range(60)]
    got = sd.remove_repeats(table(spark, data), 200).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, 200)
    below = plans[0].split("FlatMapGroupsInArrow")[1]
    assert "Aggregate [home" in below and below.index("Aggregate [home") < below.index("MapInArrow")


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for text in (b"banana", b"a" * 300, b"abcab" * 70, bytes(rng.integers(97, 100, 2000).astype(np.uint8))):
        arr = np.frombuffer(text, np.uint8)
        sa = sd.suffix_array(arr)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = sd.common_prefixes(arr, sa, 250, lane=7)
        for k in range(1, len(sa)):
            a, b = text[sa[k - 1] :], text[sa[k] :]
            n = 0
            while n < min(len(a), len(b), 250) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_text_of_many_copies(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    page, shared = fresh(60), fresh(40)
    data = [(i, page, "en", "s", 0) for i in range(400)]
    data += [(1000 + i, f"{fresh(20)} {shared} {fresh(20)}", "en", "s", 0) for i in range(3)] + [(2000, fresh(80), "en", "s", 0), (2001, f"{page} {fresh(30)}", "en", "s", 0)]
    got = sd.remove_repeats(table(spark, data, 7), length=200)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, 200)
