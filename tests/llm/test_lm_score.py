import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import lm_score, ppm, queries

from .helpers import SCHEMA, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def plain_ppm(texts, depth):
    """Probability of a symbol by the textbook rules, with sets and dicts."""
    count = defaultdict(Counter)
    for t in texts:
        raw = bytes([255] * depth) + t.encode() + b"\xff"
        for p in range(depth, len(raw)):
            for k in range(depth + 1):
                count[raw[p - k : p]][raw[p]] += 1

    def log10(t):
        raw, total = bytes([255] * depth) + t.encode() + b"\xff", 0.0
        for p in range(depth, len(raw)):
            gone: set = set()
            for k in range(depth, -1, -1):
                seen = {s: n for s, n in count.get(raw[p - k : p], {}).items() if s not in gone}
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if raw[p] in seen:
                    total += math.log10(seen[raw[p]] / (n + d))
                    break
                total += math.log10(d / (n + d))
                gone |= set(seen)
            else:
                total += -math.log10(256 - len(gone))
        return total

    return log10


def brute(data, depth):
    low = lambda t: [w.translate(LOW) for w in WORD.findall(t or "")]
    count, n_train = Counter(), 0
    for i, t, *_ in data:
        if not held(i):
            count.update(low(t))
            n_train += 1
    n, v = sum(count.values()) + n_train, len(count) + (n_train > 0)
    log10 = plain_ppm([t or "" for i, t, *_ in data if not held(i)], depth)
    out = []
    for i, t, *_ in data:
        w = low(t)
        c = [count[x] for x in w] + [n_train]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        out.append((i, held(i), len(c), sum(x > 0 for x in c), n, round(base, 6), round(log10(t or ""), 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, small):
    data = [(i, t if t is None else t[:3000], *r) for i, t, *r in rows(7, 40)]
    if small:
        monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
        monkeypatch.setattr(lm_score, "BUCKET_WORDS", 20)
        monkeypatch.setattr(lm_score, "TRIE_GRAMS", 300)
    docs = table(spark, data).withColumn("held", F.lit("x")).withColumn("id", F.lit("x"))
    trie, _, _ = lm_score.train(table(spark, data).select(lm_score.held_out("doc_id").alias("held"), "text"))
    assert (trie.depth < lm_score.DEPTH) == small
    got = sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in lm_score.score(docs).collect()), key=repr)
    want = brute(data, trie.depth)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-6)


@pytest.mark.parametrize("small", [False, True])
def test_whole_depth_at_every_size(spark, monkeypatch, tmp_path, small):
    data = [(i, t if t is None else t[:3000], *r) for i, t, *r in rows(7, 40)]
    if small:
        monkeypatch.setattr(lm_score, "CHUNK_BYTES", 2000)
        monkeypatch.setattr(lm_score, "BUCKET_WORDS", 20)
        monkeypatch.setattr(lm_score, "BUCKET_GRAMS", 200)
        monkeypatch.setattr(lm_score, "GROUP_GRAMS", 200)
    monkeypatch.setattr(lm_score, "TRIE_GRAMS", 300)  # a limit that the registered query must not have
    table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    scored = queries.op8_ppm_scoring(spark, str(tmp_path))
    got = sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in scored.collect()), key=repr)
    want = brute(data, lm_score.DEPTH)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-6)


def test_whole_depth_of_awkward_tables(spark):
    assert lm_score.score_whole(spark.createDataFrame([], SCHEMA)).count() == 0
    r = lm_score.score_whole(spark.createDataFrame([(None, "ab", None, None, None)], SCHEMA)).first()  # nothing trains
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-9


def test_probabilities_sum_to_one():
    data = np.frombuffer(b"abracadabra banana", np.uint8)
    key, n = np.unique(ppm.padded(data, np.array([0, 11, len(data)]), 3)[0], return_counts=True)
    trie = ppm.Trie(key, n, 3)
    for context in (b"abr", b"xyz", b"ana", b"\xff\xff\xff"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-9


def test_training_helps():
    text = "the cat sat on the mat and the dog sat on the log " * 20
    raw = np.frombuffer(text.encode(), np.uint8)
    key, n = np.unique(ppm.padded(raw, np.array([0, len(raw)]), 4)[0], return_counts=True)
    trie = ppm.Trie(key, n, 4)
    bits = lambda t: -trie.log10(ppm.padded(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 4)[0]).mean() / math.log10(2)
    assert bits(b"the dog sat on the mat") < 1.5 < 6 < bits(b"QZXJ%%KW 90817")


def test_empty_table(spark):
    assert lm_score.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(None, "ab", None, None, None)], SCHEMA)  # nothing trains
    r = lm_score.score(only).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 3 * math.log10(256)) < 1e-9
