import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import near_dedup as nd

from .helpers import SCHEMA, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data):
    sets = [shingle_set(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(data)):
        out[find(i)].append(data[i][0])
    return sorted((sorted(x, key=repr) for x in out.values()), key=repr)


def planted(seed=0, groups=12, size=9):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    data, n = [], 0
    for g in range(groups):
        base = fresh(rng.randrange(60, 300))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            data.append((n, " ".join(w) + ("  " if n % 4 else "\n"), "en", "s", 0))
            n += 1
    for _ in range(40):
        data.append((n, " ".join(fresh(rng.randrange(1, 120))), "en", "s", 0))
        n += 1
    return data + [(1000 + i, t, *r) for i, (_, t, *r) in enumerate(rows(2, 10))] + [(None, data[0][1], "en", "s", 0), data[3]]


def just_below(seed, size=120):
    """Copies of one text with edits each of its own: most reach 0.8 with the text, few with each other; some share their edits."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    data, edited = [], []
    for n in range(size):
        w = list(rng.choice(edited) if edited and n % 3 == 0 else base)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"e{rng.randrange(10**6)}"], [w[i], f"e{rng.randrange(10**6)}"]])
        edited.append(w)
        data.append((n, " ".join(w[: len(w) - (n % 7) * 4]), "en", "s", 0))
    return data


def test_pairs_below_the_threshold_equal_brute_force(spark, monkeypatch):
    for seed, part in ((5, 2048), (6, 3)):
        monkeypatch.setattr(nd, "PART_NODES", part)
        data = just_below(seed)
        by = defaultdict(list)
        for r in nd.classes(table(spark, data)).collect():
            by[bytes(r.class_key)].append(r.doc_id)
        want = brute(data)
        assert 3 < len(want) < 100
        assert sorted((sorted(x, key=repr) for x in by.values()), key=repr) == want


def test_groups_without_their_original(spark):
    """Edited copies of one text that is not there itself, of which some share their edits, and parts of it."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    edits = [(rng.randrange(160), f"e{i}") for i in range(25)]
    data = []
    for n in range(150):
        w = list(base)
        for i, e in rng.sample(edits, 4 + n % 3):
            w[i] = e if n % 2 else f"{e}x{n}"
        data.append((n, " ".join(w[:80] if n % 5 == 0 else w[40:] if n % 7 == 0 else w), "en", "s", 0))
    by = defaultdict(list)
    for r in nd.classes(table(spark, data)).collect():
        by[bytes(r.class_key)].append(r.doc_id)
    want = brute(data)
    assert 20 < len(want) < 140
    assert sorted((sorted(x, key=repr) for x in by.values()), key=repr) == want


@pytest.mark.parametrize("seed", [8, 1])
def test_classes_equal_brute_force(spark, seed):
    data = planted(seed)
    got = nd.classes(table(spark, data).withColumn("key", F.lit("x")).withColumn("node", F.lit("x"))).collect()
    by = defaultdict(list)
    for r in got:
        by[bytes(r.class_key)].append(r.doc_id)
        assert r.class_id is not None
    assert sorted((sorted(x, key=repr) for x in by.values()), key=repr) == brute(data)
    assert all(r.class_size == len(by[bytes(r.class_key)]) and r.class_id == min(x for x in by[bytes(r.class_key)] if x is not None) for r in got)


def test_keep_one(spark):
    data = planted(3, 4, 5)
    kept = nd.keep_one(table(spark, data)).collect()
    firsts = sorted(min(x for x in c if x is not None) for c in brute(data))
    assert sorted(r.doc_id for r in kept) == firsts and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 200).astype(float), rng.integers(1, 6, 200).astype(float)
    a, b = h[:200], h[100:]
    held = nd.prob_min_hash(np.r_[np.zeros(200, int), np.ones(200, int)], np.r_[a, b], np.r_[wa, wb], 2, 4000)
    va, vb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = sum(1 / sum(max(va.get(y, 0) / va[x], vb.get(y, 0) / vb[x]) for y in h.tolist()) for x in set(va) & set(vb))
    assert abs((held[0] == held[1]).mean() - want) < 0.03


def test_chain_component(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(0, 60)] + [(bytes([200]), bytes([201]))], "a binary, b binary")
    got = {bytes(r.node)[0]: bytes(r.label)[0] for r in nd.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_settle_holds_few_elements_at_a_time(monkeypatch):
    """Nodes with very many differences from their center: the same components, however many elements are held at once."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for seed in range(5):
        n = 60
        pool = rng.integers(0, 1 << 40, 400)
        base = [rng.choice(pool, 150, replace=False) for _ in range(4)]
        more = [np.unique(np.r_[base[i % 4][: rng.integers(100, 150)], rng.choice(pool, rng.integers(0, 20))]) for i in range(n)]
        less = [np.unique(rng.integers(1 << 41, (1 << 41) + 30, rng.integers(0, 6))) for _ in range(n)]
        sizes = rng.integers(200, 320, n)
        group = pa.table({"node": pa.array([bytes([i]) * 16 for i in range(n)], pa.binary()), "n": sizes, "more": pa.array([x.tolist() for x in more], pa.list_(pa.int64())), "less": pa.array([x.tolist() for x in less], pa.list_(pa.int64())), "as_u": pa.array([True] * n), "as_v": pa.array([i % 3 > 0 for i in range(n)])})
        got = []
        for few in (7, 1 << 12):
            monkeypatch.setattr(nd, "ELEMENTS", few)
            got.append(nd._settle(group).to_pylist())
        assert got[0] == got[1] and got[0]
