"""Periodic runs against a plain search of all diagonals."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import periodic
from tallyhouse.llm.queries import QUERIES

from .helpers import SCHEMA, rows, table


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, min_words=24, min_repeats=3):
    """Runs of a list of words by definition: every lag, every maximal stretch, no smaller period."""
    n, out = len(words), []
    for q in range(1, n // min_repeats + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(min_words, min_repeats * q):
                stretch = words[s:e]
                if all(any(stretch[i] != stretch[i - d] for i in range(d, len(stretch))) for d in range(1, q)):
                    out.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def strongest(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_words(rng):
    """Words with runs of many periods, some nested, some next to each other."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        q = rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 24, 33])
        letters = "ab" if rng.random() < 0.5 else "abcdefghijklmnop"
        root = [rng.choice(letters) for _ in range(q)]
        if rng.random() < 0.3:
            root = [rng.choice("ab")] * (q - 1) + ["z"]
        out += (root * 12)[: rng.randrange(1, 4 * q + 20)]
        out += [rng.choice(letters) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.3:
            out += out[-rng.randrange(1, len(out) + 1) :] * rng.randrange(1, 4)
    return out[:400]


def found(texts, min_words=24, min_repeats=3):
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary) * 7919 + 1) for t in texts for w in t], np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, length, period = periodic.runs_of(word, doc, min_words, min_repeats)
    out = [[] for _ in texts]
    first = np.searchsorted(doc, np.arange(len(texts)))
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        out[doc[s]].append((s - int(first[doc[s]]), n, q))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(40)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 3000, list("ab") * 12, list("abcdefghi") * 3]
    rng.shuffle(texts)
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=4), st.integers(2, 20), st.integers(3, 4))
def test_runs_of_two_letters(texts, min_words, min_repeats):
    assert found(texts, min_words, min_repeats) == [brute(t, min_words, min_repeats) for t in texts]


def test_fewer_repeats_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(0, np.uint64), np.zeros(0, np.int64), 24, 2)


def data():
    rng = random.Random(3)
    glue = [" ", "\n", "\t ", "  ", "\r\n"]
    made = [(1000 + i, "".join(w + rng.choice(glue) for w in periodic_words(rng)), "en", "s", 0) for i in range(80)]
    long = " ".join(f"w{i % 5000}" for i in range(18_000))
    return rows(4, 30) + made + [(2000, "a " * 40_000, "en", "s", 0), (2001, long, "en", "s", 0)]


def test_find_runs(spark):
    docs = table(spark, data()).withColumnsRenamed({"lang": "runs", "source": "collapsed"})
    got = periodic.find_runs(docs).collect()
    want = []
    for i, t, *_ in data():
        words = words_of(t)
        runs = [(0, 40_000, 1)] if i == 2000 else [(0, 18_000, 5000)] if i == 2001 else brute(words) if len(words) < 3000 else []
        want.append((i, len(words), runs, strongest(runs), collapsed(words, runs)))
    seen = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert any(len(r.runs) > 1 for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic.find_runs(docs).count() == 0
    assert periodic.find_runs(docs, keep_text=False).columns == ["doc_id", "n_words", "runs", "strongest"]


def test_query(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d"]) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 300))), "en", "s", 0) for i in range(150)]
    docs += [r for r in data() if r[1] is None or len(r[1]) < 3000]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert out.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256 n_words".split()
    want, digest = [], lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in docs:
        words = planted(i, words_of(t))
        runs = brute(words)
        best = strongest(runs)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)), len(words)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 30
