"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import kernels as K
from tallyhouse.llm import lexical
from tallyhouse.llm.queries import QUERIES, SQL

from .helpers import SCHEMA, rows, table

LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [Counter(terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), held, n in zip(docs, counts, sizes):
            score = 0
            for term in terms_of(text):
                if held[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (10**9 * held[term] // (1000 * held[term] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, s[2], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(900)] + ["The", "of", "É", "日本", "x_y"]
    weights = [1 / (1 + i) for i in range(len(words))]
    rng.shuffle(words)
    made = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.choice([3, 20, 60, 300, 1500])))) for i in range(n)]
    made += [(n + i, made[5][1]) for i in range(25)] + [(None, made[5][1]), (7, made[7][1]), (2 * n, " ".join(words) * 3), (2 * n + 1, "rare rare rare word")]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 4, 12, 40])))) for i in range(40)]
    items += [(100, made[5][1]), (101, "unheard of"), (102, None), (103, ""), (104, "..."), (5, made[9][1]), (105, "Rare word"), (106, "absent"), (107, " ".join(words))]
    return made + [(i, t) for i, t, *_ in rows(6, 20)], items


@pytest.fixture(scope="module")
def found():
    docs, items = corpus()
    return docs, items, brute(docs, items)


def as_table(spark, docs):
    return table(spark, [(i, t, "en", "s", 0) for i, t in docs], 6).withColumnsRenamed({"lang": "query", "source": "key", "n_chars": "score"})


def test_all_documents_scored(spark, found, monkeypatch):
    docs, items, want = found
    made = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(as_table(spark, docs), made).collect()), key=repr) == want
    assert {r[0] for r in want} >= {100, 105, 107} and not {r[0] for r in want} & {102, 103, 104, 106}


def test_blocks_of_queries_and_keys(spark, found, monkeypatch):
    docs, items, _ = found
    for name, value in {"ITEM_BLOCK": 17, "KEYS": 60, "SEEDS": 3}.items():
        monkeypatch.setattr(lexical, name, value)
    made = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build_index(as_table(spark, docs))
    assert sorted(map(tuple, lexical.search(as_table(spark, docs), made, k=3, index=index).collect()), key=repr) == brute(docs, items, 3)


def test_bounds_hold_and_tell_apart(found, monkeypatch):
    """No score exceeds its bound, and most documents are excluded by a floor."""
    docs, items, want = found
    monkeypatch.setattr(lexical, "GROUP_TERMS", 50)
    texts = [t or "" for _, t in docs]
    n, doc, h, tf = lexical.term_counts(*K.column_bytes(pa.array(texts)))
    queries = lexical.Queries.of([i for i, _ in items], [t or "" for _, t in items])
    df = {j: int((h == v).sum()) for j, v in enumerate(queries.vocabulary) if (h == v).any()}
    queries.weigh(int((n > 0).sum()), int(n.sum()), df)
    exact = np.zeros((len(items), len(docs)), np.int64)
    for text, query, score in queries.scores(*K.column_bytes(pa.array(texts))):
        exact[query, text] = score
    levels = np.searchsorted(lexical.LEVELS, tf, side="right")
    width = 1 << 15
    cells = np.zeros((width, len(docs)), np.uint8)
    for d, x, most in zip(doc, h, levels):
        for level in range(most):
            for i in range(lexical.HASHES):
                cells[lexical._bit(lexical._level_keys(np.array([x]), level), i, width)[0], d] = 1
    seen = set()
    for j, bound in queries.bounds(width, n, np.packbits(cells, axis=1, bitorder="little").ravel(), list(queries.groups())):
        seen.add(j)
        assert (bound >= exact[j]).all()
        if items[j][0] == 100:
            assert (bound >= np.sort(exact[j])[-10]).sum() < 60
    assert seen == {j for j in range(len(items)) if exact[j].any()}
    assert {(items[j][0], int(exact[j].max())) for j in seen} == {(r[0], r[3]) for r in want if r[1] == 1}


def test_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, long), (2, "w5 " * 50_000), (3, "w5 other"), (4, "nothing")]
    items = [(1, "w5 w59999"), (2, "w5")]
    got = lexical.search(as_table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", "", 0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs, items).count() == 1


def test_query_and_sql(spark, found, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, items, want = found
    spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["op12_lexical_search"](spark, str(tmp_path))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=repr) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(SQL["op12_lexical_search"]).fetchall(), key=repr) == want
