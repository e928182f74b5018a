import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import decontam

from .helpers import SCHEMA, rows, table

ITEM = "item_id long, text string"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"(?:[^\x00-\x7f]|[A-Za-z0-9])+", text or "")]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def planted(seed=0):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(fresh(rng.randrange(20, 60)))) for i in range(12)]
    data = []
    for i in range(90):
        w = fresh(rng.randrange(0, 150))
        if i % 3 == 0:
            copy = items[rng.randrange(12)][1].split()
            for _ in range(rng.choice([0, 0, 2, 5, len(copy) // 2])):
                k, what = rng.randrange(len(copy)), rng.random()
                copy[k : k + 1] = ["xx"] if what < 0.5 else [] if what < 0.75 else [copy[k], "yy"]
            copy = copy if rng.random() < 0.8 else copy[: len(copy) // 3]
            w[len(w) // 2 : len(w) // 2] = copy
        data.append((i, ", ".join(w).upper() if i % 2 else " ".join(w), "en", "s", 0))
    return items + [(100, "too short it"), (101, None), (102, "")], data + [(1000 + i, t, *r) for i, (_, t, *r) in enumerate(rows(2, 6))] + [data[0]]


def test_scores_equal_plain_alignment(spark):
    items, data = planted()
    docs = table(spark, data).withColumn("item_id", F.lit(5)).withColumn("score", F.lit("x"))
    got = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_copies(docs, spark.createDataFrame(items, ITEM)).collect())
    want = []
    for i, t, *_ in data:
        for k, item in items:
            a, b = words(item), words(t)
            if len(a) >= 4 and len(b) < 3000 and (s := smith_waterman(a, b) / (2 * len(a))) >= decontam.THRESHOLD:
                want.append((i, k, round(s, 9)))
    assert len(want) > 15 and got == sorted(want)


def test_blocks_of_items_and_filter(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 5)
    items, data = planted(1)
    docs, bench = table(spark, data), spark.createDataFrame(items, ITEM)
    bad = {r.doc_id for r in decontam.find_copies(docs, bench).collect()}
    kept = decontam.drop_copies(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in data if x[0] not in bad)


def test_passage_that_is_everywhere(spark):
    item = " ".join(f"q{i}" for i in range(30))
    data = [(i, f"a{i} {item} b{i}" if i % 2 else f"only words of number {i}", "en", "s", 0) for i in range(200)]
    got = decontam.find_copies(table(spark, data), spark.createDataFrame([(1, item)], ITEM)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 200, 2)) and {r.score for r in got} == {1.0}


def test_edited_copy_in_many_documents(spark):
    item = [f"q{i}" for i in range(40)]
    often = [w if i % 5 else f"z{i}" for i, w in enumerate(item)]
    seldom = [w if i % 6 else f"y{i}" for i, w in enumerate(item)]
    for n in (11, 200):
        data = [(i, " ".join([f"a{i}", *(seldom if i == 3 else often), f"b{i}"]), "en", "s", 0) for i in range(n)]
        data += [(n + i, f"q1 q2 q3 q4 and other words of number {i}", "en", "s", 0) for i in range(n)]
        docs, bench = table(spark, data), spark.createDataFrame([(1, " ".join(item))], ITEM)
        want = {i: smith_waterman(item, words(t)) / 80 for i, t, *_ in data}
        want = {i: round(s, 9) for i, s in want.items() if s >= decontam.THRESHOLD}
        assert set(want) == set(range(n))
        assert {r.doc_id: round(r.score, 9) for r in decontam.find_copies(docs, bench).collect()} == want
        assert {r.doc_id for r in decontam.drop_copies(docs, bench).collect()} == set(range(n, 2 * n))


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "One two, three"), (2, "alone"), (3, "one TWO"), (4, ""), (5, "one two three four five"), (6, "alone")]
    texts = ["one two three", "zero one two three four", "One-two", "one x two", "alone", "not alone, alone", None, "one two three four five"]
    docs, bench = table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), spark.createDataFrame(items, ITEM)
    want = []
    for i, t in enumerate(texts):
        for k, item in items[:4] + items[5:]:
            a, b = words(item), words(t)
            if a and any(b[j : j + len(a)] == a for j in range(len(b))):
                want.append((i, k, 1.0))
    got = [(r.doc_id, r.item_id, r.score) for r in decontam.find_copies(docs, bench).collect() if r.item_id != 5]
    assert sorted(got) == sorted(want)
    # by full alignment with the one item that is long enough: three of five words in a row are 0.6 of it
    long = words(items[4][1])
    left = [i for i, t in enumerate(texts) if smith_waterman(long, words(t)) < decontam.THRESHOLD * 2 * len(long)]
    assert left == [2, 3, 4, 5, 6] and sorted(r.doc_id for r in decontam.drop_copies(docs, bench).collect()) == left
    assert decontam.drop_copies(docs, bench, min_words=1).count() == 2


def edited(rng, words_, rate, every=0):
    """Words replaced, dropped or added at a rate, or every n-th replaced."""
    out = []
    for i, w in enumerate(words_):
        if every:
            out.append(f"x{rng.randrange(10**9)}" if i % every == every - 1 else w)
        elif rng.random() < rate:
            out += [[f"x{rng.randrange(10**9)}"], [], [w, f"x{rng.randrange(10**9)}"]][rng.choice([0, 0, 1, 2])]
        else:
            out.append(w)
    return out


def test_no_edited_copy_is_lost(spark):
    """At every rate of edits, all copies that full alignment finds, and their scores."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    items = [(i, [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(20_000)}" for _ in range(40)]) for i in range(60)]
    data = []
    for rate, every in ((0.1, 0), (0.15, 0), (0.2, 0), (0.25, 0), (0.3, 0), (0, 4), (0, 3)):
        for i, item in items:
            around = [rng.choice(common) for _ in range(60)]
            data.append((len(data), " ".join([*around, *edited(rng, item, rate, every), *around[::-1]]), "en", "s", 0))
    want, lost = {}, 0
    for i, t, *_ in data:
        item = items[i % 60]
        score = smith_waterman(item[1], words(t)) / 80
        lost += score < decontam.THRESHOLD
        if score >= decontam.THRESHOLD:
            want[i, item[0]] = round(score, 9)
    assert len(want) > 250 and lost > 20
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEM)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontam.find_copies(table(spark, data), bench).collect()}
    assert {k: v for k, v in got.items() if k[1] == items[k[0] % 60][0]} == want
    for (i, k), score in got.items():
        assert (i, k) in want or score == round(smith_waterman(items[k][1], words(data[i][1])) / 80, 9)


def test_items_of_common_words(spark):
    """An item all of whose words are everywhere is found too."""
    rng = random.Random(6)
    item = [rng.choice("abcdef") for _ in range(24)]
    data = [(i, " ".join(rng.choice("abcdefgh") for _ in range(150)), "en", "s", 0) for i in range(60)] + [(100, " ".join(["h"] * 9 + item), "en", "s", 0)]
    want = {i: round(s, 9) for i, t, *_ in data if (s := smith_waterman(item, words(t)) / 48) >= decontam.THRESHOLD}
    got = decontam.find_copies(table(spark, data), spark.createDataFrame([(1, " ".join(item))], ITEM)).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == want and want[100] == 1.0


def test_align():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert decontam.align(a, b)[0] == smith_waterman(a, b)


def test_empty(spark):
    docs, none = table(spark, planted()[1][:5]), spark.createDataFrame([], ITEM)
    assert decontam.find_copies(docs, none).count() == 0
    assert decontam.drop_copies(docs, none).count() == 5
    assert decontam.find_copies(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c d e")], ITEM)).count() == 0
