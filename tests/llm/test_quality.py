import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyhouse.llm import quality

from .helpers import SCHEMA, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_measures(spark):
    docs = table(spark).withColumn("row", F.lit("x")).withColumn("words", F.lit("x"))
    got = quality.apply_rules(docs).collect()
    want = []
    for i, t, *_ in rows():
        b = base(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert all(not r.kept for r in got if r.base_failed)


def _doc(words, *lines):
    return "\n".join([" ".join(words), *lines])


def test_frequent_lines_deplete_documents_but_copies_do_not(spark):
    stub = [" ".join(f"menu{i}y{j}" for j in range(10)) for i in range(12)]
    data = []
    for i in range(20):  # unrelated documents that consist of the same menu
        data.append((i, _doc([f"own{i}x{j}" for j in range(12)], *stub), "en", "a", 0))
    for i in range(20, 40):  # exact copies
        data.append((i, _doc([f"w{j}" for j in range(40)], " ".join(f"v{j}" for j in range(40))), "en", "a", 0))
    for i in range(40, 60):  # near copies: the first line differs
        data.append((i, _doc([f"u{j}" for j in range(60)] + [f"e{i}"], *[" ".join(f"t{k}x{j}" for j in range(40)) for k in range(6)]), "en", "a", 0))
    for i in range(60, 80):  # long documents with the menu
        data.append((i, _doc([f"long{i}x{j}" for j in range(200)], *stub), "en", "a", 0))
    for i in range(80, 85):  # the menu at a host where it is rare
        data.append((i, _doc([f"own{i}x{j}" for j in range(12)], *stub), "en", "b", 0))
    got = {r.doc_id: r for r in quality.apply_rules(table(spark, data)).collect()}
    assert {i for i, r in got.items() if not r.kept} == set(range(20))
    assert all(got[i].removed_words == 120 for i in range(60, 80))
    kept = {r.doc_id: r.text for r in quality.filter_documents(table(spark, data)).collect()}
    assert set(kept) == set(range(20, 85))
    assert kept[60] == " ".join(f"long60x{j}" for j in range(200))
    assert kept[20] == data[20][1] and kept[80] == data[80][1]


def test_long_furniture_goes_and_edited_copies_stay(spark):
    notice = " ".join(f"notice{j}" for j in range(60))
    data = [(i, _doc([f"own{i}x{j}" for j in range(90)], notice), "en", "a", 0) for i in range(30)]
    rng = random.Random(1)
    for i in range(100, 400):  # edited copies of one long text of three lines
        lines = [[f"p{k}x{j}" for j in range(70)] for k in range(3)]
        for _ in range(rng.randrange(1, 4)):
            lines[rng.randrange(3)][rng.randrange(70)] = f"e{rng.random()}"
        data.append((i, "\n".join(map(" ".join, lines)), "en", "a", 0))
    kept = {r.doc_id: r.text for r in quality.filter_documents(table(spark, data)).collect()}
    assert kept == {i: t.replace("\n" + notice, "") for i, t, *_ in data}


def plain_verdicts(data, max_docs=10, min_words=20, min_share=0.3):
    """The rules in plain Python: kept and the lines left, for texts whose rare parts are either much alike or not at all."""
    low = str.maketrans({c: c + 32 for c in range(65, 91)})

    def norm(line):
        return tuple(w.translate(low) for w in WORD.findall(line))

    def runs(line):
        return {line[i : i + 3] for i in range(max(1, len(line) - 2))}

    held, verdict = defaultdict(set), {}
    for _, t, _, host, _ in data:
        for line in {norm(x) for x in (t or "").split("\n")} - {()}:
            held[host, line].add(t)
    frequent = set()
    for (host, line), texts in held.items():
        groups = []
        for t in texts if len(texts) > max_docs else ():
            rarer = {x for x in map(norm, t.split("\n")) if x and len(held[host, x]) < len(texts)}
            own = set().union(*map(runs, rarer)) if rarer else {None}
            like = [g for g in groups if any(5 * len(own & o) > 2 * len(own | o) for o in g)]
            for g in like[1:]:
                like[0].extend(g)
                groups.remove(g)
            if like:
                like[0].append(own)
            else:
                groups.append([own])
        if len(groups) > max_docs:
            frequent.add((host, line))
    for i, t, _, host, _ in data:
        left = [x for x in (t or "").split("\n") if (host, norm(x)) not in frequent]
        n, b = len(WORD.findall("\n".join(left))), base(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        verdict[i] = (not failed and n >= min_words and n >= min_share * b[0], "\n".join(left))
    return verdict


def _agrees(spark, data):
    want = plain_verdicts(data)
    got = {r.doc_id: r.kept for r in quality.apply_rules(table(spark, data)).collect()}
    assert got == {i: kept for i, (kept, _) in want.items()}
    texts = {r.doc_id: r.text for r in quality.filter_documents(table(spark, data)).collect()}
    assert texts == {i: left for i, (kept, left) in want.items() if kept}
    return got, texts


def test_more_furniture_never_helps(spark):
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    data = []
    for k in (2, 6, 12, 25, 40):  # unrelated pages of one host: one line of 60 words and k of their own
        data += [(1000 * k + i, f"{words('notice', 60)}\n{words(f'p{k}x{i}y', k)}", "en", f"k{k}", 0) for i in range(80)]
    for i in range(60):  # two long lines
        data.append((100_000 + i, f"{words('head', 60)}\n{words(f'q{i}y', 6)}\n{words('foot', 60)}", "en", "two", 0))
    got, texts = _agrees(spark, data)
    assert {i // 1000 for i, kept in got.items() if kept} == {40}
    assert all(texts[i] == t.split("\n")[1] for i, t, *_ in data if got[i])


def test_copies_of_another_page_do_not_save_a_line(spark):
    words = lambda name, n: [f"{name}{j}" for j in range(n)]
    rng, notice = random.Random(5), " ".join(f"n{j}" for j in range(60))
    data = [(i, f"{notice}\n{' '.join(words(f'p{i}x', 60))}", "en", "a", 0) for i in range(40)]
    lines = [words(f"u{k}x", 40) for k in range(4)]
    for i in range(1000, 1200):
        copy = [list(x) for x in lines]
        copy[rng.randrange(4)][rng.randrange(40)] = f"e{i}"
        data.append((i, "\n".join([notice, *map(" ".join, copy)]), "en", "a", 0))
    _, texts = _agrees(spark, data)
    assert len(texts) == 240 and not any(notice in t for t in texts.values())
    assert all(len(t.split("\n")) == 4 for i, t in texts.items() if i >= 1000)


def test_mixed_rows_by_plain_rules(spark):
    data = [r for r in rows(3, 80) if r[0] not in (None, 0)]
    data += [(200 + i, f"Own{i} and {i * 7} {' '.join(f'z{i}q{j}' for j in range(50))}\nShared  line\nshared LINE {i // 4}\n" + "long shared line " * 20, "en", f"s{i % 2}" if i % 3 else None, 0) for i in range(48)]
    _agrees(spark, data)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.apply_rules(empty).count() == 0
    assert quality.filter_documents(empty).count() == 0
