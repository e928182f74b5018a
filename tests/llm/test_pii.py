import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import pii

from .helpers import SCHEMA, rows, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(d):
    t = [int(x) for x in d[::-1]]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checksum(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def noise(rng):
    return "".join(rng.choice(["1", "23", "255.", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "4111111111111111", "4111 1111 1111 1111", "x@y.de", "\n", "10.0.0.1", "+1 (017) 555-7713", "_%"]) for _ in range(rng.randrange(1, 40)))


def test_base_rules():
    rng = random.Random(0)
    for _ in range(4000):
        t = noise(rng)
        assert pii.base_spans(t) == brute(t), t
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "1." * 50_000)  # linear


def corpus():
    rng = random.Random(1)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    data = []
    for i in range(300):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        extra = [f"ab.{i}@mail{i % 9}.example.com", f"+1 ({d(3)}) 555-{d(4)}", f"{rng.randrange(1, 250)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", d(16), ""][i % 5]
        data.append((i, f"{fresh(20)} {extra} {fresh(20)}", "en", "s", 0))
    data.append((900, "please call (415) 555-0134 or phone 415-555-0134 now", "en", "s", 0))
    data.append((901, "mail jane.doe (at) example (dot) com today", "en", "s", 0))
    data.append((902, "invoice 9807915762804491 version 1.2.3 page 100 200 3000", "en", "s", 0))
    return data + [(1000 + i, t, *r) for i, (_, t, *r) in enumerate(rows(4, 10))]


def test_query_rows(spark):
    got = {r.doc_id: r for r in pii.find(table(spark, corpus()).withColumn("spans", F.lit("clash"))).collect()}
    assert len(got) == len(corpus())
    for i, t, *_ in corpus():
        base = brute(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert got[900].spans == "phone:12:26,phone:36:48"
    assert got[901].spans == "email:5:36"
    assert got[902].spans == ""
    assert all(got[i].spans == "" for i in range(4, 300, 5))


def test_reliabilities_follow_the_truth():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.4
        say = lambda p: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)
        v = (say(0.95), say(0.9), say(0.8), say(0.55), say(0.85), 0)
        counts["ip", v] = counts.get(("ip", v), 0) + 1
    model = pii.fit(counts)
    right = model.reliability["ip"][:, 1, 2]
    assert abs(right[0] - 0.95) < 0.03 and abs(right[2] - 0.8) < 0.04 and abs(right[3] - 0.55) < 0.05
    assert model.probability("ip", (1, 1, 1, 1, 1, 0)) > 0.95 and model.probability("ip", (-1, -1, -1, 1, -1, 0)) < 0.05


def test_classifier_alone_turns_spans_in_and_out():
    good, bad, open_ = (1, 1, 1, 0, 1, 1), (1, -1, -1, 0, -1, 0), (0, 0, 0, 0, 0, 0)
    text = {w: f"so {w} 415-555-0134 then" for w in ("ring", "lot")}
    own = {w: pii.span_features(t, t.index("4"), t.index(" then")) for w, t in text.items()}
    counts = {("phone", good): 300, ("phone", bad): 300, ("phone", open_): 2}
    ring, lot = tuple(own["ring"]), tuple(own["lot"])
    sample = {"phone": Counter({(good, ring): 300, (bad, lot): 300, (open_, ring): 1, (open_, lot): 1})}
    model = pii.fit(counts, sample)
    post = model.posterior("phone", np.array([open_]))[0]
    assert 0.45 < post < 0.55  # the labelers leave it open
    assert model.probability("phone", open_, own["ring"]) > 0.6 and model.probability("phone", open_, own["lot"]) < 0.4


def test_a_repeated_candidate_is_counted_not_listed(spark):
    """A footer's number on many pages: one row of the sample per page at most, and a count where all is equal."""
    footer = "Call us: (020) 555-0199 today, or (021) 555-0123 tomorrow."
    data = [(i, footer, "en", "s", 0) for i in range(3000)] + [(9000, "mail me(at)site.org", "en", "s", 0)]
    docs = spark.createDataFrame(data, SCHEMA)
    counts = pii.vote_counts(docs)
    sample = pii.candidate_sample(docs, counts)
    assert sum(sample["phone"].values()) == 6000 and len(sample["phone"]) <= 2
    votes, own = next(iter(sample["phone"]))
    huge = pii.fit(counts, {"phone": Counter({(votes, own): 10**12})})
    assert 0 <= huge.probability("phone", votes, list(own)) <= 1


def test_added_spans_equal_a_plain_search(spark):
    data = corpus() + [(2000 + i, f"call ({i:03d}) 555-01{i % 90 + 10} or 00{i % 9 + 1} 20 5551 {i:04d}, not 1{i}-55-012345; me{i}(at)site.org", "en", "s", 0) for i in range(40)]
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.find(table(spark, data)).collect()}
    docs = spark.createDataFrame(data, SCHEMA)
    counts = pii.vote_counts(docs)
    model = pii.fit(counts, pii.candidate_sample(docs, counts))
    shapes = [("phone", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"), ("phone", r"00[1-9] 20 5551 [0-9]{4}"), ("email", r"me[0-9]+\(at\)site\.org")]
    seen = 0
    for i, t, *_ in data[-40:]:
        want = {f"{k}:{a}:{b}" for k, a, b in brute(t)}
        for kind, shape in shapes:
            for m in re.finditer(shape, t):
                if model.probability(kind, pii.votes(t, kind, *m.span(), False), pii.span_features(t, *m.span())) >= pii.THRESHOLD:
                    want.add(f"{kind}:{m.start()}:{m.end()}")
                    seen += 1
        assert got[i] - {""} == want
    assert seen > 40


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
