import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bpe

from .helpers import SCHEMA, rows, table

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library(spark):
    theirs = tokenizers.Tokenizer.from_file(PATH)
    theirs.no_truncation()
    theirs.no_padding()
    got = bpe.encode(table(spark).withColumn("ids", F.lit(1)), PATH, digests=True).collect()
    want = []
    for i, text, *_ in rows():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_decode_gives_the_text_back(spark):
    coded = bpe.encode(table(spark), PATH)
    back = {(r.doc_id, r.text) for r in bpe.decode(coded, PATH).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows()}


def test_overlapping_pairs():
    theirs = tokenizers.Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    for t in ["a" * k for k in range(40)] + ["  " * 9 + "x", "!!!!!!!", "0" * 33, "aabaabaaab", "🙂🙂🙂"]:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_very_long_words():
    rng = random.Random(3)
    theirs = tokenizers.Tokenizer.from_file(PATH)
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (399, 400, 401, 2000, 60_000)]
    words += ["a" * 5000, "ab" * 3000, "é" * 1001, "".join(rng.choice("abAB01+/=") for _ in range(30_000))]
    began = time.perf_counter()
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(words)]
    assert time.perf_counter() - began < 20
    assert got == [theirs.encode(w, add_special_tokens=False).ids for w in words]


def test_other_settings_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary.load(str(path))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, digests=True).count() == 0
