"""Every registered text query over small tables: contract columns, and rows against brute force or SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm.queries import QUERIES, SQL

from . import test_bpe, test_line_dedup, test_near_dedup, test_pii, test_quality, test_suffix_dedup
from .helpers import SCHEMA, rows

COLUMNS = {
    "op1_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars valid",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_prob_min_hash": "doc_id class_id class_size",
    "op8_ppm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept removed_words",
}


def documents():
    data = [r for r in rows(11, 40) if r[1] is None or len(r[1]) < 20_000]
    return data + [(300 + i, f"Shared line\nown {i} " + " ".join(f"p{i}q{j}" for j in range(60)), "en", "s9", 0) for i in range(14)] + [(400, data[3][1], "en", "s", 0)]


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn> <turn x"), (2, 0, "assistant", "no"), (3, 0, "system", None), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (3, 3, "user", "c"), (4, None, None, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    spark.createDataFrame([(7, documents()[-3][1])], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert out.columns == COLUMNS[name].split()
    got = out.collect()
    assert len(got) == (5 if name.startswith("op2") else len(documents()))
    data = documents()
    if name.startswith("op1_"):
        assert sorted(map(tuple, got), key=repr) == test_suffix_dedup.brute(data, 200)
    elif name.startswith("op3"):
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data if i is not None)
        assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(16))
    elif name.startswith("op4"):
        assert sorted(map(tuple, got), key=repr) == test_line_dedup.brute(data, 10)
    elif name.startswith("op6"):
        theirs = test_bpe.tokenizers.Tokenizer.from_file(test_bpe.PATH)
        want = []
        for i, t, *_ in data:
            ids = theirs.encode(t or "", add_special_tokens=False).ids
            raw = b"".join(x.to_bytes(4, "little") for x in ids)
            back = theirs.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    elif name.startswith("op7"):
        by = defaultdict(list)
        for r in got:
            by[r.class_id].append(r.doc_id)
        assert sorted((sorted(x, key=repr) for x in by.values()), key=repr) == test_near_dedup.brute(data)
    elif name.startswith("op9"):
        for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(data, key=lambda x: (x[0] is None, x[0]))):
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in test_pii.brute(t or ""))
            assert r.doc_id == i
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() or [x[0] for x in data].count(i) > 1
    elif name.startswith("op10"):
        want = []
        for i, t, *_ in data:
            b = test_quality.base(t)
            want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
        assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.removed_words == 2 and r.kept for r in got if r.doc_id is not None and 300 <= r.doc_id < 314)


def test_decontamination_finds_the_item(spark, sf):
    got = QUERIES["op5_decontamination"](spark, sf).collect()
    assert {(r.item_id, r.score) for r in got} == {(7, 1.0)} and documents()[-3][0] in {r.doc_id for r in got}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet/*.parquet'")
    want = con.sql(SQL[name])
    out = QUERIES[name](spark, sf).select(*[F.col(c) for c in want.columns])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want.fetchall(), key=repr)
