"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cover_tree, decontam, lexical, line_dedup, lm_score, near_dedup, periodic, pii, quality, sharding, suffix_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), length=200)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = chat.format_chats(turns.unionByName(extra))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_learned(F.col("segments")))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id,
       count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + 16)::bigint as formatted_chars,
       regexp_full_match(string_agg(role, chr(1) order by turn nulls first, role, text), '(system\x01)?user\x01assistant(\x01user\x01assistant)*') as valid
from turns group by conv_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_documents(spark, sf_dir), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return line_dedup.drop_report(docs, line_dedup.build_index(docs, limit=10))


OP4_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (select k from keyed where k <> '' group by k having count(distinct r) >= 10)
select doc_id, count(*)::bigint as n_lines,
       count(*) filter (f.k is not null)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.k is null), '')) as kept_sha256
from keyed left join frequent f using (k) group by r, doc_id
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_copies(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), ids=False, digests=True)


def op7_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op8_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_whole(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(_documents(spark, sf_dir))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "removed_words")


def _with_periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of every tenth document, by the checksum of its id, made periodic from some word on."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
            words = texts[i].encode().split() if h % 10 == 0 and texts[i] else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                texts[i] = b" ".join(words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]).decode()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = _documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_with_periods, "doc_id long, text string")
    out = periodic.find_runs(planted, min_words=24, min_repeats=3)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


OP12_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
),
items as (
  select row_number() over () as i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark
),
wanted as (select i, term, count(*) as c from (select i, unnest(terms) as term from items) group by i, term),
totals as (select count(*) filter (len(terms) > 0) as n_docs, coalesce(sum(len(terms)), 0)::bigint as n_terms from docs),
found as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) where term in (select term from wanted) group by r, term),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from found, totals group by term),
parts as (select r, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms as m from docs, totals where len(terms) > 0),
scores as (
  select i, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from wanted join found using (term) join weights using (term) join parts using (r) group by i, r, doc_id
),
ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked join items using (i) where rank <= 10
"""


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_prob_min_hash": op7_prob_min_hash,
    "op8_ppm_scoring": op8_ppm_scoring,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_cover_tree": op13_cover_tree,
}
SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op4_line_dedup": OP4_SQL, "op12_lexical_search": OP12_SQL}
