"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

``counts`` is the exact table: how many documents hold each line key. It takes
insertions and deletions of documents as signed sums, so any insertion can be
undone. ``filters`` holds one cuckoo filter per shard of the keys at or above
the limit; a later change inserts and deletes just the keys that crossed it.

Dropping lines: only lines that the filters let through are looked up in the
exact table, which alone decides. Filters that together stay under
``FILTER_BYTES`` go to every task; beyond that, lines are dealt to their
shard's filter, a shard with many lines in several parts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .cuckoo import CuckooFilter

#: Characters stripped from both ends of a line for its key.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
FILTER_BYTES = 32 << 20
SHARD_KEYS = 50_000
#: Lines that meet one filter in one task, where filters are not sent to all.
PART_LINES = 500_000
FLUSH = 200_000
_KEY = np.dtype([("hi", "<i8"), ("lo", "<i8")])


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and the 128-bit key of each; None for a blank line."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip(BLANK).lower() for x in lines]  # bytes.lower() touches A-Z only
    return lines, [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in keys]


def _columns(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(keys), _KEY)
    return a["hi"].copy(), a["lo"].copy()


def count_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """hi, lo, docs: the number of rows of ``docs`` that hold each line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            hi, lo = _columns(list(held))
            out = pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(list(held.values()), pa.int64())], ["hi", "lo", "docs"])
            held.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                held.update({k for k in line_keys(value.as_py())[1] if k})
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    found = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "hi long, lo long, docs long")
    return found.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


@dataclass(frozen=True)
class LineIndex:
    """Exact counts and the filters of the keys found in ``limit`` documents or more."""

    counts: DataFrame  # hi, lo, docs
    filters: DataFrame  # shard, cells
    shards: int
    limit: int

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("docs") >= self.limit).select("hi", "lo")


def _shard(shards: int):
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    cells = CuckooFilter.build(pdf["hi"].to_numpy(), pdf["lo"].to_numpy()).to_bytes()
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "cells": [cells]})


def build_index(docs: DataFrame, limit: int = 10, text_col: str = "text") -> LineIndex:
    """Index of all rows of ``docs``; a repeated row is a document more."""
    counts = scratch.table(count_lines(docs, text_col), "line-counts")
    frequent = counts.filter(F.col("docs") >= limit)
    shards = max(1, math.ceil(frequent.count() / SHARD_KEYS))
    filters = frequent.select("hi", "lo", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(_build, "shard int, cells binary")
    return LineIndex(counts, scratch.table(filters, "line-filters"), shards, limit)


def update_index(index: LineIndex, docs: DataFrame, text_col: str = "text", delete: bool = False) -> LineIndex:
    """The index after inserting ``docs``, or after deleting documents it holds.

    Deleting what was inserted gives the former counts back exactly.
    """
    sign = -1 if delete else 1
    delta = count_lines(docs, text_col).withColumn("docs", F.col("docs") * sign)
    both = index.counts.withColumn("old", F.col("docs")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
    counts = scratch.table(both.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.sum("old").alias("old")), "line-counts")
    if counts.filter("docs < 0").limit(1).count():
        raise ValueError("documents to delete are not all in the index")
    limit, shards = index.limit, index.shards
    crossed = counts.filter((F.col("docs") >= limit) != (F.col("old") >= limit)).select(
        "hi", "lo", (F.col("docs") >= limit).alias("up"), _shard(shards).alias("shard")
    )
    held = counts.filter(F.col("docs") >= limit).select("hi", "lo", _shard(shards).alias("shard"))

    def change(key: tuple, old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        if old.empty:
            f = CuckooFilter(SHARD_KEYS)
        else:
            f = CuckooFilter.from_bytes(old["cells"].iloc[0])
        full = False
        for hi, lo, up in zip(moved["hi"], moved["lo"], moved["up"]):
            full |= not (f.insert(hi, lo) if up else f.delete(hi, lo))
        return pd.DataFrame({"shard": [key[0]], "cells": [f.to_bytes()], "full": [full]})

    changed = index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(change, "shard int, cells binary, full boolean")
    changed = scratch.table(changed, "line-filters")
    rebuilt = held.join(changed.filter("full").select("shard"), "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard int, cells binary")
    filters = scratch.table(changed.filter("not full").drop("full").unionByName(rebuilt), "line-filters")
    return LineIndex(counts.filter("docs > 0").drop("old"), filters, shards, limit)


def _probe(index: LineIndex) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """A test for keys that may be frequent, for every task; None if the filters are too large to send."""
    size = index.filters.select(F.coalesce(F.sum(F.length("cells")), F.lit(0)).alias("n")).first().n
    if size > FILTER_BYTES:
        return None
    spark = index.filters.sparkSession
    cells = spark.sparkContext.broadcast([(r.shard, bytes(r.cells)) for r in index.filters.toLocalIterator()])
    held: dict[int, CuckooFilter] = {}
    shards = index.shards

    def test(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if not held:
            held.update({s: CuckooFilter.from_bytes(c) for s, c in cells.value})
        out, shard = np.zeros(len(hi), bool), np.mod(lo, shards)
        for s in np.unique(shard).tolist():
            if s in held:
                at = np.flatnonzero(shard == s)
                out[at] = held[s].contains(hi[at], lo[at])
        return out

    return test


def _through_filters(lines: DataFrame, index: LineIndex) -> DataFrame:
    """The rows of ``lines`` (key, hi, lo) that their shard's filter lets through.

    A shard's parts follow from the exact counts, so a very common line is
    spread over many tasks, each with a copy of that one filter.
    """
    held = index.counts.groupBy(_shard(index.shards).alias("shard")).agg(F.ceil(F.sum("docs") / PART_LINES).cast("int").alias("parts"))
    held = scratch.table(held.join(index.filters, "shard"), "line-parts")
    filters = held.select("shard", "cells", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a few bytes for every SHARD_KEYS frequent lines
    placed = lines.withColumn("shard", _shard(index.shards)).join(F.broadcast(held.select("shard", "parts")), "shard")
    placed = placed.select("shard", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "hi", "lo")

    def test(own: pa.Table, cells: pa.Table) -> pa.Table:
        rows = own.select(["key", "hi", "lo"])
        if not len(cells):
            return rows.slice(0, 0)
        held = CuckooFilter.from_bytes(cells.column("cells")[0].as_py())
        return rows.filter(pa.array(held.contains(rows.column("hi").to_numpy(), rows.column("lo").to_numpy())))

    return placed.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(test, "key binary, hi long, lo long")


def frequent_in_texts(docs: DataFrame, index: LineIndex, text_col: str = "text") -> DataFrame:
    """key, lines: the frequent lines of each distinct text that has some."""
    probe = _probe(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keys = [], []
            for key, value in zip(batch.column(0), batch.column(1)):
                own = {k for k in line_keys(value.as_py())[1] if k}
                keys += own
                whole += [key.as_py()] * len(own)
            if not keys:
                continue
            hi, lo = _columns(keys)
            out = pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array(hi), pa.array(lo)], ["key", "hi", "lo"])
            if probe is not None:
                out = out.filter(pa.array(probe(hi, lo)))
            if out.num_rows:
                yield out

    keyed = docs.select(scratch.text_key(text_col).alias("key"), docs[text_col].cast("string").alias("text"))
    lines = keyed.mapInArrow(run, "key binary, hi long, lo long")
    if probe is None:
        lines = _through_filters(lines, index)
    frequent = index.frequent().withColumnsRenamed({"hi": "f_hi", "lo": "f_lo"})
    found = lines.join(frequent, (F.col("hi") == F.col("f_hi")) & (F.col("lo") == F.col("f_lo")), "inner")
    # written, so that the join with the texts has a shuffle of its own on each side and a hot text's rows can be split
    return scratch.table(found.groupBy("key").agg(F.collect_set(F.struct("hi", "lo")).alias("lines")), "line-drops")


def _joined(docs: DataFrame, index: LineIndex, text_col: str) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with their frequent lines, and that column's name."""
    own_key, key, gone = scratch.free_names(docs, 3)
    drops = frequent_in_texts(docs, index, text_col).withColumnsRenamed({"key": key, "lines": gone})
    keyed = docs.withColumn(own_key, scratch.text_key(text_col))
    return keyed.join(drops, F.col(own_key) == F.col(key), "left"), gone


def _kept(text: str | None, drop: list[dict] | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines and what stays."""
    if not drop:
        raw = (text or "").encode("utf-8", "surrogatepass")
        return raw.count(b"\n") + 1, 0, raw
    gone = {np.array([(x["hi"], x["lo"])], _KEY).tobytes() for x in drop}
    lines, keys = line_keys(text)
    stay = [x for x, k in zip(lines, keys) if k not in gone]
    return len(lines), len(lines) - len(stay), b"\n".join(stay)


def drop_report(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 of every row.

    A null or empty text is one blank line; blank lines are never counted or
    dropped. Repeated rows give repeated results and each counts as a
    document. Other columns are not read. An empty table gives an empty result.
    """
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_kept(t.as_py(), d.as_py()) for t, d in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.int64()),
                    pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()),
                ],
                ["id", "n_lines", "n_dropped", "kept_sha256"],
            )

    schema = f"id {dict(docs.dtypes)[id_col]}, n_lines long, n_dropped long, kept_sha256 string"
    joined, gone = _joined(picked, index, "text")
    return joined.select("id", "text", gone).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, index: LineIndex, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, frequent lines taken out of the texts.

    A null or empty text stays as it is; a text that loses all lines becomes
    empty; repeated rows stay repeated; columns may have any names; an empty
    table stays empty.
    """
    columns = docs.columns
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(len(columns)).to_pylist()
            if any(drops):
                texts = [_kept(t, d)[2].decode() if d else t for t, d in zip(batch.column(place).to_pylist(), drops)]
                batch = batch.set_column(place, columns[place], pa.array(texts, pa.string()))
            yield batch.select(columns)

    joined, gone = _joined(docs, index, text_col)
    return joined.select(*columns, gone).mapInArrow(run, docs.schema)
