"""Quality rules: base measures and cross-document line frequency.

One pass over the texts leaves, per document, the base measures and its
distinct lines, each as a hash and a small sketch. All else works on those.

A line in more than ``max_docs`` distinct documents of a host is removed.
Exact copies of a text are one document. Edited copies are documents, but copies
must not deplete each other, so what is counted are documents that are unlike
apart from the line: of each text that holds it, only the lines rarer than the
line under test are looked at, and a text that shares one of the ``SKETCHES``
smallest hashes of their 3-word runs with c texts counts 1 / c. Copies share what
is rare in them and count as one; unrelated pages share nothing rare, however much
furniture they carry, since furniture as frequent as the line or more is not seen.
Further documents that hold a line don't bring it back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch

SKETCHES = 4
#: Value of a sketch without runs.
NOTHING = 0xFFFFFFFF
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class LineRules:
    """``max_docs``: a line in more unlike documents of a host is removed.

    ``min_words``, ``min_share``: a document with fewer words left, or a
    smaller share of its words left, is rejected as depleted.
    """

    max_docs: int = 10
    min_words: int = 20
    min_share: float = 0.3


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (doc, h): whether an equal one stands before, and whether any equal one exists."""
    key = K.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return before, any_


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-split line; an empty text has one."""
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    docs = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([docs, of])
    end = np.concatenate([offsets[1:], breaks])
    by_start, by_end = np.lexsort((start, doc)), np.lexsort((end, np.concatenate([docs, of])))
    return start[by_start], end[by_end], doc[by_start]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Base measures per document; (document, hash, words, sketch) of its distinct lines."""
    n = len(offsets) - 1
    start, end, doc = K.words(data, offsets)
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": _per_doc(~K.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(SYMBOL[data], offsets),
    }
    s = K.prefix_hash(data)
    h = K.span_hash(s, start, end)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        k = np.uint64(0xD6E8FEB86659FD93)
        g = K.mix(K.mix(h[at] * k + h[at + 1]) * k + h[at + 2])
        _, again = _seen_before(doc[at], g)
        for j in range(3):
            covered[at[again] + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    l_start, l_end, l_doc = line_spans(data, offsets)
    first = np.searchsorted(start, l_start)
    in_line = np.searchsorted(start, l_end) - first
    full = in_line > 0
    l_start, l_end, l_doc, first, in_line = (x[full] for x in (l_start, l_end, l_doc, first, in_line))
    before, _ = _seen_before(l_doc, K.span_hash(s, l_start, l_end))
    out["n_dup_lines"] = np.bincount(l_doc[before], minlength=n)
    # a normalised line is its lower-cased words; runs of blanks don't count
    if len(first):
        low = K.word_hashes(data, start, end)
        place = np.arange(len(low)) - np.repeat(first, in_line)
        norm = K.mix(np.add.reduceat(K.mix(low + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first))
        sketch = _line_sketches(low, first, in_line, place, norm)
    else:
        norm, sketch = np.zeros(0, np.uint64), np.zeros((0, SKETCHES), np.uint32)
    norm = norm.view(np.int64)
    order = np.lexsort((norm, l_doc))
    norm, l_doc, in_line, sketch = norm[order], l_doc[order], in_line[order], sketch[order]
    new = np.flatnonzero(np.r_[True, (norm[1:] != norm[:-1]) | (l_doc[1:] != l_doc[:-1])]) if len(norm) else np.zeros(0, np.int64)
    words = np.add.reduceat(in_line, new) if len(new) else in_line
    return out, (l_doc[new], norm[new], words, sketch[new])


def _line_sketches(low: np.ndarray, first: np.ndarray, in_line: np.ndarray, place: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Smallest hash of each line's 3-word runs, under each hash function; a shorter line is one run."""
    k = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(len(low), np.uint64)
    if len(low) >= 3:
        run[:-2] = K.mix(K.mix(low[:-2] * k + low[1:-1]) * k + low[2:])
    short = in_line < 3
    run[first[short]] = norm[short]
    valid = place + 2 < np.repeat(in_line, in_line)
    valid[first[short]] = True
    out = np.empty((len(first), SKETCHES), np.uint32)
    for j in range(SKETCHES):
        value = K.mix(run + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & K.ALL)) >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(np.where(valid, value, np.uint64(NOTHING)), first)
    return out


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64)))


def profile(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Written table: row, id, key, host, the base measures and the distinct lines of every text."""
    id_type = "long" if id_col is None else dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(4))
            for a, b, d, o in K.blocks(data, offsets):
                out, (doc, norm, words, sketch) = measure(d, o)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                columns = [batch.column(i).slice(a, b - a) for i in range(4)]
                columns += [pa.array(out[x].astype(np.int64)) for x in BASE] + [_lists(at, x) for x in (norm, words)]
                columns.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 4 * SKETCHES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sketch))]))
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "key", "host", *BASE, "line", "words", "sketch"])

    picked = docs.select(
        F.monotonically_increasing_id().alias("row"),
        (F.lit(None).cast("long") if id_col is None else docs[id_col]).alias("id"),
        scratch.text_key(text_col).alias("key"),
        docs[host_col].cast("string").alias("host"),
        docs[text_col].cast("string").alias("text"),
    )
    schema = f"row long, id {id_type}, key binary, host string, {', '.join(f'{x} long' for x in BASE)}, line array<long>, words array<long>, sketch binary"
    site = F.xxhash64(F.col("host").isNull(), F.coalesce("host", F.lit("")))
    return scratch.table(picked.mapInArrow(run, schema).withColumn("site", site), "quality")


def _rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each frequent line of a text, the sketch of the text's lines that are rarer."""
    for batch in batches:
        size, rows, lines, values = [], [], [], []
        for row, line, sketch, often, docs in zip(*(batch.column(i) for i in range(1, 6))):
            line, often, docs = (np.asarray(x.values) for x in (line, often, docs))
            sketch = np.frombuffer(sketch.as_buffer(), np.uint32).reshape(-1, SKETCHES)
            order = np.argsort(docs, kind="stable")
            often, docs = often[order], docs[order]
            plain = sketch[~np.isin(line, often)]
            # distinct lines are sorted by hash
            known = np.vstack([plain.min(axis=0) if len(plain) else np.full(SKETCHES, NOTHING, np.uint32), sketch[np.searchsorted(line, often)]])
            size.append(len(often))
            rows.append(row.as_py())
            lines.append(often)
            values.append(np.minimum.accumulate(known, axis=0)[np.searchsorted(docs, docs)])
        of = pa.array(np.repeat(np.arange(len(size)), size))
        value = np.concatenate(values) if values else np.zeros((0, SKETCHES), np.uint32)
        listed = _lists(np.arange(len(value) + 1) * SKETCHES, value.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.repeat(rows, size), pa.int64()), pa.array(np.concatenate(lines) if lines else [], pa.int64()), listed], ["site", "row", "line", "value"])


def frequent_lines(profiled: DataFrame, rules: LineRules) -> DataFrame:
    """Written table: (site, line) found in more than ``max_docs`` unlike texts of the host."""
    lines = profiled.select("site", F.xxhash64("key").alias("text"), "row", F.explode("line").alias("line"))
    distinct = lines.groupBy("site", "line", "text").agg(F.min("row").alias("row"))
    often = distinct.groupBy("site", "line").agg(F.count("row").alias("docs")).filter(F.col("docs") > rules.max_docs)
    often = often.select(F.col("site").alias("o_site"), F.col("line").alias("o_line"), "docs")
    # no aggregate needs these joins' order, so a hot line's rows can be split
    held = distinct.join(often, (F.col("line") == F.col("o_line")) & (F.col("site") == F.col("o_site")))
    held = held.groupBy("row").agg(F.collect_list(F.struct("line", "docs")).alias("held"))
    held = held.select(F.col("row").alias("h_row"), F.col("held.line").alias("often"), F.col("held.docs").alias("docs"))
    texts = profiled.select("site", "row", "line", "sketch").join(held, F.col("row") == F.col("h_row")).select("site", "row", "line", "sketch", "often", "docs")
    rarer = scratch.table(texts.mapInArrow(_rarer, "site long, row long, line long, value array<long>"), "quality-rarer")
    values = rarer.select("site", "line", "row", F.posexplode("value").alias("j", "value"))
    shared = values.groupBy("site", "line", "j", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = scratch.table(shared.withColumnsRenamed({x: f"s_{x}" for x in ("site", "line", "j", "value")}), "quality-shared")
    alike = values.join(shared, [F.col(x) == F.col(f"s_{x}") for x in ("site", "line", "j", "value")], "left")
    each = alike.groupBy("site", "line", "row").agg(F.max(F.coalesce("c", F.lit(1))).alias("c"))
    unlike = each.groupBy("site", "line").agg(F.round(F.sum(1 / F.col("c")), 6).alias("unlike"))
    found = scratch.table(unlike.filter(F.col("unlike") > rules.max_docs).select("site", "line"), "quality-lines")
    scratch.remove(rarer)
    scratch.remove(shared)
    return found


def verdicts(profiled: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The profile's rows with base_failed, kept, and the frequent lines of each document.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word
    windows. kept is false if base_failed; else it is false if the frequent
    lines leave fewer than ``min_words`` words or less than ``min_share`` of
    them. A null host is a host of its own.
    """
    lines = profiled.select("row", "site", F.explode(F.arrays_zip("line", "words")).alias("x")).select("row", "site", "x.line", "x.words")
    frequent = frequent_lines(profiled, rules).withColumnsRenamed({"site": "f_site", "line": "f_line"})
    # no aggregate needs this join's order, so a hot line's rows can be split
    dropped = lines.join(frequent, (F.col("line") == F.col("f_line")) & (F.col("site") == F.col("f_site")), "inner")
    removed = dropped.groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    depleted = (left < rules.min_words) | (left < rules.min_share * F.col("n_words"))
    return (
        profiled.drop("line", "words", "sketch", "site")
        .join(removed, "row", "left")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~depleted)
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    )


def apply_rules(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, base measures, base_failed, kept, removed_words.

    Null text: no words. Empty and very long texts, repeated rows and repeated
    ids each give their own row. Other columns are not read. An empty table
    gives an empty result.
    """
    judged = verdicts(profile(docs, id_col, text_col, host_col), rules)
    return judged.select(F.col("id").alias(id_col), *BASE, "base_failed", "kept", "removed_words")


def filter_documents(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept documents, all their columns, with frequent lines taken out of their texts.

    A verdict depends on text and host alone, so it is found once per distinct
    pair and joined to the rows. Null and empty texts have no words and go;
    a null host is a host of its own; every repeated row has the same fate;
    columns may have any names; an empty table stays empty.
    """
    judged = verdicts(profile(docs, None, text_col, host_col), rules)
    own_key, key, host, gone = scratch.free_names(docs, 4)
    once = (
        judged.filter("kept")
        .groupBy("key", "host")
        .agg(F.first("removed_lines").alias("removed_lines"))
        .withColumnsRenamed({"key": key, "host": host, "removed_lines": gone})
    )
    keyed = docs.withColumn(own_key, scratch.text_key(text_col))
    kept = keyed.join(once, (F.col(own_key) == F.col(key)) & F.col(host_col).cast("string").eqNullSafe(F.col(host)), "inner")
    place, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(len(columns)).to_pylist()
            if any(drops):
                texts = batch.column(place).to_pylist()
                for i, drop in enumerate(drops):
                    if drop:
                        texts[i] = _without(texts[i], set(drop))
                batch = batch.set_column(place, columns[place], pa.array(texts, pa.string()))
            yield batch.select(columns)

    return kept.select(*columns, gone).mapInArrow(run, docs.schema)


def _without(text: str, drop: set[int]) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    start, end, _ = K.words(data, offsets)
    low = K.word_hashes(data, start, end)
    l_start, l_end, _ = line_spans(data, offsets)
    lines, raw = [], data.tobytes()
    for a, b in zip(l_start.tolist(), l_end.tolist()):
        i, j = np.searchsorted(start, [a, b])
        if j > i:
            place = np.arange(j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h = K.mix(np.add.reduce(K.mix(low[i:j] + place), keepdims=True)).view(np.int64)[0]
            if int(h) in drop:
                continue
        lines.append(raw[a:b])
    return b"\n".join(lines).decode()
