"""Language-model scores: byte PPM, and a smoothed unigram base.

The PPM trie is counted over the training rows and then fixed. ``score_whole``
has depth ``DEPTH`` at every size: the gram counts stay a Spark table, the
probabilities are worked out by groups of two-byte contexts (all longer
contexts lie within one, all shorter ones fit in 65,536 rows), and a chunk's
distinct grams are joined with them bucket by bucket. ``score`` is the form for
small corpora, with one trie sent to all tasks: its depth is ``DEPTH``, or the
largest smaller one whose trie has at most ``TRIE_GRAMS`` entries.

The unigram base needs each word's count over the corpus in each document.
Documents are taken in chunks of about ``CHUNK_BYTES``. A chunk sends each of
its distinct words once, grouped in buckets by hash, gets the corpus counts
back bucket by bucket, and applies them to its own (document, word) list. No
word, however common, brings more than one entry per chunk together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import ppm, scratch

DEPTH = 4
TRIE_GRAMS = 2_000_000
CHUNK_BYTES = 3 << 20
#: Symbols take many bytes of working memory each, so blocks are small.
SCORE_BLOCK = 1 << 17
BUCKET_WORDS = 200_000
BUCKET_GRAMS = 1_000_000
#: Distinct grams of a group of two-byte contexts.
GROUP_GRAMS = 300_000
#: Bytes of a packed value; grams of DEPTH + 1 bytes and logarithms in whole units fit.
PLANES, LOG_UNITS = 5, 2.0**33
#: Distinct words expected per byte of a chunk; only sizes buckets.
WORDS_PER_BYTE = 0.045
#: The same for grams.
GRAMS_PER_BYTE = 0.08


def held_out(id_col: str):
    """crc32 of the id as text, modulo 10, is 0; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def train(docs: DataFrame) -> tuple[ppm.Trie, int, int]:
    """The trie of the training rows of (held, text), their number, and the bytes of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            key, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key)
            key, n = key[order], n[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(np.add.reduceat(n, new))], ["key", "n"])

        for batch in batches:
            train = batch.filter(pc.invert(batch.column(0)))
            size += K.column_bytes(batch.column(1))[1][-1]
            rows += train.num_rows
            data, offsets = K.column_bytes(train.column(1))
            for _, _, d, o in K.blocks(data, offsets, SCORE_BLOCK):
                key, n = np.unique(ppm.padded(d, o, DEPTH)[0], return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 500_000:
                    yield flush()
        if keys:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array([int(rows), int(size)], pa.int64())], ["key", "n"])

    grams = scratch.table(docs.select("held", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    totals = {r.key: r.n for r in grams.filter("key < 0").collect()}  # two rows
    grams, depth = grams.filter("key >= 0"), DEPTH
    while depth > 1 and grams.count() > TRIE_GRAMS:
        depth -= 1
        grams = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        grams = scratch.table(grams, "lm-grams")
    held = grams.toArrow()  # at most TRIE_GRAMS rows
    trie = ppm.Trie(held.column("key").to_numpy().astype(np.uint64), held.column("n").to_numpy(), depth)
    return trie, int(totals.get(-1, 0)), int(totals.get(-2, 0))


def _chunks(docs: DataFrame, id_type: str, trie: ppm.Trie, buckets: int) -> DataFrame:
    """Written table with, for each chunk, its documents (bucket -1) and its words by bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(trie)
    names = ["chunk", "bucket", "ids", "held", "tokens", "scores", "cut", "places", "times"]

    def pack(chunk: int, ids: list, held: list, tokens: list, scores: list, words: list, docs_of: list) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(words), np.concatenate(docs_of)
        held_all, n_docs = np.concatenate(held), sum(map(len, tokens))
        distinct, inverse = np.unique(h, return_inverse=True)
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((distinct, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair, times = np.unique(doc * max(1, len(distinct)) + place[inverse], return_counts=True)
        of, at = pair // max(1, len(distinct)), pair % max(1, len(distinct))
        id_all = pa.chunked_array(ids).combine_chunks()
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if kind else x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk], pa.int64()),
                pa.array([-1], pa.int32()),
                one(id_all, None),
                one(held_all, pa.bool_()),
                one(np.concatenate(tokens), pa.int64()),
                one(np.concatenate(scores), pa.float64()),
                one(np.searchsorted(of, np.arange(n_docs + 1)), pa.int64()),
                one(at, pa.int64()),
                one(times.astype(np.int32), pa.int32()),
            ],
            names,
        )
        train_count = np.bincount(inverse, weights=~held_all[doc], minlength=len(distinct)).astype(np.int64)[order]
        sorted_bucket = bucket[order]
        head = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]]) if len(order) else np.zeros(0, np.int64)
        cut = pa.array(np.r_[head, len(order)], pa.int32())
        n = len(head)
        null = lambda kind: pa.nulls(n, pa.list_(kind))
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, chunk)),
                    pa.array(sorted_bucket[head], pa.int32()),
                    null(id_all.type),
                    null(pa.bool_()),
                    null(pa.int64()),
                    null(pa.float64()),
                    null(pa.int64()),
                    pa.ListArray.from_arrays(cut, pa.array(distinct[order].view(np.int64))),
                    pa.ListArray.from_arrays(cut, pa.array(train_count.astype(np.int32))),
                ],
                names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        held: list[list] = [[] for _ in range(6)]
        size = n_docs = 0
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, d, o in K.blocks(data, offsets, SCORE_BLOCK):
                start, end, doc = K.words(d, o)
                keys, of = ppm.padded(d, o, sent.value.depth)
                score = np.bincount(of, weights=sent.value.log10(keys), minlength=b - a)
                for part, x in zip(
                    held,
                    (batch.column(0).slice(a, b - a), out[a:b], np.bincount(doc, minlength=b - a) + 1, score, K.word_hashes(d, start, end), doc + n_docs),
                ):
                    part.append(x)
                size += len(d)
                n_docs += b - a
                if size >= CHUNK_BYTES:
                    yield from pack(chunk, *held)
                    chunk += 1
                    held, size, n_docs = [[] for _ in range(6)], 0, 0
        if n_docs:
            yield from pack(chunk, *held)

    schema = f"chunk long, bucket int, ids array<{id_type}>, held array<boolean>, tokens array<long>, scores array<double>, cut array<long>, places array<long>, times array<int>"
    return scratch.table(docs.select("id", "held", "text").mapInArrow(run, schema), "lm-chunks")


def _corpus_counts(group: pa.Table) -> pa.Table:
    """For one bucket: the corpus count of each chunk's words, and (chunk -1) what the bucket adds to N and V."""
    group = group.combine_chunks()
    words, times = group.column("places").chunk(0), group.column("times").chunk(0)
    cut = words.offsets.to_numpy()
    flat = words.values.to_numpy()[cut[0] : cut[-1]]
    _, inverse = np.unique(flat, return_inverse=True)
    own = times.values.to_numpy()[times.offsets.to_numpy()[0] : times.offsets.to_numpy()[-1]]
    total = np.zeros(int(inverse.max()) + 1 if len(flat) else 0, np.int64)
    np.add.at(total, inverse, own)
    back = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(total[inverse]))
    bucket = group.column("bucket")[0].as_py()
    added = pa.array([[int(total.sum()), int((total > 0).sum())]], pa.list_(pa.int64()))
    return pa.table(
        {
            "chunk": pa.concat_arrays([group.column("chunk").chunk(0), pa.array([-1], pa.int64())]),
            "bucket": pa.array([bucket] * (len(group) + 1), pa.int32()),
            "counts": pa.concat_arrays([back, added]),
        }
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text; rows whose id's crc32 modulo 10 is not 0 train.

    Returns id, held_out, n_tokens (words and one end), n_known, train_tokens,
    base_score and score, both log10 probabilities of the text. A null or
    empty text is one end. A null id counts as the empty id text, so it is
    held out. Repeated rows count and are scored as often as they stand there.
    Other columns are not read. An empty table gives an empty result; without
    training rows the model is uniform. Words are told apart by 64-bit hashes.
    """
    id_type = dict(docs.dtypes)[id_col]
    picked = docs.select(docs[id_col].alias("id"), held_out(id_col).alias("held"), docs[text_col].cast("string").alias("text"))
    trie, train_docs, size = train(picked)
    buckets = max(1, math.ceil(size * WORDS_PER_BYTE / BUCKET_WORDS))
    chunks = _chunks(picked, id_type, trie, buckets)
    words = chunks.filter("bucket >= 0").select("chunk", "bucket", "places", "times")
    counts = words.groupBy("bucket").applyInArrow(_corpus_counts, "chunk long, bucket int, counts array<long>")
    counts = scratch.table(counts, "lm-counts")
    total = counts.filter("chunk < 0").agg(F.sum(F.col("counts")[0]).alias("n"), F.sum(F.col("counts")[1]).alias("v")).first()
    train_tokens = int(total.n or 0) + train_docs
    log_all = math.log10(train_tokens + 0.1 * (int(total.v or 0) + (train_docs > 0) + 1))

    def finish(own: pa.Table, back: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        order = np.argsort(back.column("bucket").to_numpy(), kind="stable")
        lists = back.column("counts").take(pa.array(order)).combine_chunks() if len(back) else None
        known = lists.flatten().to_numpy() if lists is not None else np.zeros(0, np.int64)
        flat = lambda name: own.column(name).combine_chunks().flatten()
        tokens, cut, at, times = (flat(x).to_numpy(zero_copy_only=False) for x in ("tokens", "cut", "places", "times"))
        c = known[at] if len(at) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(tokens)), np.diff(cut))
        logs = np.bincount(of, weights=times * np.log10(c + 0.1), minlength=len(tokens))
        n_known = np.bincount(of, weights=times * (c > 0), minlength=len(tokens)).astype(np.int64) + (train_docs > 0)
        base = logs + math.log10(train_docs + 0.1) - tokens * log_all
        return pa.table([flat("ids"), flat("held"), pa.array(tokens), pa.array(n_known), pa.array(np.full(len(tokens), train_tokens)), pa.array(base), flat("scores")], names=names)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left = chunks.filter("bucket = -1").drop("bucket").groupBy("chunk")
    right = counts.filter("chunk >= 0").groupBy("chunk")
    return left.cogroup(right).applyInArrow(finish, schema).withColumnRenamed("id", id_col)


def _gram_counts(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Written table (key, n) of all grams of (held, text), n from training rows alone; their number, and the bytes of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            out = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            rows += int((~out).sum())
            data, offsets = K.column_bytes(batch.column(1))
            size += offsets[-1]
            for a, b, d, o in K.blocks(data, offsets, SCORE_BLOCK):
                key, of = ppm.padded(d, o, DEPTH)
                trains = ~out[a:b][of]
                for part, one in ((key[trains], 1), (key[~trains], 0)):
                    part, n = np.unique(part, return_counts=True)
                    keys.append(part)
                    counts.append(n * one)
                if sum(map(len, keys)) > 500_000:
                    yield flush()
        if keys:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array([rows, int(size)], pa.int64())], ["key", "n"])

    grams = scratch.table(docs.select("held", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    totals = {r.key: r.n for r in grams.filter("key < 0").collect()}  # two rows
    return grams.filter("key >= 0"), int(totals.get(-1, 0)), int(totals.get(-2, 0))


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(values: np.ndarray, head: np.ndarray) -> pa.Array:
    """The values below 2**40 from each ``head`` to the next as one string: all lowest bytes, then all next ones.

    Sorted keys share their high bytes, so these strings shrink to a fraction
    of eight bytes a key when written or sent.
    """
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PLANES]
    return pa.array([planes[a:b].T.tobytes() for a, b in zip(head.tolist(), [*head[1:].tolist(), len(values)])], pa.binary())


def _unpacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all strings, and where each begins, with the end."""
    parts = []
    for value in column:
        planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(PLANES, -1)
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :PLANES] = planes.T
        parts.append(wide.view("<u8").ravel())
    return np.concatenate(parts or [np.zeros(0, np.uint64)]), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)


def _fixed(logs: np.ndarray) -> np.ndarray:
    """Logarithms from -128 to 0 as whole numbers below 2**40, to 33 bits after the point."""
    return np.minimum(np.rint(-logs * LOG_UNITS), 2.0 ** (8 * PLANES) - 1).astype(np.uint64)


def _gram_logs(grams: DataFrame, buckets: int) -> DataFrame:
    """Written table (bucket, grams, logs): log10 probability of every gram at full depth."""
    short = grams.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n"))
    rows = sorted((r.key, r.n) for r in short.collect())  # at most 65,536: one byte of context and one symbol
    base = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)
    sent = grams.sparkSession.sparkContext.broadcast(base)
    groups = max(1, math.ceil(grams.count() / GROUP_GRAMS))

    def one_group(group: pa.Table) -> pa.Table:
        key, n = group.column("key").to_numpy().astype(np.uint64), group.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        logs = ppm.Trie(key[n > 0], n[n > 0], DEPTH, sent.value).log10(key)
        bucket = _gram_bucket(key, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return pa.table([pa.array(bucket[head].astype(np.int32)), _packed(key[order], head), _packed(_fixed(logs)[order], head)], names=["bucket", "grams", "logs"])

    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = grams.withColumn("part", F.pmod(F.xxhash64(context), F.lit(groups))).groupBy("part")
    return scratch.table(dealt.applyInArrow(one_group, "bucket int, grams binary, logs binary"), "lm-logs")


def _chunk_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [np.unique(ppm.padded(d, o, DEPTH)[0]) for _, _, d, o in K.blocks(data, offsets, SCORE_BLOCK)]
    return np.unique(np.concatenate(parts))


def _dealt(keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sorted keys by bucket, the buckets that occur, and where each begins in that order."""
    order = np.argsort(bucket, kind="stable")
    head = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    return order, bucket[order][head], head


def _text_chunks(docs: DataFrame, id_type: str, buckets: int, gram_buckets: int) -> DataFrame:
    """Written table with, for each chunk, its documents (kind 0), and its words (1) and grams (2) by bucket."""
    names = ["chunk", "kind", "bucket", "ids", "held", "texts", "places", "times", "grams"]
    types = [pa.int64(), pa.int32(), pa.int32()]

    def pack(chunk: int, ids: list, held: np.ndarray, texts: list) -> Iterator[pa.RecordBatch]:
        id_all, text_all = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(texts).combine_chunks()
        list_types = [*(pa.list_(x) for x in (id_all.type, pa.bool_(), pa.binary(), pa.int64(), pa.int32())), pa.binary()]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (id_all, pa.array(held), text_all)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([x], t) for x, t in zip((chunk, 0, -1), types)), *whole, *(pa.nulls(1, t) for t in list_types[3:])], names
        )
        data, offsets = K.column_bytes(text_all)
        start, end, doc = K.words(data, offsets)
        distinct, inverse = np.unique(K.word_hashes(data, start, end), return_inverse=True)
        trains = np.bincount(inverse, weights=~held[doc], minlength=len(distinct)).astype(np.int32)
        grams = _chunk_grams(data, offsets)
        for kind, keys, times, bucket in (
            (1, distinct, trains, (distinct % np.uint64(buckets)).astype(np.int64)),
            (2, grams, None, _gram_bucket(grams, gram_buckets)),
        ):
            order, of, head = _dealt(keys, bucket)
            n, cut = len(head), pa.array(np.r_[head, len(order)], pa.int32())
            if n and kind == 1:
                own = [pa.ListArray.from_arrays(cut, pa.array(keys[order].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times[order])), pa.nulls(n, pa.binary())]
            elif n:
                own = [*(pa.nulls(n, t) for t in list_types[3:5]), _packed(keys[order], head)]
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, chunk)),
                        pa.array(np.full(n, kind), pa.int32()),
                        pa.array(of, pa.int32()),
                        *(pa.nulls(n, t) for t in list_types[:3]),
                        *own,
                    ],
                    names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list = []
        texts: list = []
        size = 0
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, d, o in K.blocks(data, offsets, SCORE_BLOCK):
                ids.append(batch.column(0).slice(a, b - a))
                held.append(out[a:b])
                texts.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(d.tobytes())]))
                size += len(d)
                if size >= CHUNK_BYTES:
                    yield from pack(chunk, ids, np.concatenate(held), texts)
                    chunk += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield from pack(chunk, ids, np.concatenate(held), texts)

    schema = f"chunk long, kind int, bucket int, ids array<{id_type}>, held array<boolean>, texts array<binary>, places array<long>, times array<int>, grams binary"
    return scratch.table(docs.select("id", "held", "text").mapInArrow(run, schema), "lm-chunks")


def _logs_back(chunks: pa.Table, table: pa.Table) -> pa.Table:
    """For one bucket: the log10 probabilities of each chunk's grams."""
    keys, _ = _unpacked(table.column("grams"))
    order = np.argsort(keys)
    logs = _unpacked(table.column("logs"))[0][order]
    wanted, cut = _unpacked(chunks.column("grams"))
    back = _packed(logs[np.searchsorted(keys[order], wanted)], cut[:-1])
    return pa.table([chunks.column("chunk").combine_chunks(), chunks.column("bucket").combine_chunks(), back], names=["chunk", "bucket", "logs"])


def score_whole(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` with a trie of full depth at every size of the corpus; same columns and rules."""
    id_type = dict(docs.dtypes)[id_col]
    picked = docs.select(docs[id_col].alias("id"), held_out(id_col).alias("held"), docs[text_col].cast("string").alias("text"))
    grams, train_docs, size = _gram_counts(picked)
    buckets = max(1, math.ceil(size * WORDS_PER_BYTE / BUCKET_WORDS))
    gram_buckets = max(1, math.ceil(size * GRAMS_PER_BYTE / BUCKET_GRAMS))
    logs = _gram_logs(grams, gram_buckets)
    scratch.remove(grams)
    chunks = _text_chunks(picked, id_type, buckets, gram_buckets)
    words = chunks.filter("kind = 1").select("chunk", "bucket", "places", "times")
    counts = words.groupBy("bucket").applyInArrow(_corpus_counts, "chunk long, bucket int, counts array<long>")
    counts = scratch.table(counts, "lm-counts")
    total = counts.filter("chunk < 0").agg(F.sum(F.col("counts")[0]).alias("n"), F.sum(F.col("counts")[1]).alias("v")).first()
    train_tokens = int(total.n or 0) + train_docs
    log_all = math.log10(train_tokens + 0.1 * (int(total.v or 0) + (train_docs > 0) + 1))
    wanted = chunks.filter("kind = 2").select("chunk", "bucket", "grams").groupBy("bucket")
    gram_back = wanted.cogroup(logs.groupBy("bucket")).applyInArrow(_logs_back, "chunk long, bucket int, logs binary")

    def by_bucket(back: pa.Table, name: str) -> pa.ChunkedArray:
        back = back.filter(pc.is_valid(back.column(name)))
        return back.column(name).take(pa.array(np.argsort(back.column("bucket").to_numpy(), kind="stable")))

    def finish(own: pa.Table, back: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids, held, texts = (own.column(x).combine_chunks().flatten() for x in ("ids", "held", "texts"))
        data, offsets = K.column_bytes(texts)
        n_docs = len(texts)
        start, end, doc = K.words(data, offsets)
        distinct, inverse = np.unique(K.word_hashes(data, start, end), return_inverse=True)
        c = np.zeros(len(distinct), np.int64)
        c[_dealt(distinct, (distinct % np.uint64(buckets)).astype(np.int64))[0]] = by_bucket(back, "counts").combine_chunks().flatten().to_numpy()
        tokens = np.bincount(doc, minlength=n_docs) + 1
        base = np.bincount(doc, weights=np.log10(c + 0.1)[inverse], minlength=n_docs) + math.log10(train_docs + 0.1) - tokens * log_all
        n_known = np.bincount(doc, weights=(c > 0)[inverse], minlength=n_docs).astype(np.int64) + (train_docs > 0)
        grams = _chunk_grams(data, offsets)
        log = np.zeros(len(grams))
        log[_dealt(grams, _gram_bucket(grams, gram_buckets))[0]] = _unpacked(by_bucket(back, "logs"))[0] / -LOG_UNITS
        scores = np.zeros(n_docs)
        for a, b, d, o in K.blocks(data, offsets, SCORE_BLOCK):
            keys, of = ppm.padded(d, o, DEPTH)
            scores[a:b] = np.bincount(of, weights=log[np.searchsorted(grams, keys)], minlength=b - a)
        columns = [ids, held, pa.array(tokens), pa.array(n_known), pa.array(np.full(n_docs, train_tokens)), pa.array(base), pa.array(scores)]
        return pa.table(columns, names=names)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    left = chunks.filter("kind = 0").select("chunk", "ids", "held", "texts").groupBy("chunk")
    right = counts.filter("chunk >= 0").unionByName(gram_back, allowMissingColumns=True)
    return left.cogroup(right.groupBy("chunk")).applyInArrow(finish, schema).withColumnRenamed("id", id_col)
