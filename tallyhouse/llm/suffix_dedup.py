"""Removal of long repeated substrings by sharded suffix arrays.

Every window of ``length`` bytes names one short gram inside it, its *anchor*
(the smallest hash, leftmost on ties). Equal windows name equal anchors, so
windows whose anchor occurs once in the corpus are unique and need no more
work. The windows that share an anchor in a text form a *context*: their
common stretch of bytes. Contexts are dealt to shards by anchor, so equal
windows meet in one shard; there a suffix array (prefix doubling of unsorted
groups only, after Larsson and Sadakane) and common prefixes (Kasai, many
lanes at once) find them.

A very common anchor is spread over several shards by its contexts' bytes.
Those shards are merged: each keeps a sorted list of digests of its windows
that are still unique, the lists are dealt by digest, and binary search finds
the digests that several shards hold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch

GRAM = 40
#: Bytes of texts that are scanned at a time; small, so that temporaries stay in cache.
SCAN_BYTES = 1 << 18
#: Bytes of contexts that make a shard, and contexts of one anchor in a shard.
SHARD_BYTES = 1 << 20
SHARD_CONTEXTS = 1500
#: Bits of a packed run: its first window, its width, and the base-2 logarithm of its anchor's shards.
_WIDTH_BITS, _SPLIT_BITS = 24, 5
_BREAK = 0xFF  # never a byte of UTF-8


def context_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document, anchor hash, first window and last window of each context of a block.

    Windows are numbered by their first byte in the block. The contexts of a
    document part its windows.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    s = K.prefix_hash(data)
    _, q = K.powers(len(s))
    h = K.mix((s[gram:] - s[:-gram]) * q[: len(s) - gram])
    # a fixed width, so that equal windows choose alike in every block
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    at = (m[:n] & low).astype(np.int64)
    start = np.arange(n)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = start + length <= offsets[doc + 1]
    start, at, doc = start[whole], at[whole], doc[whole]
    if not len(start):
        return none, none.astype(np.uint64), none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:] - 1, len(start) - 1]
    return doc[new], h[at[new]], start[new], start[last]


def _packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one big-endian number."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = wide[:n].copy()
    for j in range(1, 8):
        key <<= np.uint64(8)
        key |= wide[j : n + j]
    return key


def suffix_array(text: np.ndarray, packed: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes.

    The first round sorts by 8 bytes; each later one doubles the depth and
    sorts only inside groups that are still tied. It goes on until none is:
    Kasai's rule needs the full order.
    """
    n = len(text)
    key = _packed(text) if packed is None else packed
    sa = np.argsort(key).astype(np.int32)
    head = np.r_[True, key[sa][1:] != key[sa][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    begin = np.flatnonzero(head)
    rank[sa] = np.repeat(begin, np.diff(np.r_[begin, n]))
    size = np.diff(np.r_[begin, n])
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(slots):
        own = sa[slots]
        key = (rank[own] * np.int64(n + 2) + rank[np.minimum(own + h, n)] + 1).astype(np.uint64)
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[slots] = own
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begin, len(slots)])
        rank[own] = np.repeat(slots[begin], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, packed: np.ndarray | None = None, lane: int = 64) -> np.ndarray:
    """For each rank, the bytes shared with the rank before, at most ``limit``.

    Kasai's rule, a position shares at least one byte less than the position
    before it, walks ``lane`` positions in many lanes at once, eight bytes a
    step.
    """
    n = len(text)
    key = np.concatenate([_packed(text) if packed is None else packed, np.zeros(limit + 16, np.uint64)])
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    first = np.arange(0, n, lane)
    shared = np.zeros(len(first), np.int64)
    for step in range(lane):
        i = first + step
        if i[-1] >= n:
            i = i[i < n]
            shared = shared[: len(i)]
        j = before[i]
        room = np.minimum(n - np.maximum(i, j), limit)
        shared = np.where(j < 0, 0, np.minimum(np.maximum(shared - 1, 0), room))
        live = np.flatnonzero((j >= 0) & (shared < room))
        while len(live):
            k = shared[live]
            x = key[i[live] + k] ^ key[j[live] + k]
            # leading equal bytes: the place of the highest set byte
            equal = np.full(len(live), 8, np.int64)
            for b in range(8):
                equal[(x >> np.uint64(8 * b)) != 0] = 7 - b
            k = np.minimum(k + equal, room[live])
            shared[live] = k
            live = live[(equal == 8) & (k < room[live])]
        out[i] = shared
    return out[sa]


def repeated_windows(contexts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard by suffix array: context, offset, repeated here, first of its class.

    ``contexts`` are distinct; ``weights`` says how often each occurs.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    text = np.frombuffer(b"".join(x + bytes([_BREAK]) for x in contexts), np.uint8)
    begin = np.cumsum(np.r_[0, sizes + 1])[:-1]
    packed = _packed(text)
    sa = suffix_array(text, packed)
    shared = common_prefixes(text, sa, length, packed)
    of = np.repeat(np.arange(len(contexts)), sizes + 1)
    at = np.arange(len(text)) - begin[of]
    ok = (at + length <= sizes[of])[sa]
    group = np.cumsum(shared < length)[ok]
    own = of[sa][ok]
    if not len(own):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool), z.astype(bool)
    head = np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(head)
    size = np.diff(np.r_[first, len(group)])
    total = np.repeat(np.add.reduceat(weights[own], first), size)
    return own, at[sa][ok], total > 1, head


def _union(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows at the sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every byte inside a ``length``-byte string that also starts elsewhere.

    Texts are UTF-8 bytes, null is empty; matches stay inside a document, the
    same document counts as elsewhere, and all strings are judged on the
    input. Returns id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``keep_text``, kept (bytes: a cut may split a
    character). Rows with equal texts, repeated rows included, are repeats of
    each other. Other columns are not read. An empty table gives an empty
    result.
    """
    if not 1 <= length < 1 << _WIDTH_BITS:
        raise ValueError(f"length must be from 1 to {(1 << _WIDTH_BITS) - 1}")
    gram = min(GRAM, length)
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), scratch.text_key(text_col).alias("key"))
    id_type = dict(docs.dtypes)[id_col]

    # 1. contexts of all texts
    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            refs = batch.column(1).to_numpy(zero_copy_only=False)
            for a, _, d, o in K.blocks(data, offsets, SCAN_BYTES):
                doc, anchor, first, last = context_runs(d, o, length, gram)
                place = (((first - o[doc]) << _WIDTH_BITS) | (last - first)) << _SPLIT_BITS
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(refs[a + doc]), pa.array(place)], ["anchor", "ref", "place"])

    # a 64-bit reference is enough here: a false one only adds a context to look at
    runs = source.select("text", F.xxhash64("key").alias("ref")).mapInArrow(find_runs, "anchor long, ref long, place long")
    all_runs = scratch.table(runs, "suffix-runs")

    # 2. those whose anchor occurs twice or more, gathered by text
    counted = all_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # an anchor's shards, as a power of two
    splits = F.least(F.ceil(F.log2(F.ceil(F.col("n") / SHARD_CONTEXTS))), F.lit((1 << _SPLIT_BITS) - 1)).cast("long")
    # written, so that the join below has a shuffle of its own on each side and a hot anchor's rows can be split
    repeated = scratch.table(counted.select(F.col("anchor").alias("r_anchor"), F.greatest(splits, F.lit(0)).alias("splits")), "suffix-anchors")
    runs = all_runs.join(repeated, F.col("anchor") == F.col("r_anchor"), "inner")
    runs = runs.groupBy("ref").agg(F.collect_set(F.struct((F.col("place") + F.col("splits")).alias("run"), "anchor")).alias("runs")).withColumnRenamed("ref", "r_ref")

    # 3. texts with such a context, once each; other rows are done
    def fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text of the task once, and at the end how often it came again, so that copies don't meet in one task."""
        again: dict[bytes, int] = {}
        for batch in batches:
            new = []
            for i, key in enumerate(batch.column(1).to_pylist()):
                if key in again:
                    again[key] += 1
                else:
                    again[key] = 0
                    new.append(i)
            if new:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(new)).columns, pa.array(np.ones(len(new), np.int64))], ["text", "key", "n"])
        more = {k: n for k, n in again.items() if n}
        if more:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.string()), pa.array(list(more), pa.binary()), pa.array(list(more.values()), pa.int64())], ["text", "key", "n"])

    once = source.select("text", "key").mapInArrow(fold_copies, "text string, key binary, n long").withColumn("ref", F.xxhash64("key"))
    joined = once.join(runs, F.col("ref") == F.col("r_ref"))
    texts = joined.groupBy("key").agg(F.first("text", ignorenulls=True).alias("text"), F.first("runs").alias("runs"), F.sum("n").alias("copies"))
    texts = scratch.table(texts, "suffix-texts")
    scratch.remove(all_runs)
    n_runs = texts.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("n")).first().n
    shards = max(1, math.ceil(n_runs * (length + (length - gram) // 2) / SHARD_BYTES))

    # 4. contexts to shards, suffix arrays there
    def pieces_of(text: pa.Scalar, packed: pa.Scalar) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, digest, first window, anchor and split of each context of a text."""
        raw = text.as_py().encode()
        run, anchor = (packed.values.field(i).to_numpy() for i in (0, 1))
        first, wide, split = run >> (_WIDTH_BITS + _SPLIT_BITS), (run >> _SPLIT_BITS) & ((1 << _WIDTH_BITS) - 1), run & ((1 << _SPLIT_BITS) - 1)
        fits = first + wide + length <= len(raw)
        first, wide, split, anchor = (x[fits] for x in (first, wide, split, anchor))
        pieces = [raw[a:b] for a, b in zip(first.tolist(), (first + wide + length).tolist())]
        return pieces, [hashlib.blake2b(p, digest_size=16).digest() for p in pieces], first, anchor.view(np.uint64), split

    def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, packed, copies in zip(*(batch.column(i) for i in range(4))):
                pieces, digest, first, anchor, split = pieces_of(text, packed)
                if not pieces:
                    continue
                # parts of a spread anchor get shards of their own
                part = np.frombuffer(b"".join(digest), np.uint32)[::4].astype(np.int64)
                home = np.where(split > 0, (anchor >> np.uint64(2)).astype(np.int64) * 2 + 1, (anchor % np.uint64(shards)).astype(np.int64) * 2)
                count = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home),
                        pa.array(part & ((1 << split) - 1)),
                        pa.array(digest, pa.binary()),
                        pa.array(pieces, pa.binary()),
                        pa.array([key.as_py()] * count, pa.binary()),
                        pa.array(first),
                        pa.array(np.full(count, copies.as_py())),
                    ],
                    ["home", "sub", "own", "context", "key", "first", "copies"],
                )

    def place_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, packed in zip(*(batch.column(i) for i in range(3))):
                pieces, digest, first, _, _ = pieces_of(text, packed)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([key.as_py()] * len(pieces), pa.binary()), pa.array(first)], ["own", "key", "first"])

    cut = texts.select("key", "text", "runs", "copies").mapInArrow(cut_contexts, "home long, sub long, own binary, context binary, key binary, first long, copies long")
    # equal contexts are one row with its weight, so a shard holds distinct ones only; key and first name its only place, if it has one
    folded = cut.groupBy("home", "sub", "own").agg(
        F.first("context").alias("context"), F.first("key").alias("key"), F.first("first").alias("first"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("places")
    )
    result_schema = "key binary, begin long, stop long, digest binary, own binary"

    def one_shard(group: pa.Table) -> pa.Table:
        spread = group.column("home")[0].as_py() % 2 == 1
        distinct, key, names = (group.column(x).to_pylist() for x in ("context", "key", "own"))
        first, places = group.column("first").to_numpy(), group.column("places").to_numpy()
        own, at, again, head = repeated_windows(distinct, group.column("copies").to_numpy(), length)
        keys, begins, stops, digests, owners = [], [], [], [], []
        order = np.lexsort((at[again], own[again]))
        r_own, r_at = own[again][order], at[again][order]
        cut_at = np.searchsorted(r_own, np.arange(len(distinct) + 1))
        for c in np.unique(r_own).tolist():
            lone = places[c] == 1  # else the spans are told to all places below
            shift = int(first[c]) if lone else 0
            for a, b in _union(r_at[cut_at[c] : cut_at[c + 1]], length):
                keys.append(key[c] if lone else None)
                begins.append(shift + a)
                stops.append(shift + b)
                digests.append(None)
                owners.append(None if lone else names[c])
        if spread:  # windows unique here, and one of each repeated class, for the merge
            for c, a, r in zip(own[head].tolist(), at[head].tolist(), again[head].tolist()):
                digest = hashlib.blake2b(distinct[c][a : a + length], digest_size=16).digest()
                keys.append(None if r else key[c])
                begins.append(None if r else int(first[c]) + a)
                stops.append(None if r else int(first[c]) + a + length)
                digests.append(digest)
                owners.append(None)
        return pa.table(
            {
                "key": pa.array(keys, pa.binary()),
                "begin": pa.array(begins, pa.int64()),
                "stop": pa.array(stops, pa.int64()),
                "digest": pa.array(digests, pa.binary()),
                "own": pa.array(owners, pa.binary()),
            }
        )

    found = scratch.table(folded.groupBy("home", "sub").applyInArrow(one_shard, result_schema), "suffix-found")

    # 5. merge of the shards of spread anchors: at most one row per shard and digest
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose digest another shard holds too; batches come sorted by digest."""
        last, waiting = None, None  # the digest before, and its row while no other has it
        for batch in batches:
            if not batch.num_rows:
                continue
            word = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").reshape(-1, 2)
            low, high = np.searchsorted(word[:, 0], word[:, 0], "left"), np.searchsorted(word[:, 0], word[:, 0], "right")
            shared = np.zeros(len(word), bool)
            for i in np.flatnonzero(high - low > 1).tolist():
                own = word[low[i] : high[i], 1]
                shared[i] = np.searchsorted(own, word[i, 1], "right") - np.searchsorted(own, word[i, 1], "left") > 1
            if last is not None and batch.column(0)[0].as_py() == last:
                shared |= (word == word[0]).all(axis=1)
                if waiting is not None and waiting.column(0)[0].is_valid:
                    yield waiting
            rows = batch.select(["key", "begin", "stop"])
            yield rows.filter(pc.and_(pa.array(shared), rows.column(0).is_valid()))
            last, waiting = batch.column(0)[-1].as_py(), None if shared[-1] else rows.slice(len(rows) - 1)

    digests = found.filter("digest is not null").select("digest", "key", "begin", "stop").repartition("digest").sortWithinPartitions("digest")
    merged = digests.mapInArrow(merge, "key binary, begin long, stop long")
    spans = found.filter("key is not null and digest is null").select("key", "begin", "stop").unionByName(merged)
    # both sides have a shuffle of their own, so the rows of a common context can be split
    told = found.filter("own is not null").select(F.col("own").alias("f_own"), "begin", "stop")
    again = texts.select("key", "text", "runs").mapInArrow(place_contexts, "own binary, key binary, first long")
    placed = again.join(told, F.col("own") == F.col("f_own"), "inner")
    spans = spans.unionByName(placed.select("key", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("stop")).alias("stop")))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "stop")).alias("spans")).withColumnRenamed("key", "s_key")

    # 6. cut the texts, once per distinct text
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                kept, removed, runs, end = [], 0, 0, 0
                for x in sorted((x["begin"], x["stop"]) for x in spans.as_py() or []):
                    if x[0] > end or not runs:
                        kept.append(raw[end : x[0]])
                        runs += 1
                        removed += x[1] - x[0]
                        end = x[1]
                    elif x[1] > end:
                        removed += x[1] - end
                        end = x[1]
                kept.append(raw[end:])
                made.append((removed, runs, b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.int64()),
                    pa.array([hashlib.sha256(m[2]).hexdigest() for m in made], pa.string()),
                    pa.array([m[2] if keep_text else None for m in made], pa.binary()),
                ],
                ["t_key", "n_removed", "n_spans", "cut_sha", "cut"],
            )

    cut_rows = texts.select("key", "text").join(spans, F.col("key") == F.col("s_key"), "left").select("key", "text", "spans")
    done = cut_rows.mapInArrow(cut_texts, "t_key binary, n_removed long, n_spans long, cut_sha string, cut binary")
    rows = source.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *(["text"] if keep_text else []))
    out = rows.join(done, F.col("key") == F.col("t_key"), "left").select(
        F.col("id").cast(id_type).alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
        *([F.coalesce("cut", F.col("text").cast("binary")).alias("kept")] if keep_text else []),
    )
    return out
