"""Periodic runs of words, found by a sparse diagonal recurrence.

A run is a stretch of words with smallest period q (words q apart are equal),
of at least ``max(min_words, min_repeats * q)`` words, that no neighbouring
word extends. Reading a text from left to right, a word that stands q words
after an equal one lengthens the match on diagonal q; a diagonal that ends with
enough words is a run, there and then.

Most earlier occurrences of a word lead nowhere, so they are told apart by
context. At level G (a power of two) a word is taken together with the G - 1
words after it. Inside a run of period q <= G the latest earlier occurrence of
such a window is exactly q words back: the window holds a whole period, and a
nearer occurrence would make the period divisible. So one level serves the
periods in (G / 2, G], and at each word it has one active diagonal, that of the
latest occurrence: while its lag stays the same the match grows, and when it
changes the diagonal has ended. Conversely a diagonal that keeps its lag q for
windows x to y spans the words x - q to y + G, cannot be extended, and has no
smaller period. The next level only looks at windows both halves of which
occur more than once, so plain text costs one sort of its words, and a text of
n words at most log(n) of them, however repetitive it is.

Words are told apart by a 64-bit hash, windows by a hash of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def runs_of(word: np.ndarray, doc: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> tuple[np.ndarray, ...]:
    """First word, length and period of all runs of several texts.

    ``word`` has the 64-bit identity of each word, ``doc`` the number of its
    text, ascending; a run lies in one text. Runs are sorted by first word,
    then period.
    """
    if min_words < 2 or min_repeats < 3:
        raise ValueError("a run needs two words and three repeats at least")
    n, width = len(word), 1
    g = K.mix(word + doc.astype(np.uint64) * _MULTIPLIER)
    while 4 * width <= min_words:
        g = K.mix(g[:-width] * _MULTIPLIER + g[width:]) if len(g) > width else g[:0]
        width *= 2
    at = np.flatnonzero(doc[: len(g)] == doc[width - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    g, least = g[at], 0
    starts, lengths, periods = [], [], []
    symbol, repeated = np.zeros(n, np.uint64), np.zeros(n, bool)
    while len(at):
        order = np.argsort(g, kind="stable")
        same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
        earlier, later = order[same], order[same + 1]
        lag = np.zeros(len(at), np.int64)
        lag[later] = at[later] - at[earlier]
        hit = np.flatnonzero((lag > least) & (lag <= width))
        if len(hit):
            x, q = at[hit], lag[hit]
            new = np.r_[True, (x[1:] != x[:-1] + 1) | (q[1:] != q[:-1])]
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(x)] - 1
            start, period = x[head] - q[head], q[head]
            length = x[tail] + width - start
            long = length >= np.maximum(min_words, min_repeats * period)
            starts.append(start[long])
            lengths.append(length[long])
            periods.append(period[long])
        twice = np.zeros(len(at), bool)
        twice[earlier] = twice[later] = True
        symbol[at], repeated[:] = g, False
        repeated[at[twice]] = True
        at = at[twice]
        at = at[at + width < n]
        at = at[repeated[at + width] & (doc[at + width] == doc[at])] if len(at) else at
        g = K.mix(symbol[at] * _MULTIPLIER + symbol[at + width]) if len(at) else g[:0]
        least, width = width, 2 * width
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, z
    start, length, period = (np.concatenate(x) for x in (starts, lengths, periods))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` words lies in a run beyond the run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> pa.Array:
    """The texts of the given words, one blank between two."""
    edge = np.zeros(len(data) + 1, np.int64)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else doc
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    held = np.cumsum(edge[:-1]) > 0
    # the byte after a word that has a follower is a blank of some kind
    held[end[inner]] = True
    data = data.copy()
    data[end[inner]] = 0x20
    size = np.bincount(doc, weights=end - start, minlength=n_docs).astype(np.int64) + np.bincount(doc[inner], minlength=n_docs)
    offsets = np.zeros(n_docs + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), n_docs, [None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).cast(pa.string())


def _spans(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])


def find_runs(docs: DataFrame, min_words: int = 24, min_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, runs, strongest, and the collapsed text.

    ``runs`` has (start, length, period) of every run, in words from 0, by
    start and period; ``strongest`` is the one with the greatest length per
    period, of equal ones the first, of these the shortest period, and null
    without a run. ``collapsed`` holds the words that no run repeats, joined by
    one blank. Words are parted by ASCII blanks.

    One pass, no shuffle. Null and empty texts have no words; a long text is
    one block; repeated rows and ids each give their own row; other columns
    are not read, whatever their names; an empty table gives an empty result.
    """
    spans = "struct<start: long, length: long, period: long>"
    schema = f"id {dict(docs.dtypes)[id_col]}, n_words long, runs array<{spans}>, strongest {spans}" + ", collapsed string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for a, b, raw, o in K.blocks(data, offsets):
                w_start, w_end, doc = K.words(raw, o)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                start, length, period = runs_of(K.span_hash(K.prefix_hash(raw), w_start, w_end), doc, min_words, min_repeats)
                of = doc[start]
                local = start - first[of]
                by = np.lexsort((period, local, -(length / period), of))
                best = by[np.r_[True, of[by][1:] != of[by][:-1]]] if len(by) else by
                strongest = np.full(b - a, -1)
                strongest[of[best]] = best
                listed = _spans(local, length, period)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(first), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32()), listed),
                    listed.take(pa.array(strongest, pa.int64(), mask=strongest < 0)),
                ]
                if keep_text:
                    kept = ~repeats(len(doc), start, length, period)
                    columns.append(_joined(raw, w_start[kept], w_end[kept], doc[kept], b - a))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "strongest", "collapsed"][: len(columns)])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
