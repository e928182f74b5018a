"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are a stated query set, taken in blocks of at most ``ITEM_BLOCK``
items and ``ITEM_BYTES`` of text; a block's tables are sent to all tasks. The
score of a passage is its best local alignment with the item over a full match,
so edited and paraphrased copies lose score in proportion to what was changed.

The seeds are single words (n is 1), those of the item that the corpus has
least often, and they lose no passage: a score of t needs k = t m of the item's m
words to match, so two of any m - k + 2 words do. A passage that reaches t has
at most 2 (1 - t) m edits, so two of its seeds lie within m + 2 (1 - t) m words
of a document. Seeds chained by gaps of that size make a stretch, with room for
the whole item around them, and a stretch is aligned if it has k of the item's
words in common. An item of fewer than ``SHORT`` words is found word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Items of fewer words are found word for word.
SHORT = 4
ITEM_BLOCK, ITEM_BYTES = 20_000, 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6
#: Words of stretches that are counted at a time; seeds that are looked at at a time, but for those of one long text.
COUNT_WORDS, SEED_HITS = 1 << 18, 1 << 20

#: Blanks and ASCII punctuation part words here, so edits of punctuation don't count.
PARTS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = K.words(data, offsets, PARTS)
    return K.word_hashes(data, start, end), doc


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the text word after its end."""
    cells = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1) * -GAP
    best = end = 0
    for w in item:
        new = np.maximum(cells[:-1] + np.where(text == w, MATCH, MISMATCH), cells[1:] + GAP)
        new = np.maximum(np.r_[0, new], 0)
        # gaps in the item: the best cell to the left, less its distance
        cells = np.maximum.accumulate(new + ramp) - ramp
        top = int(cells.argmax())
        if cells[top] > best:
            best, end = int(cells[top]), top
    return best, end


def needed(m: np.ndarray | int, threshold: float) -> np.ndarray:
    """How many of m words have to match for a score of ``threshold``."""
    return np.maximum(1, np.ceil(threshold * np.asarray(m) - 1e-9).astype(np.int64))


@dataclass(frozen=True)
class Seeds:
    """Seeds by word of the vocabulary: first entry of each and the end; item and offset of each entry."""

    lead: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    threshold: float


@dataclass(frozen=True)
class Items:
    """A block of test items and their words."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray  # sorted distinct words
    held: np.ndarray  # sorted item * len(vocabulary) + word
    times: np.ndarray  # how often the item holds the word
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted runs and their items
    seeds: Seeds | None = None

    @staticmethod
    def of(ids: list, texts: list[str]) -> Items:
        data, offsets = K.column_bytes(pa.array(texts, pa.string()))
        h, doc = word_ids(data, offsets)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        vocabulary, word = np.unique(h, return_inverse=True)
        held, times = np.unique(doc * len(vocabulary) + word, return_counts=True)
        words = [h[a:b] for a, b in zip(cut[:-1], cut[1:])]
        short = {}
        for n in range(1, SHORT):
            of = np.flatnonzero(np.diff(cut) == n)
            if len(of):
                # the run as it is found in a text: a further word keeps a text from being a short one itself
                run = np.array([K.shingles(np.append(words[i], np.uint64(0)), np.zeros(n + 1, np.int64), n)[0][0] for i in of.tolist()])
                by = np.argsort(run, kind="stable")
                short[n] = run[by], of[by]
        return Items(ids, words, vocabulary, held, times, short)

    def seeded(self, counts: np.ndarray, threshold: float) -> Items:
        """With the rarest words of each item as seeds; ``counts`` are the corpus counts of the vocabulary."""
        word, item, offset = [], [], []
        for i, w in enumerate(self.words):
            m = len(w)
            if m >= SHORT:
                k = needed(m, threshold)
                at = np.searchsorted(self.vocabulary, w)
                place = np.lexsort((np.arange(m), at, counts[at]))[: m - k + min(2, k)]
                word.append(at[place])
                item.append(np.full(len(place), i))
                offset.append(place)
        if not word:
            return self
        word, item, offset = (np.concatenate(x) for x in (word, item, offset))
        order = np.argsort(word, kind="stable")
        lead = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        return replace(self, seeds=Seeds(lead, item[order], offset[order], threshold))

    def shared(self, h: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many words each stretch h[left:right] has in common with its item, as bags."""
        out = np.zeros(len(item), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        at = at[known]
        left, right = np.searchsorted(known, left), np.searchsorted(known, right)
        total = np.r_[0, np.cumsum(right - left)]
        a = 0
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(total, total[a] + COUNT_WORDS, side="right")) - 1)
            n = right[a:b] - left[a:b]
            of = np.repeat(np.arange(a, b), n)
            word = at[np.repeat(left[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            key = item[of] * len(self.vocabulary) + word
            place = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
            own = self.held[place] == key
            pair, count = np.unique((of[own] - a) * len(self.held) + place[own], return_counts=True)
            np.add.at(out, a + pair // len(self.held), np.minimum(count, self.times[pair % len(self.held)]))
            a = b
        return out

    def known(self, h: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def stretches(self, word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Document, item, first word and end of every stretch with seeds enough."""
        seeds = self.seeds
        at = np.flatnonzero(word >= 0)
        at = at[seeds.lead[word[at] + 1] > seeds.lead[word[at]]]
        many = seeds.lead[word[at] + 1] - seeds.lead[word[at]]
        total, a = np.r_[0, np.cumsum(many)], 0
        while a < len(at):
            b = int(np.searchsorted(total, total[a] + SEED_HITS, side="right")) - 1
            if b < len(at):  # whole texts
                b = max(int(np.searchsorted(doc[at], doc[at[b]])), int(np.searchsorted(doc[at], doc[at[a]], side="right")))
            n = many[a:b]
            entry = np.repeat(seeds.lead[word[at[a:b]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place, item, offset = np.repeat(at[a:b], n), seeds.item[entry], seeds.offset[entry]
            a = b
            order = np.lexsort((offset, place, item, doc[place]))
            place, item, offset = place[order], item[order], offset[order]
            # a word that stands in the item more than once is one seed of the document
            same = (place[1:] == place[:-1]) & (item[1:] == item[:-1])
            first, last = np.flatnonzero(np.r_[True, ~same]), np.flatnonzero(np.r_[~same, True])
            least, most, place, item = offset[first], offset[last], place[first], item[first]
            of, m = doc[place], self.sizes[item]
            k, edits = needed(m, seeds.threshold), np.floor(2 * (1 - seeds.threshold) * m + 1e-9).astype(np.int64)
            chained = np.r_[False, (of[1:] == of[:-1]) & (item[1:] == item[:-1]) & (place[1:] - place[:-1] <= (m + edits)[1:])]
            begin = np.flatnonzero(~chained)
            size = np.diff(np.r_[begin, len(place)])
            begin_all, left, right = begin, np.minimum.reduceat(place - most - edits, begin), np.maximum.reduceat(place + m - least + edits, begin)
            enough = size >= np.minimum(2, k[begin_all])
            begin, left, right = begin[enough], left[enough], right[enough]
            low, high = np.searchsorted(doc, of[begin]), np.searchsorted(doc, of[begin], side="right")
            left, right = np.maximum(low, left), np.minimum(high, right)
            yield of[begin], item[begin], left, right, low

    def verbatim(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """``matches`` of the items that are shorter than a seed."""
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
        for n, (runs, items) in self.short.items():
            g, d, first = K.shingles(h, doc, n)
            low, high = np.searchsorted(runs, g), np.searchsorted(runs, g, side="right")
            seen = set()
            for i in np.flatnonzero(high > low).tolist():
                for item in items[low[i] : high[i]].tolist():
                    if (int(d[i]), item) not in seen:
                        seen.add((int(d[i]), item))
                        start = begin[np.searchsorted(begin, first[i], side="right") - 1]
                        yield int(d[i]), item, 1.0, int(first[i] - start) + n

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(document, item, score, word where the best alignment ends), one per pair."""
        h, doc = word_ids(data, offsets)
        exact = list(self.verbatim(h, doc)) if self.short else []
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for d, item, left, right, low in self.stretches(self.known(h), doc) if self.seeds is not None else ():
            m = self.sizes[item]
            go = self.shared(h, item, left, right) >= needed(m, self.seeds.threshold)
            for i, j, lo, a, b, size in zip(*(x[go].tolist() for x in (d, item, low, left, right, m))):
                score, end = align(self.words[j], h[a:b])
                found = (score / (MATCH * size), a + end - lo)
                if found[0] >= self.seeds.threshold and found[0] > best.get((i, j), (0.0, 0))[0]:
                    best[i, j] = found
        return exact + [(i, j, s, e) for (i, j), (s, e) in best.items()]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The test items by blocks, in order of their ids."""
    rows = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator()
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in rows:
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.encode())
        if len(ids) == ITEM_BLOCK or size >= ITEM_BYTES:
            yield Items.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts)


def _seeded_blocks(docs: DataFrame, items: DataFrame, text_col: str, threshold: float) -> Iterator[Items]:
    """The blocks of items, seeded by the words' counts in all documents."""
    spark = docs.sparkSession
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(sent.value.vocabulary), np.int64)
            for batch in batches:
                data, offsets = K.column_bytes(batch.column(0))
                for _, _, raw, o in K.blocks(data, offsets):
                    word = sent.value.known(word_ids(raw, o)[0])
                    counts += np.bincount(word[word >= 0], minlength=len(counts))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], ["word", "n"])

        counts = np.zeros(len(block.vocabulary), np.int64)
        counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word long, n long")
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():  # the block's vocabulary at most
            counts[r.word] = r.n
        yield block.seeded(counts, threshold)


def find_copies(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, item_id, score, end_word) of documents that hold a test item.

    ``score`` is the best local alignment over that of the whole item: 1.0 is
    a verbatim copy. ``items`` has item_id and text. Items of one to three
    words are found only word for word, items without words never; null texts count as empty; a
    repeated document or item is reported as often as it stands there; other
    columns are not read; with no documents or items the result is empty.
    """
    id_type, item_type = dict(docs.dtypes)[id_col], dict(items.dtypes)["item_id"]
    schema = f"id {id_type}, item_id {item_type}, score double, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _seeded_blocks(docs, items, text_col, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = K.column_bytes(batch.column(1))
                for a, _, raw, o in K.blocks(data, offsets):
                    found = sent.value.matches(raw, o)
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array([a + f[0] for f in found])),
                                pa.array([sent.value.ids[f[1]] for f in found]),
                                pa.array([f[2] for f in found]),
                                pa.array([f[3] for f in found], pa.int64()),
                            ],
                            ["id", "item_id", "score", "end_word"],
                        )

        picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        out = out.unionByName(picked.mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_words: int = SHORT) -> DataFrame:
    """The documents that hold no test item of ``min_words`` or more, all columns; no shuffle.

    A word or two are no evidence of a copy, so shorter items drop nothing.
    Null, empty and very long texts are judged as in ``find_copies``; repeated
    rows have the same fate; columns may have any names; without items nothing
    goes, and an empty table stays empty.
    """
    place = docs.columns.index(text_col)
    for block in _seeded_blocks(docs, items, text_col, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                data, offsets = K.column_bytes(batch.column(place))
                for a, _, raw, o in K.blocks(data, offsets):
                    for f in sent.value.matches(raw, o):
                        if len(sent.value.words[f[1]]) >= min_words:
                            keep[a + f[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
