"""Ranked lexical search over bit-sliced Bloom signatures.

*Index*: every document has a Bloom signature of its terms. A term that occurs
tf times is inserted once for each level of ``LEVELS`` that tf reaches. Blocks
of documents whose signatures have one width are stored by bit: slice b is a
bitmap over the block's documents. Widths follow the number of insertions, so
long documents are no fuller than short ones, and every document is indexed.

*Search*: the slices of a term, and-ed, are the documents that may hold it at
a level or more; they miss none. From the levels comes, for each term and
document, the most that the term can add to the score, and their weighted sum
is an upper bound of the score. The best bounds of each query are scored
exactly first; the k-th of these scores is a floor. Every document whose bound
is not below the floor of some query is then scored from its text; the others
are provably not among the k best. Ties are kept until the last step.

Queries are a stated set, taken in blocks of ``ITEM_BLOCK`` and ``ITEM_BYTES``;
what is sent to tasks is bounded by these, and by ``KEYS`` documents to score
at a time. Terms are told apart by a 64-bit hash; documents to score are named
by a hash of their text, and one named by accident is merely scored as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import scratch

#: Blanks and ASCII punctuation part terms.
SEPARATOR = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Occurrences that are told apart.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024])
HASHES, BITS, LEAST_WIDTH = 5, 12, 256
#: Documents of a block, and cells of its bit matrix.
BLOCK_DOCS, BLOCK_CELLS = 1024, 1 << 23
ITEM_BLOCK, ITEM_BYTES = 20_000, 8 << 20
#: Terms whose bounds are held at a time; contributions that are summed at a time.
GROUP_TERMS, SUMS = 2048, 1 << 21
#: Documents of a query that are scored first; documents that are scored in one pass.
SEEDS, KEYS = 32, 4_000_000
_LEVEL, _HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCALE = 1_000_000_000


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Terms of each text; then text, hash and count of its distinct terms, by text."""
    start, end, doc = K.words(data, offsets, SEPARATOR)
    h = K.word_hashes(data, start, end)
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    return np.bincount(doc, minlength=len(offsets) - 1), d[new], h[new], np.diff(np.r_[new, len(h)])


def _level_keys(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return K.mix(h + np.asarray(level + 1).astype(np.uint64) * _LEVEL)


def _bit(key: np.ndarray, i: int, width: int) -> np.ndarray:
    return (K.mix(key + np.uint64((i + 1) * int(_HASH) & K.ALL)) & np.uint64(width - 1)).astype(np.int64)


def _keyed(docs: DataFrame, text_col: str) -> list:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("key"), text.alias("text")]


def build_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Written table of blocks: keys, numbers of terms and slices of the documents of one width.

    Null and empty texts have no terms, and a signature without bits; a long
    text has a wide signature; every repeated row is a document of its own.
    Other columns are not read. An empty table gives an empty index.
    """

    def block(width: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        shift = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        cells = np.zeros((width, len(keys)), np.uint8)
        for (_, _, doc, inserted), s in zip(parts, shift.tolist()):
            for i in range(HASHES):
                cells[_bit(inserted, i, width), doc + s] = 1
        values = [keys.tobytes(), n.tobytes(), np.packbits(cells, axis=1, bitorder="little").tobytes()]
        columns = [pa.array([width], pa.int32()), *(pa.array([v], pa.binary()) for v in values), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])]
        return pa.RecordBatch.from_arrays(columns, ["width", "keys", "lengths", "slices", "with_terms", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, ...]]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            every = batch.column(0).to_numpy()
            for a, b, raw, o in K.blocks(data, offsets):
                n, doc, h, tf = term_counts(raw, o)
                levels = np.searchsorted(LEVELS, tf, side="right")
                of = np.repeat(np.arange(len(h)), levels)
                inserted = _level_keys(h[of], np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels))
                doc = doc[of]
                size = np.maximum(LEAST_WIDTH, BITS * np.bincount(doc, minlength=b - a))
                widths = 2 ** np.ceil(np.log2(size)).astype(np.int64)
                for width in np.unique(widths).tolist():
                    most = min(BLOCK_DOCS, max(8, BLOCK_CELLS // width))
                    own = np.flatnonzero(widths == width)
                    while len(own):
                        part, own = own[: most - held.get(width, 0)], own[most - held.get(width, 0) :]
                        place = np.full(b - a, -1)
                        place[part] = np.arange(len(part))
                        of = place[doc] >= 0
                        open_.setdefault(width, []).append((every[a + part], n[part], place[doc[of]], inserted[of]))
                        held[width] = held.get(width, 0) + len(part)
                        if held[width] == most:
                            yield block(width, open_.pop(width))
                            held[width] = 0
        for width, parts in open_.items():
            yield block(width, parts)

    schema = "width int, keys binary, lengths binary, slices binary, with_terms long, terms long"
    return scratch.table(docs.select(*_keyed(docs, text_col)).mapInArrow(run, schema), "lexical-index")


@dataclass
class Queries:
    """A block of queries: their terms, and what the corpus says about these."""

    ids: list
    vocabulary: np.ndarray  # sorted distinct hashes
    terms: list[np.ndarray]  # of each query: places in the vocabulary, and how often
    times: list[np.ndarray]
    n_docs: int = 0
    n_terms: int = 0
    weight: np.ndarray | None = None
    floor: np.ndarray | None = None  # of each query: the k-th best score known

    @staticmethod
    def of(ids: list, texts: list[str]) -> Queries:
        _, doc, h, tf = term_counts(*K.column_bytes(pa.array(texts, pa.string())))
        vocabulary, at = np.unique(h, return_inverse=True)
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        return Queries(ids, vocabulary, [at[a:b] for a, b in zip(cut, cut[1:])], [tf[a:b] for a, b in zip(cut, cut[1:])])

    def weigh(self, n_docs: int, n_terms: int, found: dict[int, int]) -> None:
        """Weights from the number of documents of each term; queries keep the terms that weigh."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(self.vocabulary))], np.int64)
        known = np.array([found.get(i, 0) > 0 for i in range(len(self.vocabulary))], bool) & (self.weight > 0)
        keep = [known[t] for t in self.terms]
        self.times = [c[k] for c, k in zip(self.times, keep)]
        self.terms = [t[k] for t, k in zip(self.terms, keep)]
        self.floor = np.ones(len(self.ids), np.int64)

    def length_part(self, n: np.ndarray) -> np.ndarray:
        """m of documents with n terms."""
        if self.n_terms and int(n.max(initial=0)) * 75 * self.n_docs >= 1 << 62:
            return np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        return 25 + 75 * n * self.n_docs // max(1, self.n_terms)

    def groups(self) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """Terms, and queries over them: number, places among the terms, weights."""
        group: list[int] = []
        size = 0
        for i in [*range(len(self.ids)), -1]:
            if group and (i < 0 or size + len(self.terms[i]) > GROUP_TERMS):
                terms = np.unique(np.concatenate([self.terms[j] for j in group]))
                yield terms, [(j, np.searchsorted(terms, self.terms[j]), (self.weight[self.terms[j]] * self.times[j]).astype(np.float64)) for j in group]
                group, size = [], 0
            if i >= 0 and len(self.terms[i]):
                group.append(i)
                size += len(self.terms[i])

    def bounds(self, width: int, n: np.ndarray, slices: np.ndarray, groups: list) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's number and the upper bounds of its scores in a block of documents."""
        rows, m = slices.reshape(width, -1), self.length_part(n)
        caps = [np.minimum(cap, n) for cap in [*(LEVELS[1:] - 1).tolist(), np.iinfo(np.int64).max]]
        most = [SCALE * tf // (1000 * tf + 8 * m) for tf in caps]
        steps = [most[0], *(b - a for a, b in zip(most, most[1:]))]
        for terms, queries in groups:
            top = np.zeros((len(terms), len(n)))
            live, before = np.arange(len(terms)), None
            for level, step in enumerate(steps):
                key = _level_keys(self.vocabulary[terms[live]], level)
                bits = rows[_bit(key, 0, width)]
                for i in range(1, HASHES):
                    bits &= rows[_bit(key, i, width)]
                if before is not None:
                    bits &= before
                some = bits.any(axis=1)
                live, before = live[some], bits[some]
                if not len(live):
                    break
                top[live] += np.unpackbits(before, axis=1, count=len(n), bitorder="little") * step
            for j, places, weights in queries:
                yield j, weights @ top[places]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, query and score of all that reach the query's floor."""
        n, doc, h, tf = term_counts(data, offsets)
        if not len(self.vocabulary) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        own = self.vocabulary[at] == h
        doc, at, tf = doc[own], at[own], tf[own]
        part = SCALE * tf // (1000 * tf + 8 * self.length_part(n)[doc])
        query, term = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.terms]), np.concatenate(self.terms)
        order = np.argsort(term, kind="stable")
        query, value = query[order], (self.weight[term] * np.concatenate(self.times))[order]
        lead = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        many = lead[at + 1] - lead[at]
        total, a = np.r_[0, np.cumsum(many)], 0
        while a < len(doc):
            # whole texts whose sums and cells are few
            b = int(np.searchsorted(total, total[a] + SUMS, side="right")) - 1
            last = min(doc[min(b, len(doc) - 1)], doc[a] + max(1, SUMS // len(self.ids)))
            b = int(np.searchsorted(doc, max(last, doc[a] + 1)))
            of = np.repeat(np.arange(a, b), many[a:b])
            entry = lead[at[of]] + np.arange(len(of)) - np.repeat(total[a:b] - total[a], many[a:b])
            sums = np.zeros((doc[b - 1] - doc[a] + 1, len(self.ids)), np.int64)
            np.add.at(sums, (doc[of] - doc[a], query[entry]), part[of] * value[entry])
            i, j = np.nonzero(sums >= self.floor)
            yield i + doc[a], j, sums[i, j]
            a = b


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    rows = items.select(items[id_col].alias("i"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator()
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in rows:
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t.encode())
        if len(ids) == ITEM_BLOCK or size >= ITEM_BYTES:
            yield Queries.of(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries.of(ids, texts)


def _document_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> dict[int, int]:
    """How many documents hold each term of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(0))
            for _, _, raw, o in K.blocks(data, offsets):
                _, _, h, _ = term_counts(raw, o)
                at = np.minimum(np.searchsorted(sent.value, h), len(counts) - 1)
                counts += np.bincount(at[sent.value[at] == h], minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], ["term", "df"])

    if not len(vocabulary):
        return {}
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "term long, df long")
    return {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _index_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Width, keys, numbers of terms and slices of each block of the index."""
    for i in range(batch.num_rows):
        width, *raw = (batch.column(c)[i] for c in range(4))
        yield width.as_py(), *(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(raw, (np.int64, np.int64, np.uint8)))


def _first_keys(index: DataFrame, queries: Queries) -> DataFrame:
    """Keys of the documents with the best bounds of each query."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        groups, least, best = list(q.groups()), np.zeros(len(q.ids)), {}
        for batch in batches:
            for width, keys, n, slices in _index_rows(batch):
                for j, bound in q.bounds(width, n, slices, groups):
                    over = np.flatnonzero(bound > least[j])
                    if len(over):
                        had = best.get(j, (np.zeros(0), np.zeros(0, np.int64)))
                        value, key = np.r_[had[0], bound[over]], np.r_[had[1], keys[over]]
                        if len(value) > SEEDS:
                            top = np.argpartition(value, -SEEDS)[-SEEDS:]
                            value, key = value[top], key[top]
                            least[j] = value.min()
                        best[j] = value, key
        for j, (value, key) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(key), pa.int32()), pa.array(value), pa.array(key)], ["query", "bound", "key"])

    found = index.select("width", "keys", "lengths", "slices").mapInArrow(run, "query int, bound double, key long")
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "key")))
    return placed.filter(F.col("place") <= SEEDS).select("key").distinct()


def _open_keys(index: DataFrame, queries: Queries) -> DataFrame:
    """Keys of the documents whose bound is not below some query's floor."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        groups = list(q.groups())
        for batch in batches:
            for width, keys, n, slices in _index_rows(batch):
                open_ = np.zeros(len(n), bool)
                for j, bound in q.bounds(width, n, slices, groups):
                    # sums beyond 2**53 are rounded
                    open_ |= bound * (1 + 1e-12) >= q.floor[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[open_]))], ["key"])

    return index.select("width", "keys", "lengths", "slices").mapInArrow(run, "key long").distinct()


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, equal scores by id."""
    order = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_end"))
    query = table["query"].to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return table.filter(pa.array(place < k))


def _scored(docs: DataFrame, keys: np.ndarray, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    """query, id and score of each task's k best among the documents with these keys."""
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(keys), queries))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, q = sent.value
        held: list[pa.Table] = []
        for batch in batches:
            key = batch.column(1).to_numpy()
            batch = batch.filter(pa.array(named[np.minimum(np.searchsorted(named, key), len(named) - 1)] == key))
            if not batch.num_rows:
                continue
            # equal texts are scored once, and the k smallest ids of each are enough
            texts = batch.column(2).dictionary_encode()
            rows = pa.table({"query": texts.indices, "score": np.zeros(len(texts), np.int64), "id": batch.column(0)})
            rows = _best(rows, k)
            lead = np.searchsorted(rows["query"].to_numpy(), np.arange(len(texts.dictionary) + 1))
            data, offsets = K.column_bytes(texts.dictionary)
            for a, _, raw, o in K.blocks(data, offsets):
                for text, query, score in q.scores(raw, o):
                    size = lead[a + text + 1] - lead[a + text]
                    of = np.repeat(np.arange(len(text)), size)
                    row = lead[a + text[of]] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                    held.append(pa.table({"query": pa.array(query[of], pa.int32()), "id": rows["id"].take(pa.array(row)), "score": score[of]}))
            if len(held) > 64:
                held = [_best(pa.concat_tables(held), k)]
        if held:
            yield from _best(pa.concat_tables(held), k).combine_chunks().to_batches()

    picked = docs.select(docs[id_col].alias("id"), *_keyed(docs, text_col))
    return picked.mapInArrow(run, f"query int, id {id_type}, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _all_keys(keys: DataFrame) -> Iterator[np.ndarray]:
    """Keys in parts of about KEYS."""
    written = scratch.table(keys, "lexical-keys")
    parts = -(-written.count() // KEYS)
    for i in range(parts):
        yield written.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).toArrow()["key"].to_numpy()
    scratch.remove(written)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """item id, rank, id and score of the k best documents of each item with a score above 0.

    A term's weight w falls with the documents that hold it; a document's m
    grows with its length; the score sums ``w * (10**9 tf div (1000 tf + 8 m))``
    over the item's terms, repeats included. Equal scores rank by ascending
    id, null ids last. Every row of ``docs`` is a document, repeated rows too,
    and every row of ``items`` a query; null and empty texts have no terms. Of
    an item that k documents or more hold a weighing term of, all ranks are
    filled; else there are fewer rows. Other columns are not read. Without
    documents or items the result is empty. ``index`` is one that
    ``build_index`` made of the same documents.
    """
    spark = docs.sparkSession
    own = build_index(docs, text_col) if index is None else index
    totals = own.agg(F.coalesce(F.sum("with_terms"), F.lit(0)).alias("d"), F.coalesce(F.sum("terms"), F.lit(0)).alias("t")).first()
    types = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id]
    out = spark.createDataFrame([], f"item {types[1]}, rank int, id {types[0]}, score long")
    for queries in query_blocks(items, item_id, item_text):
        queries.weigh(totals.d, totals.t, _document_counts(docs, queries.vocabulary, text_col))
        first = np.concatenate([np.zeros(0, np.int64), *_all_keys(_first_keys(own, queries))])
        if not len(first):
            continue
        scored = _ranked(_scored(docs, first, queries, k, id_col, text_col), k)
        for r in scored.filter(F.col("rank") == k).select("query", "score").collect():
            queries.floor[r["query"]] = r.score
        parts = [scratch.table(_scored(docs, keys, queries, k, id_col, text_col), "lexical-scored") for keys in _all_keys(_open_keys(own, queries))]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"n int, item {types[1]}")
        ranked = _ranked(found, k).join(F.broadcast(names), F.col("query") == F.col("n"))
        out = out.unionByName(ranked.select("item", "rank", "id", "score"))
    if index is None:
        scratch.remove(own)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")
