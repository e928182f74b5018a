"""Byte-level BPE: batched encoding in numpy merge rounds, and decoding.

A batch's new words become one flat array of symbol ids with word numbers.
Each round looks all adjacent pairs up by binary search over the sorted pair
keys, takes the lowest rank of every word, merges its occurrences left to
right, and compacts the array; words without a mergeable pair leave it. A word
of more than ``LONG_WORD`` bytes would take as many rounds over its whole
length as it has ranks, so its pairs are merged from a heap, in the same order.
Merged words are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_CHARS = 1 << 20
CACHE_WORDS, CACHE_BYTES = 150_000, 32 << 20
LONG_WORD = 400
#: Settings of the vocabulary file that the code relies on.
_SETTINGS = {
    "normalizer": (None,),
    "pre_tokenizer.type": ("ByteLevel",),
    "pre_tokenizer.add_prefix_space": (False,),
    "pre_tokenizer.use_regex": (True, None),
    "decoder.type": ("ByteLevel",),
    "model.type": ("BPE", None),
    "model.dropout": (None, 0),
    "model.continuing_subword_prefix": (None, ""),
    "model.end_of_word_suffix": (None, ""),
    "model.byte_fallback": (False, None),
    "model.ignore_merges": (False, None),
}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """Tables of one tokenizer; its size is fixed by the vocabulary file."""

    token_bytes: list[bytes]
    byte_ids: np.ndarray  # id of each single byte
    pair_keys: np.ndarray  # sorted left << 32 | right
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    special: dict[str, int]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        for name, allowed in _SETTINGS.items():
            value = spec
            for part in name.split("."):
                value = (value or {}).get(part)
            if value not in allowed:
                raise ValueError(f"a vocabulary with {name} = {value!r} would not be encoded as its own library does")
        for t in spec["added_tokens"]:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized"):
                raise ValueError(f"special token {t['content']!r} has settings that are not supported")
        ids, letters = spec["model"]["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            byte_ids[b] = ids[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        merged = np.array([ids[a + b] for a, b in merges], np.int64)
        return Vocabulary(token_bytes, byte_ids, keys[order], order.astype(np.int64), merged[order], special)

    @cached_property
    def ranks(self) -> dict[int, tuple[int, int]]:
        """Rank and merged symbol by pair; made once for each worker, and only for long words."""
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_merged.tolist())))

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        if any(len(w) > LONG_WORD for w in words):
            short = iter(self.encode_words([w for w in words if len(w) <= LONG_WORD]))
            return [next(short) if len(w) <= LONG_WORD else self._encode_long(w, self.ranks) for w in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        none, top = np.int64(1 << 62), len(self.pair_keys) - 1
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), top)
            rank = np.full(len(symbols), none)
            known = (self.pair_keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.pair_ranks[at[known]]
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.r_[begin, len(symbols)])
            ended = best == none
            if ended.any():
                out = np.repeat(ended, size)
                done_symbols.append(symbols[out])
                done_words.append(word[out])
                stay = ~out
                # at holds for all but the last symbol; a word's last one is never read
                at = np.append(at, 0)[stay]
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                best, size = best[~ended], size[~ended]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[place % 2 == 0]  # of overlapping pairs the left one merges
            symbols[hit] = self.pair_merged[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, of = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        raw = flat[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(of, minlength=len(words)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_long(self, word: bytes, ranks: dict[int, tuple[int, int]]) -> bytes:
        """One word, by a heap of its pairs: lowest rank first, then leftmost."""
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[k], i, k) for i, k in enumerate(a << 32 | b for a, b in zip(symbols, symbols[1:])) if k in ranks]
        heapq.heapify(heap)
        while heap:
            _, merged, i, key = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != key:
                continue  # one of its symbols has merged since
            symbols[i], symbols[j], after[i] = merged, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (new := symbols[left] << 32 | symbols[right]) in ranks:
                    heapq.heappush(heap, (*ranks[new], left, new))
        return np.array([x for x in symbols if x >= 0], "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included; stray bytes become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Encoder:
    """A vocabulary with the cache of one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.findall = regex.compile(SPLIT).findall
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in vocabulary.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.findall(text)
        return list(chain.from_iterable([part] if part in self.special else self.findall(part) for part in self.cut.split(text)))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        pieces = [self._pieces(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS or self.cached > CACHE_BYTES:
            self.cache, self.cached = {}, 0
        self.cache.update(self.special)
        cache = self.cache
        new = [w for w in set(chain.from_iterable(pieces)) if w not in cache]
        cache.update(zip(new, self.vocabulary.encode_words([w.encode() for w in new])))
        self.cached += sum(map(len, new))
        get = cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def portions(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Token ids of every whole text, as the vocabulary at ``path`` gives them.

    Returns id, n_tokens, then ``ids`` array<int> if asked for, then with
    ``digests`` ids_sha256 (little-endian unsigned 32-bit ids) and
    decoded_sha256 (the ids decoded again, UTF-8). The string of a special
    token in a text becomes that token. A null or empty text has no tokens;
    repeated rows give repeated results; other columns are not read, whatever
    their names; an empty table gives an empty result. The file is read once,
    by the driver; executors get its tables, whose size the file fixes.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                coded = encoder.encode(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in coded], pa.int64())]
                names = ["id", "n_tokens"]
                if ids:
                    at = np.cumsum([0, *(len(x) // 4 for x in coded)])
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
                    names.append("ids")
                if digests:
                    decoded = (vocabulary.value.decode(np.frombuffer(x, "<u4")) for x in coded)
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded]))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]))
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids: id, text. Null ids give a null text."""
    spark = tokens.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else vocabulary.value.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    picked = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))
    return picked.mapInArrow(run, f"id {dict(tokens.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col)
