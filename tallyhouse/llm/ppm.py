"""Prediction by partial matching over bytes, as flat tables of a context trie.

A trie of depth K holds, for each context of 0 to K bytes, the symbols that
followed it and how often. Texts start after K end marks and close with one,
so every position has a full context. Escapes are by method C (as many escape
counts as distinct symbols); symbols that a longer context has seen are
excluded in a shorter one. All of that depends on contexts alone, so each
context's escape and each masked total is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

END = 0xFF  # never a byte of UTF-8
SYMBOLS = 256


def padded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context and symbol, depth + 1 bytes) of all symbols of a block, and their documents."""
    n_docs, sizes = len(offsets) - 1, np.diff(offsets)
    text = np.full(len(data) + n_docs * (depth + 1), END, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n_docs) * (depth + 1) + depth, sizes)] = data
    key = np.zeros(max(0, len(text) - depth), np.uint64)
    for j in range(depth + 1):
        key <<= np.uint64(8)
        key |= text[j : j + len(key)]
    # the key that starts at i ends at symbol i + depth; a document's first ``depth`` cells are marks
    doc = np.repeat(np.arange(n_docs), sizes + depth + 1)
    place = np.arange(len(text)) - np.repeat(offsets[:-1] + np.arange(n_docs) * (depth + 1), sizes + depth + 1)
    is_symbol = place[depth:] >= depth
    return key[is_symbol], doc[depth:][is_symbol]


@dataclass(frozen=True)
class Level:
    """One context length: grams (context, symbol) and contexts, all sorted."""

    grams: np.ndarray
    log_count: np.ndarray
    contexts: np.ndarray
    log_total: np.ndarray  # log10(n + d)
    log_escape: np.ndarray  # log10(d / (n + d))
    # after an escape from this context, in the next shorter one:
    log_masked: np.ndarray  # log10 of its total without the symbols seen here
    log_masked_escape: np.ndarray
    open: np.ndarray  # whether any symbol is left there


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Trie:
    """Built from the counts of keys of depth + 1 bytes; scores arrays of such keys.

    With ``base``, the sorted keys and counts of all contexts of one byte, the
    given keys may be those of some two-byte contexts only: what is longer
    lies within them, and what is shorter comes from the base.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, base: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.uint64), counts[order].astype(np.int64)
        self.depth = depth
        raw = []
        for j in range(depth, -1, -1):
            head = np.flatnonzero(np.r_[True, (keys[1:] >> np.uint64(8)) != (keys[:-1] >> np.uint64(8))]) if len(keys) else np.zeros(0, np.int64)
            contexts = keys[head] >> np.uint64(8)
            n = np.add.reduceat(counts, head) if len(head) else counts
            d = np.diff(np.r_[head, len(keys)])
            raw.append((keys, counts, contexts, n, d, head))
            if j:
                short = keys & ((np.uint64(1) << np.uint64(8 * j)) - np.uint64(1))
                order = np.argsort(short, kind="stable")
                short, c = short[order], counts[order]
                new = np.flatnonzero(np.r_[True, short[1:] != short[:-1]]) if len(short) else np.zeros(0, np.int64)
                keys, counts = short[new], (np.add.reduceat(c, new) if len(new) else c)
                if j == 2 and base is not None:
                    keys, counts = base
        self.levels: list[Level] = []
        for i, (keys, counts, contexts, n, d, head) in enumerate(raw):
            j = depth - i
            if j and len(keys):
                s_keys, s_counts, s_contexts, s_n, s_d, _ = raw[i + 1]
                at, _ = _find(s_keys, keys & ((np.uint64(1) << np.uint64(8 * j)) - np.uint64(1)))
                up, _ = _find(s_contexts, contexts & ((np.uint64(1) << np.uint64(8 * (j - 1))) - np.uint64(1)))
                left_n = s_n[up] - np.add.reduceat(s_counts[at], head)
                left_d = s_d[up] - d
            else:
                left_n = left_d = np.zeros(len(contexts), np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                masked = np.log10(left_n + left_d)
                self.levels.append(
                    Level(keys, np.log10(counts), contexts, np.log10(n + d), np.log10(d) - np.log10(n + d), masked, np.log10(left_d) - masked, left_n > 0)
                )
        seen = len(raw[-1][0])
        self.log_new = -np.log10(max(1, SYMBOLS - seen))
        self._slots: tuple[np.ndarray, np.ndarray, np.uint64] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}

    def _fast(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """A direct table of the deepest grams; the more frequent of two that collide stays."""
        if self._slots is None:
            top = self.levels[0]
            bits = max(10, int(2 * len(top.grams)).bit_length())
            shift = np.uint64(64 - bits)
            keys, logs = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, np.float64)
            order = np.argsort(top.log_count, kind="stable")
            slot = (top.grams[order] * np.uint64(0x9E3779B97F4A7C15)) >> shift
            context, _ = _find(top.contexts, top.grams[order] >> np.uint64(8))
            keys[slot] = top.grams[order]
            logs[slot] = top.log_count[order] - top.log_total[context]
            self._slots = keys, logs, shift
        return self._slots

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        slot_keys, slot_logs, shift = self._fast()
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        out = np.where(slot_keys[slot] == keys, slot_logs[slot], 0.0)
        todo = np.flatnonzero(slot_keys[slot] != keys)
        came = np.full(len(todo), -1)  # the context just escaped from, one level up
        for i, level in enumerate(self.levels):
            if not len(todo):
                return out
            j = self.depth - i
            key = keys[todo] & ((np.uint64(1) << np.uint64(8 * (j + 1))) - np.uint64(1))
            gram, found = _find(level.grams, key)
            context, known = _find(level.contexts, key >> np.uint64(8))
            masked = came >= 0
            above = self.levels[i - 1] if i else level
            if len(level.grams):
                total = np.where(masked, above.log_masked[np.maximum(came, 0)] if len(above.contexts) else 0.0, level.log_total[context])
                out[todo[found]] += (level.log_count[gram] - total)[found]
                free = np.where(masked, np.where(above.open[np.maximum(came, 0)], above.log_masked_escape[np.maximum(came, 0)], 0.0) if len(above.contexts) else 0.0, np.where(known, level.log_escape[context], 0.0))
                out[todo[~found]] += free[~found]
            todo, came = todo[~found], np.where(known, context, -1)[~found]
        out[todo] += self.log_new
        return out
