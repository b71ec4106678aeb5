"""Words of texts inside tasks: what a distinct word is worth is worked out once, then looked up."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Returns to the system what tasks before this one have freed; without it a worker stays as large as its largest task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_memory(kind: str) -> dict:
    """What a Python worker keeps from one task to the next of the same kind: only what can be worked out again, never results.

    A task of another kind empties it, so that the stages of a pipeline don't add up in one worker.
    """
    kept = sys.modules.setdefault("tidemark_worker_memory", types.ModuleType("tidemark_worker_memory")).__dict__
    if kept.get("kind") != kind:
        kept.clear()
        kept["kind"] = kind
    give_back()
    return kept


class _Places(dict):
    """word -> place; a word met for the first time gets the next place and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return place


class WordTable:
    """One row of numbers per distinct word, kept while a task runs.

    `make(words)` gives the rows of new words. The table empties itself beyond `limit` words or
    `max_chars` characters, so its memory is bounded; that changes what is worked out again, never a result.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 200_000, max_chars: int = 20_000_000):
        worker_memory("words")
        self._make, self._limit, self._max_chars = make, limit, max_chars
        self._places, self.rows = _Places(), None

    def places(self, words: list[str]) -> np.ndarray:
        """The row number in `rows` of each word. Rows stay valid until the next call."""
        if len(self._places) > self._limit or self._places.chars > self._max_chars:
            self._places, self.rows = _Places(), None
        known = len(self._places)
        out = np.fromiter(map(self._places.__getitem__, words), np.int64, len(words))
        if fresh := self._places.fresh:
            made = self._make(fresh)
            if self.rows is None or len(self.rows) < len(self._places):
                grown = np.empty((max(1024, 2 * len(self._places)), *made.shape[1:]), made.dtype)
                if known:
                    grown[:known] = self.rows[:known]
                self.rows = grown
            self.rows[known : len(self._places)] = made
            self._places.fresh = []
        return out


def bare(word: str) -> str:
    """The word in lower case, without what is not a letter or digit at its ends."""
    word = word.lower()
    if word.isalnum():
        return word
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]


def grams(words: list[str], sizes: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of `words`, with a mark at both ends of a word.

    Each word has one entry at least; entries come in order of size, then of words.
    """
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, found = [], []
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(codes), np.uint64)
    for size in range(1, sizes.stop):
        at = len(codes) - size + 1
        if at <= 0:
            break
        rolled = (rolled[:at] * np.uint64(0x100000001B3)) ^ mixed[size - 1 :]
        if size < sizes.start:
            continue
        inside = owner[:at] == owner[size - 1 :]
        hashed = rolled[:at][inside]
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[:at][inside])
        found.append((hashed >> np.uint64(32)).astype(np.int64) % buckets)
    return np.concatenate(owners or [owner[:0]]), np.concatenate(found or [owner[:0]])


def sum_by(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sum of the rows of `values` that belong to each of `count` owners."""
    out = np.empty((count, values.shape[1]))
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(owner, values[:, k], count)
    return out
