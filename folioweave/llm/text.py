"""Vectorised word kernels over Arrow string columns (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        m = max(n, 1 << 16)
        for k, base in (("p", _P), ("q", _INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole texts, about ``limit`` bytes at a time; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of the texts of one chunk.

    start, end: byte positions; first: index of each text's first word, and the number of words at the end.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        word = ~space[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        at = np.empty(n, bool)
        if n:
            at[0] = word[0]
            at[1:] = word[1:] & (~word[:-1] | edge[1:n])
        self.start = np.flatnonzero(at)
        if n:
            at[-1] = word[-1]
            at[:-1] = word[:-1] & (~word[1:] | edge[1:n])
        self.end = np.flatnonzero(at) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.buf)
        p, q = powers(n + 1)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=h[1:])
        return mix((h[self.end] - h[self.start]) * q[self.start])

    def text_of_words(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k successive words (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return acc


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text has its whole sequence as one, an empty one none."""
    all_runs = runs_of(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(all_runs[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield runs_of(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


class HashStore:
    """Numbers distinct 64-bit keys in the order they come: a worker's memory of words it has handled.

    A large sorted run and a small recent one (merged as it grows), so that adding a few keys doesn't copy all.
    """

    def __init__(self):
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a new one."""
        out = np.full(len(keys), -1, np.int64)
        for known, number in self.runs:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for new distinct sorted keys."""
        number = np.arange(self.size, self.size + len(keys))
        self.size += len(keys)
        known, old = self.runs[1]
        at = np.searchsorted(known, keys)
        self.runs[1] = (np.insert(known, at, keys), np.insert(old, at, number))
        if len(self.runs[1][0]) > 20_000 + len(self.runs[0][0]) // 8:
            (a, x), (b, y) = self.runs
            at = np.searchsorted(a, b)
            self.runs = [(np.insert(a, at, b), np.insert(x, at, y)), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        return number


class Growing:
    """A numpy array that grows at its end by doubling."""

    def __init__(self, dtype, *shape: int):
        self.array, self.size = np.empty((1024, *shape), dtype), 0

    def extend(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.array):
            bigger = np.empty((max(need, 2 * len(self.array)), *self.array.shape[1:]), self.array.dtype)
            bigger[: self.size] = self.array[: self.size]
            self.array = bigger
        self.array[self.size : need] = rows
        self.size = need
