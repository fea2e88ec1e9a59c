"""Language-model scoring by a hierarchical Pitman-Yor model of two levels.

Tokens are lower-cased words and one end for each text. Every word that is ever followed in a training text, and the start of a
text, is a context with a restaurant of its own, whose customers are the tokens that follow it. All these restaurants share the
root as their parent: each table of a context restaurant is a customer of the root. The root's parent is uniform over the
known words and one unknown word.

Counts of word pairs lie in blocks, each a range of context hashes with about BLOCK tokens and never a row for each pair: a block is
a few numpy arrays. A context with more tokens than a block (at most SPLIT of them) is spread over all blocks by
its words. Root counts lie in blocks of word hashes.

Seating is sampled by Gibbs in turns. The root step sums the tables of each word over all blocks, draws the
root's own tables and answers each block with its words' root probabilities; then each block draws, one half of its pairs after the other, the
number of tables of each word in each restaurant from its exact conditional given the root: generalised Stirling numbers up to EXACT
customers, beyond by inversion of their saddle-point value on a grid around the mode. A word seen once in a context has one table, so only
pairs seen twice or more are sampled. Discounts and strengths of both levels are drawn on a grid of values by
the likelihood of the whole seating. After BURN turns SAMPLES seatings are kept. A word's probability is the mean of the restaurant's own part
plus the mean share it leaves to the root times the word's mean root probability, and these sum to one. Draws hash (word,
context, turn), so a repeated task gives the same seating.

Scoring sends each text's pairs to their blocks, a chunk of texts at a time, and sums what comes back.

Defined results: null text is empty (its end is its only token); rows of one id are scored each by itself; a row with a null id is
no training text; with no training text every token has probability one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stage
from .text import Words, chunks, mix

#: Tokens in a block of pairs, and most contexts that are spread over blocks.
BLOCK, SPLIT = 1 << 20, 1 << 20
EXACT, BURN, SAMPLES = 64, 2, 3
#: Tokens and texts that a worker gathers before it hands them on.
FLUSH, TEXTS = 1 << 20, 1 << 16
#: Scoring takes the blocks in so many rounds, each a pass over the texts, so that fewer pairs are on disk at once.
ROUNDS = 2
END, START = np.uint64(0xE5D00000000000E5), np.uint64(0x57A0000000000057)
GRID = np.arange(-2, 3)


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each text and their number)."""
    w = Words(buf, off, lower=True)
    return np.insert(w.hashes(), w.first[1:], END), w.first + np.arange(len(w.first))


def before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token: the token before it, or the start."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[first[:-1]] = START
    return out


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """A block for each hash; blocks are ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def member(sorted_set: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each x in a sorted set, whether it is there)."""
    if not len(sorted_set):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return at, sorted_set[at] == x


def grouped(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run of equal pairs in it, the runs' major and minor values), by major then minor."""
    a, ra = np.unique(major, return_inverse=True)
    b, rb = np.unique(minor, return_inverse=True)
    key = ra.astype(np.int64) << 32 | rb
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return order, at, a[key[at] >> 32], b[key[at] & 0xFFFFFFFF]


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of successive slices."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unblob(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def one(values: np.ndarray) -> pa.Array:
    return blobs(values, np.array([0, len(values)]))


# the sampler ---------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    small = x < 10
    y = np.where(small, x + 10, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if small.any():
        s = x[small]
        out[small] -= sum(np.log(s + i) for i in range(10))
    return out


def log_rising(theta: float, d: float, value: np.ndarray, times: np.ndarray) -> float:
    """The sum of log theta (theta + d) ... (theta + (n - 1) d) over all values n, each so many times."""
    return float(((value * np.log(d) + log_gamma(theta / d + value) - math.lgamma(theta / d)) * times).sum())


@functools.lru_cache(maxsize=32)
def stirling(d: float, upto: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t) for c, t <= upto."""
    s = np.full((upto + 1, upto + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(upto + 1)
    for c in range(upto):
        stay = s[c] + np.log(np.maximum(c - t * d, 1e-300))
        s[c + 1] = np.where(t <= c, stay, -np.inf)
        s[c + 1, 1:] = np.logaddexp(s[c + 1, 1:], s[c, :-1])
    return s


class Saddle:
    """log S_d(c, t) but for a term of c alone, by the saddle point of its generating function ((1 - (1 - x)^d) / d)^t / t!.

    The point depends on c / t only and is read from a table. What the approximation lacks for small t is taken from exact
    numbers at some sizes.
    """

    SIZES, SMALL = 2 ** np.arange(7, 13), 64

    def __init__(self, d: float):
        self.d = d
        self.ly = -np.exp(np.linspace(np.log(1e-9), np.log(600.0), 6000))  # log of y = 1 - x
        self.log_ratio = np.log(np.maximum(self._mean(self.ly) - 1, 1e-300))  # rises with -ly
        exact, t = np.full(self.SMALL + 1, -np.inf), np.arange(self.SMALL + 1)
        exact[0], lack = 0, []
        for c in range(self.SIZES[-1]):
            stay = exact + np.log(np.maximum(c - t * d, 1e-300))
            stay[1:] = np.logaddexp(stay[1:], exact[:-1])
            exact = stay
            if c + 1 in self.SIZES:
                e = exact[1:] - self._plain(np.full(self.SMALL, c + 1.0), t[1:].astype(float))
                lack.append(e - e[-1])
        self.lack = np.array(lack)

    def _mean(self, ly: np.ndarray) -> np.ndarray:
        return self.d * -np.expm1(ly) * np.exp((self.d - 1) * ly) / -np.expm1(self.d * ly)  # x g'(x) / g(x)

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = self._plain(c, t)
        small = np.nonzero(t < self.SMALL)
        if len(small[0]):
            t, c = t[small], np.broadcast_to(c, t.shape)[small]
            k, j = np.clip(np.log2(c) - 7, 0, len(self.SIZES) - 1.001), np.maximum(t - 1, 0)
            k0, j0 = k.astype(int), j.astype(int)
            near = [self.lack[k0 + i, j0] + (self.lack[k0 + i, np.minimum(j0 + 1, self.SMALL - 1)] - self.lack[k0 + i, j0]) * (j - j0) for i in (0, 1)]
            out[small] += near[0] + (near[1] - near[0]) * (k - k0)
        return out

    def _plain(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        d, t = self.d, np.minimum(t, c - 1e-6 * c)
        ly = np.interp(np.log(c / t - 1), self.log_ratio, self.ly)
        x, g = -np.expm1(ly), -np.expm1(d * ly) / d
        a = x * np.exp((d - 1) * ly) / g
        variance = np.maximum(t * a * (1 + (1 - d) * x * np.exp(-ly) - a), 1e-12)
        return t * np.log(g) - c * np.log(x) - log_gamma(t + 1) - 0.5 * np.log(variance)


@functools.lru_cache(maxsize=32)
def saddle_of(d: float) -> Saddle:
    return Saddle(d)


def uniforms(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    h = mix(a ^ mix(b + np.uint64(turn * 0x10001 + 17)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def draw_tables(c: np.ndarray, a: np.ndarray, log_p: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Numbers of tables for c customers each: S_d(c, t) a (a + d) ... (a + (t - 1) d) p^t is the weight of t; a: strength and d times the other tables."""
    out = np.minimum(c, 1).astype(np.int64)
    table = stirling(d, EXACT)
    key = np.minimum(c, EXACT + 1).astype(np.uint8)
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(2, EXACT + 2))
    for size, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]), 2):
        for at in range(lo, hi, 1 << 16):
            rows = order[at : min(hi, at + (1 << 16))]
            z = np.cumsum(np.log(a[rows, None] + d * np.arange(size)) + log_p[rows, None], 1) + table[size, 1 : size + 1]
            p = np.cumsum(np.exp(z - z.max(1, keepdims=True)), 1)
            out[rows] = 1 + (p < u[rows, None] * p[:, -1:]).sum(1)
    saddle = saddle_of(d) if bounds[-1] < len(order) else None
    for at in range(bounds[-1], len(order), 1 << 15):
        rows = order[at : at + (1 << 15)]
        n, base, lp = c[rows, None].astype(float), a[rows, None] / d, log_p[rows, None] + np.log(d)
        f = lambda t: saddle(n, t) + log_gamma(base + t) - log_gamma(base) + t * lp
        lo, hi = np.zeros(len(rows)), np.log(n[:, 0])
        for _ in range(5):  # the mode, on ever finer grids of log t
            t = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 9)
            k = f(np.exp(t)).argmax(1)
            lo, hi = np.take_along_axis(t, np.maximum(k - 1, 0)[:, None], 1)[:, 0], np.take_along_axis(t, np.minimum(k + 1, 8)[:, None], 1)[:, 0]
        mode = np.exp((lo + hi) / 2)[:, None]
        # a second difference gives the width
        h = np.maximum(0.02 * mode, 0.5)
        bend = (f(mode) * 2 - f(np.maximum(mode - h, 1.0)) - f(np.minimum(mode + h, n))) / h**2
        width = 1 / np.sqrt(np.maximum(bend, 1e-12))
        few = mode[:, 0] + 8 * width[:, 0] < 64
        if few.any():  # summed one by one
            n, base, lp = (x[few] for x in (n, base, lp))
            z = f(np.minimum(np.arange(1.0, 97.0)[None, :].repeat(len(n), 0), n)) + np.where(np.arange(1, 97) > n, -np.inf, 0)
            p = np.cumsum(np.exp(z - z.max(1, keepdims=True)), 1)
            out[rows[few]] = 1 + (p < u[rows[few], None] * p[:, -1:]).sum(1)
            rows, mode, width = rows[~few], mode[~few], width[~few]
            n, base, lp = c[rows, None].astype(float), a[rows, None] / d, log_p[rows, None] + np.log(d)
            if not len(rows):
                continue
        grid = np.clip(mode + np.minimum(6 * width, n) * np.linspace(-1, 1, 33), 0.5, n + 0.5)
        z = f(np.clip(grid, 1.0, n))
        p = np.exp(z - z.max(1, keepdims=True))
        mass = np.cumsum(np.concatenate((np.zeros((len(rows), 1)), (p[:, 1:] + p[:, :-1]) / 2 * np.diff(grid, axis=1)), 1), 1)
        goal = u[rows] * mass[:, -1]
        k = np.clip((mass <= goal[:, None]).sum(1), 1, 32)[:, None]
        m0, m1 = np.take_along_axis(mass, k - 1, 1)[:, 0], np.take_along_axis(mass, k, 1)[:, 0]
        g0, g1 = np.take_along_axis(grid, k - 1, 1)[:, 0], np.take_along_axis(grid, k, 1)[:, 0]
        drawn = g0 + (g1 - g0) * (goal - m0) / np.maximum(m1 - m0, 1e-300)
        out[rows] = np.clip(np.rint(drawn), 1, c[rows]).astype(np.int64)
    return out


def log_seats(d: float, c: np.ndarray, t: np.ndarray) -> float:
    """The sum of log S_d(c, t), but for terms of c alone."""
    small = c <= EXACT
    seen = np.bincount(c[small] * (EXACT + 1) + t[small], minlength=(EXACT + 1) ** 2)
    table = stirling(d, EXACT).ravel()
    out = float((seen[seen > 0] * table[np.flatnonzero(seen)]).sum())
    if not small.all():
        out += float(saddle_of(d)(c[~small].astype(float), t[~small].astype(float)).sum())
    return out


class Level:
    """Discount and strength of one level, drawn on grids that narrow from turn to turn."""

    def __init__(self, d: float, theta: float):
        self.d, self.theta, self.step = d, theta, 0.06

    def discounts(self) -> np.ndarray:
        return np.clip(self.d + self.step * GRID, 0.02, 0.98)

    def strengths(self) -> np.ndarray:
        return np.clip(self.theta * np.exp(8 * self.step * GRID), 0.01, 1e6)

    def drawn(self, by_d: np.ndarray, by_theta: np.ndarray, rng: np.random.Generator) -> Level:
        pick = lambda x: int(np.argmax(x + rng.gumbel(size=len(x))))
        # strengths have a Gamma(1, 0.1) prior
        new = Level(float(self.discounts()[pick(by_d)]), float(self.strengths()[pick(by_theta + np.log(self.strengths()) - 0.1 * self.strengths())]))
        new.step = self.step * 0.7
        return new


def restaurants(level: Level, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log likelihood of customers and tables of restaurants, for each discount and then each strength of the grids (without the Stirling numbers)."""
    pairs = [(d, level.theta) for d in level.discounts()] + [(level.d, x) for x in level.strengths()]
    guests, tables = np.unique(c, return_counts=True), np.unique(t, return_counts=True)
    return np.array([log_rising(x, d, *tables) - log_rising(x, 1.0, *guests) for d, x in pairs])


# blocks --------------------------------------------------------------------------------------------


#: Columns of blobs in the tables that hold blocks.
X = [f"x{i}" for i in range(8)]
SHAPE = "kind int, b int, at int, " + ", ".join(f"{x} binary" for x in X)
#: Kinds of rows. STATE: a block's contexts, their customers and pairs seen once; of the pairs seen more often the numbers of context and
#: word, the words, the customers and the tables (of all kept seatings and the last). ASK: its words for the root. ROOT: a block of words,
#: pairs seen once, tokens, the root's customers and tables. ANSWER: root probabilities for a STATE. ASKED: words with their
#: mean root probability and tokens. TEXTS_OF: pairs of a chunk of texts.
STATE, ASK, ROOT, ANSWER, ASKED, TEXTS_OF = range(6)


def row(kind: int, b: int, at: int, *values: np.ndarray) -> list[pa.Array]:
    return [pa.array([kind], pa.int32()), pa.array([b], pa.int32()), pa.array([at], pa.int32()), *(one(v) for v in values), *(pa.nulls(1, pa.binary()) for _ in X[len(values) :])]


def rows(kind: int, b: np.ndarray, at: np.ndarray, *values: pa.Array) -> list[pa.Array]:
    n = len(b)
    return [pa.array(np.full(n, kind, np.int32)), pa.array(b.astype(np.int32)), pa.array(at.astype(np.int32)), *values, *(pa.nulls(n, pa.binary()) for _ in X[len(values) :])]


def slices(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks that the sorted hashes fall in, bounds of their slices)."""
    of = block_of(h, blocks)
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    at = np.flatnonzero(new)
    return of[at], np.append(at, len(of))


def table_of(*parts: list[pa.Array], extra: dict[str, list[pa.Array]] | None = None) -> pa.Table:
    names = ["kind", "b", "at", *X]
    columns = {n: pa.chunked_array([p[i] for p in parts]) for i, n in enumerate(names)}
    return pa.table(columns | {k: pa.chunked_array(v) for k, v in (extra or {}).items()})


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the texts (word null), and those of the contexts that a worker sees four times or more among FLUSH tokens.

    A context that escapes this has less than a 500000th of the tokens, so its block stays near its size.
    """
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= 4
        return pa.RecordBatch.from_arrays([pa.array([None, *word[often].view(np.int64).tolist()], pa.int64()), pa.array([size, *n[often].tolist()], pa.int64())], ["w", "n"])

    for batch in batches:
        for _, _, buf, off in chunks(batch.column(0)):
            tokens, first = tokens_of(buf, off)
            held.append(before(tokens, first))
            size += len(tokens)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def gathered(batches: Iterator[pa.RecordBatch], limit: int = FLUSH) -> Iterator[tuple]:
    """(first row's number, other columns of the texts, tokens, first token of each text) for many successive texts at a time.

    Batches hold the text, the row's number and more columns; numbers follow each other within a partition.
    """
    tokens, sizes, rest, start, n = [], [], [], None, 0

    def out():
        first = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return start, [pa.chunked_array(c).combine_chunks() for c in zip(*rest)], np.concatenate(tokens), first

    for batch in batches:
        number = batch.column(1).to_numpy()
        for lo, hi, buf, off in chunks(batch.column(0)):
            for a in range(lo, hi, TEXTS // 2):  # a chunk may hold very many empty texts
                z = min(hi, a + TEXTS // 2)
                t, first = tokens_of(buf[off[a - lo] : off[z - lo]], off[a - lo : z - lo + 1] - off[a - lo])
                rows_held = sum(len(s) for s in sizes)
                if rows_held and (n + len(t) > limit or rows_held + z - a > TEXTS or number[a] != start + rows_held):
                    yield out()
                    tokens, sizes, rest, n = [], [], [], 0
                if not sizes:
                    start = int(number[a])
                tokens.append(t)
                sizes.append(np.diff(first))
                rest.append([c.slice(a, z - a) for c in batch.columns[2:]])
                n += len(t)
    if sizes:
        yield out()


def block_pairs(tokens: np.ndarray, context: np.ndarray, split: np.ndarray, blocks: int, turn: int | None = None):
    """Blocks with pairs, bounds of their slices, the pairs' contexts and words, tokens by pair and their bounds; of all blocks, or of one round."""
    spread = member(split, context)[1]
    mine = np.ones(len(tokens), bool) if turn is None else block_of(np.where(spread, tokens, context), blocks) % ROUNDS == turn
    for part, by_word in ((np.flatnonzero(~spread & mine), False), (np.flatnonzero(spread & mine), True)):
        if not len(part):
            continue
        major, minor = (tokens[part], context[part]) if by_word else (context[part], tokens[part])
        # sorted by half of each hash: a pair that a collision parts comes twice, and is merged in its block
        order = np.argsort(major >> np.uint64(32) << np.uint64(32) | minor >> np.uint64(32))
        a, b = major[order], minor[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        a, b = a[at], b[at]
        of, bounds = slices(a, blocks)
        yield of, bounds, (b, a) if by_word else (a, b), part[order], np.append(at, len(order))


def _count(blocks: int, split: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, words and training counts of the pairs of each block."""
    for _, (train,), tokens, first in gathered(batches):
        learn = np.repeat(np.asarray(train.to_numpy(zero_copy_only=False), bool), np.diff(first)).astype(np.uint32)
        for of, bounds, (u, w), order, at in block_pairs(tokens, before(tokens, first), split, blocks):
            c = np.add.reduceat(learn[order], at[:-1]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), blobs(u, bounds), blobs(w, bounds), blobs(c, bounds)], ["b", "u", "w", "c"])


def _build(blocks: int, d: float, group: pa.Table) -> pa.Table:
    """The state of a block, and its words for the root: all, with the pairs seen once and the training tokens of each."""
    u, w, c = (unblob(group.column(k), t) for k, t in (("u", np.uint64), ("w", np.uint64), ("c", np.uint32)))
    order, at, u, w = grouped(u, w)
    c = np.add.reduceat(c[order].astype(np.int64), at)
    b = group.column("b")[0].as_py()
    seen = c > 0
    contexts, ru = np.unique(u[seen], return_inverse=True)
    words, rw = np.unique(w, return_inverse=True)
    n = len(words)
    once = np.bincount(rw, c == 1, n).astype(np.int32)
    asked = rows(ASK, *(lambda of, bounds: (np.full(len(of), b), of, blobs(words, bounds), blobs(once, bounds), blobs(np.bincount(rw, c, n).astype(np.int64), bounds)))(*slices(words, blocks)))
    many = c > 1
    own_words, rq = np.unique(w[many], return_inverse=True)
    rank = np.zeros(len(c), np.int32)
    rank[seen] = ru
    tables = np.maximum(1, np.rint(c[many] ** d)).astype(np.int32)
    state = row(STATE, b, 0, contexts, np.bincount(ru, c[seen], len(contexts)).astype(np.int64), np.bincount(ru, c[seen] == 1, len(contexts)).astype(np.int64), rank[many], rq.astype(np.int32), own_words, c[many], tables)
    return table_of(state, asked)


def _words(level: Level, group: pa.Table) -> pa.Table:
    """A block of the root: words, pairs seen once, training tokens."""
    every = unblob(group.column("x0"), np.uint64)
    words, back = np.unique(every, return_inverse=True)
    once, c = (np.bincount(back, unblob(group.column(x), t), len(words)).astype(np.int64) for x, t in (("x1", np.int32), ("x2", np.int64)))
    none = np.zeros(0, np.int64)
    return table_of(row(ROOT, group.column("at")[0].as_py(), 0, words, once, c, none, none), extra={"tokens": [pa.array([int(c.sum())])], "words": [pa.array([int((c > 0).sum())])]})


def _ask(blocks: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each word of a block, for the root; the last of the kept seatings."""
    for batch in batches:
        for i in range(batch.num_rows):
            rq, words, tables = (np.frombuffer(batch.column(x)[i].as_py(), t) for x, t in (("x4", np.int32), ("x5", np.uint64), ("x7", np.int32)))
            of, bounds = slices(words, blocks)
            n = np.bincount(rq, tables[len(tables) - len(rq) :], len(words)).astype(np.int64)
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), batch.column("b")[i].as_py(), np.int32)), pa.array(of.astype(np.int32)), blobs(words, bounds), blobs(n, bounds)], ["b", "at", "x0", "x1"])


class Totals:
    """The root's customers, tables and parameters, the words, and customers and tables of contexts that are spread over blocks."""

    def __init__(self, root: Level, inner: Level, customers: float, tables: float, words: int, split_c: np.ndarray, split_t: np.ndarray):
        self.root, self.inner, self.customers, self.tables, self.words, self.split_c, self.split_t = root, inner, customers, tables, words, split_c, split_t

    def of_root(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probability of words with so many customers and tables in the root."""
        d, theta = self.root.d, self.root.theta
        return (c - d * t + (theta + d * self.tables) / (self.words + 1)) / (theta + self.customers)

    def share(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What restaurants with so many customers and tables leave to the root."""
        return (self.inner.theta + self.inner.d * t) / (self.inner.theta + c)

    def own(self, c: np.ndarray, t: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """The part of a word's probability that comes from its own tables."""
        return (c - self.inner.d * t) / (self.inner.theta + customers)


def _root_step(totals: Totals, turn: int, keep: bool, key, root: pa.Table, asked: pa.Table) -> pa.Table:
    """The root's tables given those of all blocks, and the answers to them; ``keep``: the tables before them are a sample."""
    words, once, c = (unblob(root.column(x), t) for x, t in (("x0", np.uint64), ("x1", np.int64), ("x2", np.int64)))
    old_c, old_t = (unblob(root.column(x), np.int64) for x in ("x3", "x4"))
    n = len(words)
    given, tables = unblob(asked.column("x0"), np.uint64), unblob(asked.column("x1"), np.int64)
    where = np.searchsorted(words, given)
    customers = once + np.bincount(where, tables, n).astype(np.int64)
    seats = old_t[len(old_t) - n :] if len(old_t) >= n else np.minimum(customers, 1)
    level = totals.root
    others = np.maximum(level.theta + level.d * (totals.tables - seats), 1e-9)
    seats = draw_tables(customers, others, np.full(n, -np.log(totals.words + 1)), level.d, uniforms(words, np.zeros(n, np.uint64), turn))
    if not keep:
        old_c, old_t = old_c[:0], old_t[:0]
    p = totals.of_root(customers, seats)
    size = np.array([len(x) // 8 for x in asked.column("x0").to_pylist()], np.int64)
    answer = rows(ANSWER, asked.column("b").to_numpy(), asked.column("at").to_numpy(), blobs(p[where], np.concatenate(([0], np.cumsum(size)))))
    by_d = np.array([log_seats(d, customers, seats) for d in level.discounts()])
    new = row(ROOT, key[0].as_py(), 0, words, once, c, np.concatenate((old_c, customers)), np.concatenate((old_t, seats)))
    stats = [pa.array([by_d.tolist()], pa.list_(pa.float64())), pa.nulls(len(size), pa.list_(pa.float64()))]
    count = lambda v: [pa.array([int(v.sum())], pa.int64()), pa.nulls(len(size), pa.int64())]
    return table_of(new, answer, extra={"likely": stats, "customers": count(customers), "tables": count(seats)})


def _sit(totals: Totals, split: np.ndarray, turn: int, keep: bool, key, state: pa.Table, answers: pa.Table) -> pa.Table:
    """A sweep over the pairs of a block, in two halves; ``keep``: the tables before them are a sample."""
    b = key[0].as_py()
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.int64, np.int32)
    contexts, customers, once, ru, rq, words, c, tables = (unblob(state.column(x), t) for x, t in zip(X, kinds))
    n = len(c)
    before, t = tables[: len(tables) - n], tables[len(tables) - n :].astype(np.int64)
    if keep:
        before = tables
    answers = answers.sort_by("at")
    log_p = np.log(np.maximum(unblob(answers.column("x0"), np.float64), 1e-300))[rq] if n else np.zeros(0)
    at, is_split = member(split, contexts)
    level = totals.inner
    inside = lambda: once + np.bincount(ru, t, len(contexts)).astype(np.int64)
    # tables of a spread context that other blocks hold, as of the last turn
    elsewhere = np.where(is_split, totals.split_t[at] - inside(), 0) if len(split) else np.zeros(len(contexts), np.int64)
    half = uniforms(words[rq], contexts[ru], 0) < 0.5 if n else np.zeros(0, bool)
    for side in (True, False):
        pick = np.flatnonzero(half == side)
        total = np.maximum(inside() + elsewhere, 0)[ru[pick]] - t[pick]
        u = uniforms(words[rq[pick]], contexts[ru[pick]], turn + 1)
        t[pick] = draw_tables(c[pick], np.maximum(level.theta + level.d * total, 1e-9), log_p[pick], level.d, u)
    held = inside()
    own = ~is_split
    likely = restaurants(level, customers[own], held[own])
    likely[: len(GRID)] += [log_seats(d, c, t) for d in level.discounts()]
    new = row(STATE, b, 0, contexts, customers, once, ru, rq, words, c, np.concatenate((before, t.astype(np.int32))))
    spread = pa.array([[{"u": int(u), "c": int(x), "t": int(y)} for u, x, y in zip(at[is_split], customers[is_split], held[is_split])]], SPREAD)
    return table_of(new, extra={"likely": [pa.array([likely.tolist()], pa.list_(pa.float64()))], "spread": [spread]})


SPREAD = pa.list_(pa.struct([("u", pa.int64()), ("c", pa.int64()), ("t", pa.int64())]))


class Model:
    """Seatings of all blocks, their totals, and the tokens and words of training."""

    def __init__(self, state: DataFrame | None, answers: DataFrame | None, samples: list[Totals], split: np.ndarray, blocks: int, tokens: int, words: int):
        self.state, self.answers, self.samples, self.split, self.blocks, self.tokens, self.words = state, answers, samples, split, blocks, tokens, words


def _mean_root(samples: list[Totals], key, root: pa.Table, asked: pa.Table) -> pa.Table:
    """The words of each block with their mean root probability and training tokens."""
    words, c = unblob(root.column("x0"), np.uint64), unblob(root.column("x2"), np.int64)
    customers, tables = (unblob(root.column(x), np.int64).reshape(len(samples), len(words)) for x in ("x3", "x4"))
    p = np.mean([s.of_root(x, y) for s, x, y in zip(samples, customers, tables)], 0)
    given = unblob(asked.column("x0"), np.uint64)
    where = np.searchsorted(words, given)
    bounds = np.concatenate(([0], np.cumsum([len(x) // 8 for x in asked.column("x0").to_pylist()])))
    return table_of(rows(ASKED, asked.column("b").to_numpy(), asked.column("at").to_numpy(), blobs(given, bounds), blobs(p[where].astype(np.float32), bounds), blobs(c[where], bounds)))


def bound(f: Callable, *args) -> Callable:
    """f with its first arguments given, as a function of a key and two tables."""
    return lambda key, left, right: f(*args, key, left, right)


def learn(texts: DataFrame, stage: Stage, block: int = BLOCK) -> Model:
    """texts(text, train boolean): seatings of all training texts, and root probabilities for every word of any text."""
    found = stage.table(texts.select("text").mapInArrow(_survey, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    every = found.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-every // block))
    often = found.where(F.col("w").isNotNull() & (2 * F.col("n") * min(blocks, SPLIT) > every)).select("w").collect() if blocks > 1 else []  # 2 * SPLIT rows at most
    split = np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))
    read = texts.select("text", F.monotonically_increasing_id().alias("rid"), "train")
    root, inner = Level(0.5, 10.0), Level(0.75, 2.0)
    counted = read.mapInArrow(lambda it: _count(blocks, split, it), "b int, u binary, w binary, c binary")
    built = stage.table(counted.groupBy("b").applyInArrow(lambda t: _build(blocks, inner.d, t), SHAPE), by=["kind"])
    state, asked = built.where(F.col("kind") == STATE), built.where(F.col("kind") == ASK)
    words = stage.table(asked.groupBy("at").applyInArrow(lambda t: _words(root, t), SHAPE + ", tokens long, words long"))
    tokens, known = (int(x or 0) for x in words.agg(F.sum("tokens"), F.sum("words")).first())
    if not tokens:
        return Model(None, None, [], split, blocks, 0, 0)
    rng, samples = np.random.default_rng(23), []
    totals = Totals(root, inner, float(tokens), float(known), known, np.zeros(len(split)), np.zeros(len(split)))
    root_shape, state_shape = SHAPE + ", likely array<double>, customers long, tables long", SHAPE + ", likely array<double>, spread array<struct<u: long, c: long, t: long>>"
    n, stepped = len(GRID), words
    for turn in range(BURN + SAMPLES):
        # the seating that a turn starts from is a sample after BURN turns, and the root drawn for it belongs to it
        keep, last = turn >= BURN, stepped
        questions = state.mapInArrow(lambda it: _ask(blocks, it), "b int, at int, x0 binary, x1 binary")
        step = words.groupBy("b").cogroup(questions.groupBy("at")).applyInArrow(bound(_root_step, totals, turn, turn > BURN), root_shape)
        stepped = stage.table(step, by=["kind"])
        words = stepped.where(F.col("kind") == ROOT)
        stage.drop_table(last)
        got = words.agg(F.sum("customers"), F.sum("tables"), *(F.sum(F.col("likely")[i]) for i in range(n))).first()
        customers, tables = np.array([float(got[0])]), np.array([float(got[1])])
        by_root = restaurants(root, customers, tables)
        by_root[:n] += np.array(got[2:], float)
        totals = Totals(root, inner, customers[0], tables[0], known, totals.split_c, totals.split_t)
        if keep:
            samples.append(totals)
            if len(samples) == SAMPLES:
                break
        root = root.drawn(by_root[:n], by_root[n:], rng)
        answers = stepped.where(F.col("kind") == ANSWER)
        sat = state.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(bound(_sit, totals, split, turn, keep), state_shape)
        sat = stage.table(sat)
        if turn:
            stage.drop_table(state)
        state = sat.select("kind", "b", "at", *X)
        got = np.array(sat.agg(*(F.sum(F.col("likely")[i]) for i in range(2 * n))).first(), float)
        split_c, split_t = np.zeros(len(split)), np.zeros(len(split))
        if len(split):
            for u, x, y in sat.select(F.explode("spread").alias("s")).groupBy("s.u").agg(F.sum("s.c"), F.sum("s.t")).collect():  # a row for each spread context
                split_c[u], split_t[u] = x, y
            got += restaurants(inner, split_c[split_c > 0], split_t[split_c > 0])
        inner = inner.drawn(got[:n], got[n:], rng)
        totals = Totals(root, inner, customers[0], tables[0], known, split_c, split_t)
    mean = words.groupBy("b").cogroup(asked.select("b", "at", "x0").groupBy("at")).applyInArrow(bound(_mean_root, samples), SHAPE)
    answers = stage.table(mean)
    stage.drop_table(built)
    stage.drop_table(stepped)
    return Model(state, answers, samples, split, blocks, tokens, known)


# scoring -------------------------------------------------------------------------------------------


def _occurrences(blocks: int, split: np.ndarray, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of texts: a row without a block that holds what the texts are, and the chunk's pairs for each block, with the texts they stand in."""
    names = ["kind", "b", "at", *X, "chunk", "ids", "held"]
    lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    for start, (ids, held, train), tokens, first in gathered(batches):
        size = np.diff(first)
        learn = np.repeat(np.asarray(train.to_numpy(zero_copy_only=False), bool), size).astype(np.uint32)
        whole = row(TEXTS_OF, -1 - start % blocks, turn, size.astype(np.int64))
        yield pa.RecordBatch.from_arrays([*whole, pa.array([start]), lists(ids), lists(held)], names)
        text = np.repeat(np.arange(len(size)), size).astype(np.uint16)
        for of, bounds, (u, w), order, at in block_pairs(tokens, before(tokens, first), split, blocks, turn):
            n = len(of)
            data = rows(TEXTS_OF, of, np.zeros(n), blobs(u, bounds), blobs(w, bounds), blobs(np.diff(at).astype(np.uint32), bounds), blobs(text[order], at[bounds]), blobs(np.add.reduceat(learn[order], at[:-1]).astype(np.uint32), bounds))
            yield pa.RecordBatch.from_arrays([*data, pa.array(np.full(n, start, np.int64)), pa.nulls(n, pa.list_(ids.type)), pa.nulls(n, pa.list_(pa.bool_()))], names)


def pair_values(samples: list[Totals], split: np.ndarray, state: pa.Table, answers: pa.Table, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean probability, training tokens of the word) of distinct pairs; c: training counts where the block has no row for the pair (0 or 1)."""
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint64, np.int64, np.int32)
    contexts, customers, once, ru, rq, words, many, tables = (unblob(state.column(x), t) for x, t in zip(X, kinds))
    answers = answers.sort_by("at")
    every, root, count = (unblob(answers.column(x), t) for x, t in (("x0", np.uint64), ("x1", np.float32), ("x2", np.int64)))
    at_word = np.searchsorted(every, w)
    at_context, known = member(contexts, u)
    rank, has = member(words, w)
    # pairs of the state by number of context and word; they lie in that order
    at_pair, often = member(ru.astype(np.int64) << 32 | rq, at_context.astype(np.int64) << 32 | rank)
    often &= known & has
    own, share = np.zeros(len(u)), np.zeros(len(u))
    tables = tables.reshape(-1, len(many)) if len(many) else np.zeros((len(samples), 0), np.int64)
    at_split, is_split = member(split, contexts)
    for s, t in zip(samples, tables):
        of_context = once + np.bincount(ru, t, len(contexts)).astype(np.int64)
        total = customers
        if len(split):
            total, of_context = np.where(is_split, s.split_c[at_split], customers), np.where(is_split, s.split_t[at_split], of_context)
        if len(contexts):
            share += np.where(known, s.share(total, of_context)[at_context], 1) / len(samples)
            seats, guests = (np.where(often, x[at_pair], c) if len(x) else c for x in (t, many))
            own += np.where(known, s.own(guests, seats, total[at_context]), 0) / len(samples)
        else:
            share += 1 / len(samples)
    return own + share * root[at_word], count[at_word]


def _look_up(model: tuple, group: pa.Table) -> pa.Table:
    """Sums for each text of a chunk over the pairs of one block; what the texts are passes through."""
    samples, split, floor = model
    kind = group.column("kind").to_numpy()
    out = {"chunk": [], "ids": [], "held": [], "size": [], "text": [], "p": [], "base": [], "seen": []}
    texts = group.filter(pa.array(kind == TEXTS_OF))
    if texts.num_rows and texts.column("b")[0].as_py() < 0:
        n = texts.num_rows
        return pa.table({"chunk": texts.column("chunk"), "ids": texts.column("ids"), "held": texts.column("held"), "size": texts.column("x0"), **{k: pa.nulls(n, pa.binary()) for k in ("text", "p", "base", "seen")}})
    if texts.num_rows:
        us, ws, ns, of, learn = ([np.frombuffer(x, t) for x in texts.column(k).to_pylist()] for k, t in (("x0", np.uint64), ("x1", np.uint64), ("x2", np.uint32), ("x3", np.uint16), ("x4", np.uint32)))
        order, at, u, w = grouped(np.concatenate(us), np.concatenate(ws))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        c = np.add.reduceat(np.concatenate(learn)[order].astype(np.int64), at)
        p, count = pair_values(samples, split, group.filter(pa.array(kind == STATE)), group.filter(pa.array(kind == ASKED)), u, w, np.minimum(c, 1))
        p, base, seen = np.log10(np.clip(p, 1e-300, 1)), np.log10((count + 0.5) / floor), (count > 0).astype(float)
        lo = 0
        for chunk, n, t in zip(texts.column("chunk").to_pylist(), ns, of):
            mine = np.repeat(pair[lo : lo + len(n)], n)
            lo += len(n)
            there = np.flatnonzero(np.bincount(t))
            sums = [np.bincount(t, x[mine])[there] for x in (p, base, seen)]
            out["chunk"].append(chunk)
            for k, v in zip(("text", "p", "base", "seen"), (there.astype(np.uint16), *sums[:2], sums[2].astype(np.uint32))):
                out[k].append(v.tobytes())
    n = len(out["chunk"])
    ids, held = group.schema.field("ids").type, group.schema.field("held").type
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "ids": pa.nulls(n, ids), "held": pa.nulls(n, held), "size": pa.nulls(n, pa.binary()), **{k: pa.array(out[k], pa.binary()) for k in ("text", "p", "base", "seen")}})


SUMS = ("p", "base", "seen")


def _chunk_sums(group: pa.Table) -> pa.Table:
    """A chunk's texts with the sums over the blocks of one round."""
    head = group.filter(group.column("size").is_valid())
    sums = [np.zeros(len(unblob(head.column("size"), np.int64))) for _ in SUMS]
    parts = group.filter(group.column("text").is_valid())
    for t, *values in zip(*(parts.column(k).to_pylist() for k in ("text", *SUMS))):
        t = np.frombuffer(t, np.uint16)
        for s, v, kind in zip(sums, values, (np.float64, np.float64, np.uint32)):
            s[t] += np.frombuffer(v, kind)
    return pa.table({k: head.column(k) for k in ("chunk", "ids", "held", "size")} | {k: one(s) for k, s in zip(SUMS, sums)})


def _summed(group: pa.Table) -> pa.Table:
    """The texts of a chunk with the sums over all rounds."""
    group = group.combine_chunks()
    head = group.slice(0, 1)
    if group.num_rows != ROUNDS or any(group.column(k)[i] != head.column(k)[0] for k in ("ids", "size") for i in range(group.num_rows)):
        raise RuntimeError("the rows of the input came in another order when it was read again: write it to a table before scoring")
    flat = lambda k: head.column(k).combine_chunks().flatten()
    sums = [unblob(group.column(k), np.float64).reshape(ROUNDS, -1).sum(0) for k in SUMS]
    return pa.table({"id": flat("ids"), "held": flat("held"), "n_tokens": pa.array(unblob(head.column("size"), np.int64)), "p": pa.array(sums[0]), "base": pa.array(sums[1]), "seen": pa.array(np.rint(sums[2]).astype(np.int64))})


def _unlearnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(0)):
            n, none = hi - lo, np.zeros(hi - lo)
            size = np.diff(tokens_of(buf, off)[1])
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in batch.columns[2:4]), pa.array(size), pa.array(none), pa.array(none), pa.array(none.astype(np.int64))], ["id", "held", "n_tokens", "p", "base", "seen"])


def scored(texts: DataFrame, model: Model, stage: Stage) -> DataFrame:
    """(id, held, n_tokens, p, base, seen) of texts(text, id, held, train): log10 probabilities and known tokens."""
    kind = texts.schema["id"].dataType.simpleString()
    result = f"id {kind}, held boolean, n_tokens long, p double, base double, seen long"
    read = texts.select("text", F.monotonically_increasing_id().alias("rid"), "id", "held", "train")
    if model.state is None:
        return read.mapInArrow(_unlearnt, result)
    blocks, split = model.blocks, model.split
    sent = (model.samples, split, model.tokens + 0.5 * (model.words + 1))
    more = f"chunk long, ids array<{kind}>, held array<boolean>"
    columns = ["kind", "b", "at", *X]
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("ids", f"array<{kind}>"), ("held", "array<boolean>"))]
    found = None
    for turn in range(ROUNDS):
        every = read.mapInArrow(lambda it, turn=turn: _occurrences(blocks, split, turn, it), f"{SHAPE}, {more}")
        for known in (model.state, model.answers):
            every = every.union(known.where(F.col("b") % ROUNDS == turn).select(*columns, *blank))
        looked = every.groupBy("b").applyInArrow(lambda t: _look_up(sent, t), f"{more}, size binary, text binary, p binary, base binary, seen binary")
        sums = stage.table(looked.groupBy("chunk").applyInArrow(_chunk_sums, f"{more}, size binary, p binary, base binary, seen binary"))
        found = sums if found is None else found.union(sums)
    return stage.table(found.groupBy("chunk").applyInArrow(_summed, result))


def prepared(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(~held_out, F.lit(False)).alias("train"))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; it learns from rows where held_out is false."""
    stage = Stage(docs.sparkSession, "pitmanyor")
    texts = prepared(docs, held_out, id_col, text_col)
    model = learn(texts, stage, block)
    found = scored(texts, model, stage)
    return found.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", F.col("seen").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("p").alias("score"))
