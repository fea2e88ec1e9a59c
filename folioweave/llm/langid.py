"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each run of letters (cut every SPAN bytes) in both directions and labels every byte with
language probabilities; a document's probabilities are the mean over all its letter bytes. It is trained in numpy by
backpropagation through time on a bounded, documented sample of labelled documents (about TRAIN_DOCS for each language, each distinct
run of their whole texts once for each language). States start anew at each run, so equal runs have equal labels: a worker scores each distinct run once.

Defined results: null text or one without a letter is ``und`` with score 0; with no labelled rows at all every text
is ``und``. Ties go to the language that sorts first. Other columns are not read; one named lang_pred or score gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .text import LOWER, Growing, HashStore, Words, chunks

TRAIN_DOCS, SPAN = 400, 16
EMBED, HIDDEN = 10, 16
#: Runs whose labels a worker keeps.
KEPT = 1 << 18
#: Every byte that is no letter of ASCII and no part of a longer UTF-8 sequence parts the runs.
GAP = np.ones(256, bool)
GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Weights and passes; all runs of a batch have one length, so nothing is padded."""

    def __init__(self, classes: int, seed: int = 5):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"emb": init(256, EMBED) * 4, "out": init(2 * HIDDEN, classes), "bout": np.zeros(classes, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": init(EMBED, 3 * HIDDEN), f"h{d}": init(HIDDEN, 3 * HIDDEN), f"bias{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _direction(self, ids: np.ndarray, d: str, keep: bool):
        n, t = ids.shape
        table = self.w["emb"] @ self.w[f"x{d}"] + self.w[f"bias{d}"]  # the input projection of each byte value
        h = np.zeros((n, HIDDEN), np.float32)
        out, tape = np.empty((t, n, HIDDEN), np.float32), []
        wh = self.w[f"h{d}"]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            x, u = table[ids[:, s]], h @ wh
            g = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            reset, update = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + reset * u[:, 2 * HIDDEN :])
            new = c + update * (h - c)
            if keep:
                tape.append((s, h, reset, update, c, u[:, 2 * HIDDEN :]))
            out[s] = h = new
        return out, tape

    def probabilities(self, ids: np.ndarray, keep: bool = False):
        """(position, run, class)"""
        f, tf = self._direction(ids, "f", keep)
        b, tb = self._direction(ids, "b", keep)
        hidden = np.concatenate((f, b), 2)
        z = hidden @ self.w["out"] + self.w["bout"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return (z, hidden, tf, tb) if keep else z

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradient through time."""
        p, hidden, tf, tb = self.probabilities(ids, True)
        t, n, _ = p.shape
        loss = -float(np.log(p[:, np.arange(n), y] + 1e-12).mean())
        dz = p.copy()
        dz[:, np.arange(n), y] -= 1
        dz /= t * n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.tensordot(hidden, dz, ((0, 1), (0, 1)))
        g["bout"] = dz.sum((0, 1))
        dh_all = dz @ self.w["out"].T
        for d, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
            dtable = np.zeros((256, 3 * HIDDEN), np.float32)
            carry = np.zeros((n, HIDDEN), np.float32)
            wh = self.w[f"h{d}"]
            for s, h, reset, update, c, uc in reversed(tape):
                dh = dh_all[s, :, lo : lo + HIDDEN] + carry
                dc = dh * (1 - update) * (1 - c * c)
                dupdate = dh * (h - c) * update * (1 - update)
                dreset = dc * uc * reset * (1 - reset)
                du = np.concatenate((dreset, dupdate, dc * reset), 1)
                dx = np.concatenate((dreset, dupdate, dc), 1)
                g[f"h{d}"] += h.T @ du
                carry = dh * update + du @ wh.T
                np.add.at(dtable, ids[:, s], dx)
            g["emb"] += dtable @ self.w[f"x{d}"].T
            g[f"x{d}"] = self.w["emb"].T @ dtable
            g[f"bias{d}"] = dtable.sum(0)
        return loss, g


def train(runs: list[bytes], labels: np.ndarray, classes: int, epochs: int = 4, batch: int = 384, rate: float = 0.01, seed: int = 11) -> BiGRU:
    """Adam over batches of runs of one length."""
    net, rng = BiGRU(classes), np.random.default_rng(seed)
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(runs):
        by_length.setdefault(len(r), []).append(i)
    jobs = []
    for n, rows in sorted(by_length.items()):
        ids = np.frombuffer(b"".join(runs[i] for i in rows), np.uint8).reshape(len(rows), n)
        jobs += [(ids[lo : lo + batch], labels[rows[lo : lo + batch]]) for lo in range(0, len(rows), batch)]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        for j in rng.permutation(len(jobs)):
            ids, y = jobs[j]
            step += 1
            _, g = net.gradients(ids, y)
            size = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
            pace = rate * len(y) / batch * (1 - epoch / (epochs + 1))
            for k, x in g.items():
                x = x * size
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.99 * s[k] + 0.01 * x * x
                net.w[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    return net


def runs_in(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, first run of each text) of the letter runs, each SPAN bytes at most."""
    w = Words(buf, off, space=GAP)
    low = LOWER[buf]
    size = w.end - w.start
    if not len(size) or size.max() <= SPAN:
        return low, w.start, w.end, w.first
    parts = -(-size // SPAN)
    upto = np.concatenate(([0], np.cumsum(parts)))
    start = np.repeat(w.start, parts) + SPAN * (np.arange(upto[-1]) - np.repeat(upto[:-1], parts))
    return low, start, np.minimum(start + SPAN, np.repeat(w.end, parts)), upto[w.first]


class Labeller:
    """Document probabilities under one network; keeps the labels of runs it has seen."""

    def __init__(self, net: BiGRU, classes: int):
        self.net, self.classes = net, classes
        self.store, self.values = HashStore(), Growing(np.float32, classes)

    def _score(self, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The sum over positions of the probabilities of each run."""
        out = np.empty((len(start), self.classes), np.float32)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for lo in range(0, len(rows), 2048):
                part = rows[lo : lo + 2048]
                out[part] = self.net.probabilities(low[start[part, None] + np.arange(n)]).sum(0)
        return out

    def documents(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of probabilities over letter bytes, number of letter bytes) of each text."""
        low, start, end, first = runs_in(buf, off)
        probe = Words.__new__(Words)
        probe.buf, probe.start, probe.end = low, start, end
        keys, at, back = np.unique(probe.hashes(), return_index=True, return_inverse=True)
        number = self.store.find(keys)
        if self.store.size + int((number < 0).sum()) > KEPT:
            self.store, self.values = HashStore(), Growing(np.float32, self.classes)
            number[:] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            self.values.extend(self._score(low, start[at[new]], (end - start)[at[new]]))
            number[new] = self.store.add(keys[new])
        run = self.values.array[number[back]].astype(np.float64)
        upto = np.concatenate((np.zeros((1, self.classes)), np.cumsum(run, 0)))
        total = upto[first[1:]] - upto[first[:-1]]
        bytes_upto = np.concatenate(([0], np.cumsum(end - start)))
        return total, bytes_upto[first[1:]] - bytes_upto[first[:-1]]


_labellers: dict[int, Labeller] = {}


def _predict(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model_id, names, net = sent.value
    if model_id not in _labellers:  # a reused worker goes on with what it has labelled
        _labellers.clear()
        _labellers[model_id] = Labeller(net, len(names)) if names else None
    labeller = _labellers[model_id]
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        rest = batch.columns[:-1]
        for lo, hi, buf, off in chunks(text):
            label = np.full(hi - lo, "und", object)
            score = np.zeros(hi - lo)
            if names:
                total, n = labeller.documents(buf, off)
                for i in np.flatnonzero(n):
                    own = buf[off[i] : off[i + 1]]
                    ascii_letter = (own | 32) - 97 < 26  # bytes wrap below 'a'
                    if ascii_letter.any() or any(c.isalpha() for c in own.tobytes().decode("utf-8", "ignore")):
                        k = int(np.argmax(total[i]))
                        label[i], score[i] = names[k], min(1.0, total[i, k] / n[i])
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), pa.array(label, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of each text with its label."""
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(1)):
            low, start, end, first = runs_in(buf, off)
            runs = [sorted({low[start[i] : end[i]].tobytes() for i in range(a, b)}) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            label = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), [len(r) for r in runs])))
            yield pa.RecordBatch.from_arrays([label, pa.array([x for r in runs for x in r], pa.binary())], ["l", "run"])


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order: Column | None = None) -> tuple[int, list[str], BiGRU | None]:
    """(model id, languages, network) from the whole texts of about TRAIN_DOCS labelled documents of each language.

    The hash ``order`` (of the text, unless given) picks the documents, so the sample is the same in every run.
    """
    some = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in some.groupBy(F.col(label_col).cast("string")).count().collect()}  # languages: a bounded set
    names = sorted(counts)
    if not names:
        return 0, [], None
    place = F.pmod(F.xxhash64(F.col(text_col)) if order is None else order, F.lit(1 << 20))
    upto = F.coalesce(*(F.when(F.col(label_col) == name, F.lit(-(-TRAIN_DOCS * (1 << 20) // counts[name]))) for name in names))
    picked = some.where(place < upto).select(F.col(label_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("x")).limit(2 * TRAIN_DOCS * len(names))
    # distinct runs of SPAN bytes at most: whole texts never reach the driver
    pairs = picked.mapInArrow(_runs, "l string, run binary").distinct().toArrow()
    found = list(zip(pairs.column("run").to_pylist(), (names.index(x) for x in pairs.column("l").to_pylist())))
    if not found:
        return 0, [], None
    found.sort()  # partitions come in any order
    runs, y = [x[0] for x in found], np.array([x[1] for x in found])
    return xxhash.xxh3_64_intdigest(b"\0".join(runs) + y.tobytes()), names, train(runs, y, len(names))


def identify(docs: DataFrame, model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of docs (default all but the text), lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score") and (keep is not None or c != text_col)]
    fields = [docs.schema[c] for c in keep]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    shape = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "lang_pred string", "score double"])
    out = plain.mapInArrow(lambda it: trimmed(_predict(sent, it)), shape)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
