"""Toxicity of documents by a convolutional text classifier.

Words (runs of letters, A-Z lower-cased, other characters as gaps) are hashed into BUCKETS embeddings
(tagged, so that an unknown word does not borrow another's); filters of several
widths run over the whole text, each keeps its maximum, and a logistic layer reads the maxima. Everything is trained in
numpy on all labelled documents: the vocabulary is counted over them, and in each turn shards of about SHARD_WORDS words are
trained side by side from the same parameters, which are then averaged. The score is Platt-calibrated on a fifth of the
documents, held back from training and picked by a hash, shifted so that OPERATING is the best cut. Raw scores lie on a grid of
1 / GRID, so that counts of documents by raw score, class and language hold all that calibration needs.
Per-language cuts are calibrated on the same documents (``Model.thresholds``) and give ``predicted_lang``; the score itself never sees the language.

Since a filter is linear, its response at a place is a sum of per-bucket tables, one for each position of the window: scoring
is table look-ups and a maximum, over whole texts.

Defined results: null or empty text, or one without words, scores as a text of no filter responses (the bias alone); null
labels are not learnt from; without both classes among the labelled rows every score is the share of toxic ones (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import GAP
from .shared import Stage
from .text import LOWER, Words, chunks

BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: A word has an embedding if it is in so many training documents; the bucket BUCKETS, all zero, stands for the others.
MIN_DOCS = 4
#: Words of a shard of the training documents.
SHARD_WORDS = 4 << 20
GRID, FARTHEST = 1024, 1 << 20
OPERATING = 0.7


@dataclass
class Model:
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, BUCKETS, FILTERS)
    tags: np.ndarray | None = None  # which word a bucket is for; a word that merely shares it reads the zero bucket
    bias: np.ndarray | None = None
    weight: np.ndarray | None = None
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> np.uint64(48)).astype(np.int32)
        return np.where(self.tags[bucket] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket, np.int32(BUCKETS))

    def features(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, filters) maxima over each whole text; a text shorter than a filter has zero there, as have negative maxima."""
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        for k, width in enumerate(WIDTHS):
            n = len(ids) - width + 1
            if n <= 0:
                continue
            response = self.tables[width][0][ids[:n]]
            for j in range(1, width):
                response += self.tables[width][j][ids[j : n + j]]
            a, b = first[:-1], np.minimum(first[1:] - width + 1, n)
            rows = np.flatnonzero(b > a)
            if len(rows):
                bounds = np.stack((a[rows], b[rows]), 1).ravel()
                if bounds[-1] == n:
                    bounds = bounds[:-1]
                top = np.maximum.reduceat(response, bounds, 0)[::2]
                out[rows, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top + self.bias[k], 0)
        return out

    def raw(self, features: np.ndarray) -> np.ndarray:
        """Raw scores in steps of 1 / GRID, cut beyond FARTHEST steps."""
        return np.rint(np.clip(features.astype(np.float64) @ self.weight * GRID, -FARTHEST, FARTHEST)).astype(np.int64)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.raw(features) / GRID
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -500, 500)))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = Words(buf, off, space=GAP)
    w.buf = LOWER[buf]
    return w.hashes(), w.first


def begin(seed: int = 3) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Parameters before training, and the mean squares of their gradients."""
    rng = np.random.default_rng(seed)
    net = {"emb": rng.normal(size=(BUCKETS + 1, EMBED)) * 0.05}
    net["emb"][BUCKETS] = 0
    net |= {f"conv{w}": rng.normal(size=(w, EMBED, FILTERS)) / np.sqrt(w * EMBED) for w in WIDTHS}
    net |= {"bias": np.zeros((len(WIDTHS), FILTERS)), "weight": rng.normal(size=FILTERS * len(WIDTHS)) * 0.3, "shift": np.zeros(1)}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    return net, {k: np.zeros_like(v) for k, v in net.items()}


def turn(net: dict[str, np.ndarray], square: dict[str, np.ndarray], texts: list[np.ndarray], y: np.ndarray, balance: np.ndarray, pace: float, rng: np.random.Generator) -> np.ndarray:
    """One pass of RMS-scaled steps on the logistic loss, in place; the gradient of a maximum flows to the window that holds it.

    ``balance`` holds the weight of each class. The result marks the buckets whose embedding took a step.
    """
    emb, bias, weight, conv = net["emb"], net["bias"], net["weight"], {w: net[f"conv{w}"] for w in WIDTHS}
    stepped = np.zeros(BUCKETS, bool)
    order = rng.permutation(len(texts))
    for lo in range(0, len(order), 32):
        rows = order[lo : lo + 32]
        g = {k: np.zeros_like(v) for k, v in net.items() if k != "emb"}
        touched, grads = [], []
        for r in rows:
            ids = texts[r]
            feats, wins = np.zeros((len(WIDTHS), FILTERS), np.float32), {}
            uniq, back = np.unique(ids, return_inverse=True)
            e = emb[uniq]
            for k, width in enumerate(WIDTHS):
                n = len(ids) - width + 1
                if n > 0:
                    resp = (e @ conv[width][0])[back[:n]]
                    for j in range(1, width):
                        resp = resp + (e @ conv[width][j])[back[j : n + j]]
                    at = resp.argmax(0)
                    top = resp[at, np.arange(FILTERS)] + bias[k]
                    feats[k], wins[width] = np.maximum(top, 0), (at, top > 0)
            z = float(feats.ravel() @ weight + net["shift"][0])
            d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[r]) * balance[y[r]] / len(rows)
            g["weight"] += d * feats.ravel()
            g["shift"] += d
            back_feats = d * weight.reshape(len(WIDTHS), FILTERS)
            for k, width in enumerate(WIDTHS):
                if width in wins:
                    at, on = wins[width]
                    df = np.where(on, back_feats[k], 0)
                    g["bias"][k] += df
                    for j in range(width):
                        own = ids[at + j]
                        g[f"conv{width}"][j] += emb[own].T * df
                        touched.append(own)
                        grads.append((conv[width][j] * df).T)
        for name, value in g.items():
            square[name] *= 0.95
            square[name] += 0.05 * value**2
            net[name] -= pace * value / (np.sqrt(square[name]) + 1e-4)
        if touched:  # sparse step: only buckets that held a maximum
            own, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            real = own < BUCKETS
            total = np.zeros((len(own), EMBED), np.float32)
            np.add.at(total, inverse, np.concatenate(grads))
            own, total = own[real], total[real]
            square["emb"][own] = 0.95 * square["emb"][own] + 0.05 * total**2
            emb[own] -= pace * total / (np.sqrt(square["emb"][own]) + 1e-4)
            stepped[own] = True
    return stepped


def _dense(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net) if k != "emb"])


PARTS = 64
MOVED = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("docs", pa.int64()), ("own", pa.binary()), ("net", pa.binary()), ("square", pa.binary())])
MOVED_SQL = "part int, shard long, docs long, own binary, net binary, square binary"


def _shard_turn(sent, epoch: int, group: pa.Table) -> pa.Table:
    """What a turn over the documents of a shard makes of the parameters: part -1 holds all but embeddings, part k a range of buckets."""
    net, square, balance, pace = sent.value
    net, square = ({k: v.copy() for k, v in x.items()} for x in (net, square))
    group = group.sort_by([("key", "ascending"), ("y", "ascending")])  # rows come in any order
    texts = [np.frombuffer(x.as_buffer(), np.int32) for x in group.column("ids")]
    shard = group.column("shard")[0].as_py()
    stepped = turn(net, square, texts, group.column("y").to_numpy(), balance, pace, np.random.default_rng((epoch, shard)))
    rows = [(-1, shard, len(texts), b"", _dense(net).tobytes(), _dense(square).tobytes())]
    size = BUCKETS // PARTS
    for part in range(PARTS):
        own = np.flatnonzero(stepped[part * size : (part + 1) * size]) + part * size
        if len(own):
            rows.append((part, shard, len(texts), own.astype(np.int32).tobytes(), net["emb"][own].tobytes(), square["emb"][own].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MOVED.types)], schema=MOVED)


def _averaged(group: pa.Table) -> pa.Table:
    """The mean of a part over the shards, weighted by their documents; an embedding's is over the shards that changed it."""
    rows = group.sort_by("shard").to_pylist()
    part, size = rows[0]["part"], BUCKETS // PARTS
    shape = (size, EMBED) if part >= 0 else (1, len(rows[0]["net"]) // 4)
    sums, docs = [np.zeros(shape), np.zeros(shape)], np.zeros((shape[0], 1))
    for r in rows:
        own = np.frombuffer(r["own"], np.int32) - part * size if part >= 0 else np.zeros(1, np.int32)
        docs[own] += r["docs"]
        for total, name in zip(sums, ("net", "square")):
            total[own] += np.frombuffer(r[name], np.float32).reshape(-1, shape[1]).astype(np.float64) * r["docs"]
    own = np.flatnonzero(docs)
    means = [(total[own] / docs[own]).astype(np.float32).tobytes() for total in sums]
    out = (part, 0, 0, (own + max(part, 0) * size).astype(np.int32).tobytes(), *means)
    return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(out, MOVED.types)], schema=MOVED)


def fit(train: DataFrame, stage: Stage, model: Model, classes: dict[int, int], epochs: int = 5, rate: float = 0.02) -> None:
    """Trains on all rows (shard, key, y, ids). In a turn each shard starts from the same parameters, and their results are averaged."""
    net, square = begin()
    balance = np.array([0.5 * sum(classes.values()) / classes[k] for k in (0, 1)])
    for epoch in range(epochs):
        pace = rate * (1 - epoch / (epochs + 0.5))
        sent = stage.spark.sparkContext.broadcast((net, square, balance, pace))  # of fixed size, about 8 MB
        moved = stage.table(train.groupBy("shard").applyInArrow(lambda t: _shard_turn(sent, epoch, t), MOVED_SQL))
        for row in moved.groupBy("part").applyInArrow(_averaged, MOVED_SQL).toArrow().to_pylist():  # of fixed size
            for values, name in ((net, "net"), (square, "square")):
                new = np.frombuffer(row[name], np.float32)
                if row["part"] >= 0:
                    values["emb"][np.frombuffer(row["own"], np.int32)] = new.reshape(-1, EMBED)
                    continue
                for k in sorted(values):
                    if k != "emb":
                        values[k], new = new[: values[k].size].reshape(values[k].shape).copy(), new[values[k].size :]
        stage.drop_table(moved)
        sent.destroy()
    model.tables = {w: np.stack([net["emb"] @ net[f"conv{w}"][j] for j in range(w)]) for w in WIDTHS}
    model.bias, model.weight = net["bias"], net["weight"].astype(np.float64)


def calibrate(model: Model, counts: list[tuple[str, int, int, int]], share: float) -> None:
    """Platt scaling on held-back documents with class weights of the true share, then a shift that puts the best cut at OPERATING.

    ``counts`` holds (language, raw score on the grid, clean documents, toxic ones) over all held-back documents.
    """
    langs = np.array([c[0] for c in counts], object)
    grid, clean, toxic = (np.array([c[k] for c in counts], np.int64) for k in (1, 2, 3))
    of = {0: (1 - share) / max(1, clean.sum()), 1: share / max(1, toxic.sum())}

    def summed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, falling, and how many clean and toxic documents have each."""
        at, back = np.unique(-grid[rows], return_inverse=True)
        n = np.zeros((2, len(at)), np.int64)
        np.add.at(n[0], back, clean[rows])
        np.add.at(n[1], back, toxic[rows])
        return -at / GRID, n[0], n[1]

    def best_cut(rows: np.ndarray) -> float:
        """The middle of the raw scores between which the weighted F1 of the rows is best."""
        zs, n0, n1 = summed(rows)
        tp, fp = np.cumsum(of[1] * n1), np.cumsum(of[0] * n0)
        f1 = 2 * tp / (tp + fp + tp[-1] + 1e-12)
        k = np.flatnonzero(f1 >= f1.max() - 1e-9)
        i = int(k[len(k) // 2])
        return float(zs[i] if i + 1 == len(zs) else (zs[i] + zs[i + 1]) / 2)

    everything = np.arange(len(counts))
    z, n0, n1 = summed(everything)
    center = float(np.average(z, weights=n0 + n1))
    spread = float(np.sqrt(np.average((z - center) ** 2, weights=n0 + n1))) or 1.0
    x, w0, w1, a, b = (z - center) / spread, of[0] * n0, of[1] * n1, 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        d = (w0 + w1) * p - w1
        a, b = a - 2 * ((d * x).sum() + 1e-4 * a), b - 2 * d.sum()
    a = max(a, 1e-3)
    model.scale = a / spread
    model.shift = float(np.log(OPERATING / (1 - OPERATING)) - model.scale * best_cut(everything))
    for name in sorted(set(langs)):
        rows = np.flatnonzero(langs == name)
        if clean[rows].any() and toxic[rows].any():
            model.thresholds[name] = float(1 / (1 + np.exp(-(model.scale * best_cut(rows) + model.shift))))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(3)):
            hashes, first = word_hashes(buf, off)
            own = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            kept = [batch.column(k).slice(lo, hi - lo) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(first).astype(np.int64)), pa.array(own, pa.binary())], ["key", "y", "lang", "words", "hashes"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.unique(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(0)]
        words, docs = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(docs.astype(np.int64))], ["word", "docs"])


def vocabulary(hashed: DataFrame) -> np.ndarray:
    """The tag of each bucket: of the words in MIN_DOCS texts, the most frequent one that falls in it (0: none)."""
    words = hashed.select("hashes").mapInArrow(_word_counts, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    top = words.where(F.col("docs") >= MIN_DOCS).groupBy(F.shiftrightunsigned("word", 48).alias("bucket")).agg(F.max(F.struct("docs", "word")).alias("top"))
    found = top.select("top.word").toArrow().column(0).to_numpy().view(np.uint64)  # one for each bucket at most
    tags = np.zeros(BUCKETS, np.uint32)
    tags[(found >> np.uint64(48)).astype(np.int64)] = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return tags


def _placed(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        ids = [model.ids(np.frombuffer(x.as_buffer(), np.uint64)).tobytes() for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.binary())], ["key", "y", "lang", "words", "ids"])


def _raw(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        z = [model.raw(model.features(np.frombuffer(x.as_buffer(), np.int32), np.array([0, len(x.as_buffer()) // 4])))[0] for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.int64())], ["lang", "y", "z"])


def _marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs without most rows whose id isn't known, by a bit map of fixed size (8 MB); the join that follows decides, but moves fewer texts."""
    if docs.schema["id"].dataType != known.schema["id"].dataType:  # equal ids might have other hashes
        return docs
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 26))
    block, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit(32767))
    bits = known.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    own = docs.withColumns({"block": block, "bit": bit.cast("int")}).join(F.broadcast(bits), "block")
    return own.where(F.getbit(byte, F.col("bit") % 8) == 1).select(*docs.columns)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = None) -> Model:
    """A model from all labelled documents; a fifth of them, picked by a hash, only calibrate."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(prior=share)
    spark = docs.sparkSession
    stage = Stage(spark, "toxicity")
    lang = F.lit("") if lang_col is None else F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("x"), lang.alias("l"))
    pairs = _marked(own, known).hint("merge").join(known, "id").select(F.xxhash64("id", "x").alias("key"), "y", F.col("l").alias("lang"), F.col("x").cast("string").alias("x"))
    hashed = stage.table(pairs.mapInArrow(_hashed, "key long, y int, lang string, words long, hashes binary"))
    model = Model(tags=vocabulary(hashed))
    sent = spark.sparkContext.broadcast(model)
    placed = stage.table(hashed.mapInArrow(lambda it: _placed(sent, it), "key long, y int, lang string, words long, ids binary"))
    stage.drop_table(hashed)
    placed = placed.withColumn("aside", F.pmod(F.xxhash64("key", F.lit("aside")), F.lit(5)) == 0)
    found = {(r[0], r[1]): (r[2], r[3]) for r in placed.groupBy("aside", "y").agg(F.count("*"), F.sum("words")).collect()}
    if len({y for _, y in found}) < 2:
        return Model(prior=share)
    train = held = placed
    if len(found) == 4:
        train, held = placed.where(~F.col("aside")), placed.where("aside")
        found = {k: v for k, v in found.items() if not k[0]}
    classes = {y: sum(n for (_, k), (n, _) in found.items() if k == y) for y in (0, 1)}
    shards = -(-sum(n for _, n in found.values()) // SHARD_WORDS) or 1
    shard = F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).alias("shard")
    fit(train.select(shard, "key", "y", "ids"), stage, model, classes)
    fitted = spark.sparkContext.broadcast(model)
    raw = held.select("lang", "y", "ids").mapInArrow(lambda it: _raw(fitted, it), "lang string, y int, z long")
    tally = raw.groupBy("lang", "z").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")).orderBy("lang", "z")
    calibrate(model, [tuple(r.values()) for r in tally.toArrow().to_pylist()], share)  # counts on the grid, not documents
    stage.drop()
    return model


def _scores(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(1)):
            if model.weight is None:
                score = np.full(hi - lo, model.prior)
            else:
                hashes, first = word_hashes(buf, off)
                score = model.score(model.features(model.ids(hashes), first))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(score)], ["id", "lang", "score"])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """(id_col, score, predicted[, predicted_lang]) for each row of docs; predicted_lang is cut at the threshold of the row's language.

    A language without a threshold of its own has the common one. The score itself never sees the language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, about 10 MB
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    out = plain.mapInArrow(lambda it: _scores(sent, it), f"id {docs.schema[id_col].dataType.simpleString()}, lang string, score double")
    columns = [F.col("id").alias(id_col), F.col("score"), (F.col("score") >= OPERATING).cast("int").alias("predicted")]
    if lang_col is not None:
        cut = F.lit(OPERATING)
        for name, value in model.thresholds.items():  # one for each language with labels of both classes
            cut = F.when(F.col("lang") == name, value).otherwise(cut)
        columns.append((F.col("score") >= cut).cast("int").alias("predicted_lang"))
    return out.select(*columns)
