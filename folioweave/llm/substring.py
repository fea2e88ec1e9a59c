"""Removal of long passages that an earlier document has already.

A window is ``width`` consecutive words. Every word covered by a window whose word sequence also starts in a
document with a smaller id is removed; windows are judged on the input.

Windows are grouped into segments: the longest runs of windows that share their anchor, the smallest hash among the
GRAM-word runs inside (a minimiser). Equal windows have equal anchors, so only anchors in two documents or more
matter, and rows shrink to one for about twenty words. A segment whose whole content also stands in an earlier document is settled
at once. What is left (segments at the edges of a passage or around a changed word) is dealt by anchor into shards of about
SHARD segments. Each shard has a compressed FM-index: backward search over its wavelet tree gives the matching statistics of
the segments streamed through it, and runs of windows whose match reaches the width and has a smaller document in its interval are
reported. An anchor with more than HOT segments left would make a shard without bound; its windows are compared one by one by their
hashes instead, with the same result. All other grouping is by minimum with map-side combine and by equi-joins that AQE can
split: a passage in a third of all documents is no hot task.

Defined results: null, empty or blank text and text shorter than a window lose nothing; a passage repeated inside one
document only stays; rows that share an id are one document for the comparison; rows with a null id are neither
sources nor cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import Stage
from .text import Words, chunks, mix, powers, runs_of

GRAM, SHARD, HOT = 10, 1024, 4096
#: Bytes of a word's hash that travel to the shards.
WIDE = 6


def prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Sums from which any run of words is hashed in constant time."""
    p, _ = powers(len(words) + 1)
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(1)) * p[: len(words)], out=out[1:])
    return out


def hash_of_runs(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all GRAM-word runs, for each word that has a whole window after it the number of the run that anchors it)."""
    gram = min(GRAM, width)
    g = runs_of(words, gram)
    span, n = width - gram + 1, len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    key = (mix(g) >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    rows = -(-len(key) // span) + 1
    pad = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    block = pad.reshape(rows, span)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(right[:n], left[span - 1 : span - 1 + n])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return g, at


def segments(words: np.ndarray, first: np.ndarray, width: int):
    """(text, first window, windows, anchor, content hash) of each segment of the texts."""
    grams, at = anchors(words, width)
    n = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    upto = np.concatenate(([0], np.cumsum(n)))
    window = np.arange(upto[-1]) + np.repeat(first[:-1] - upto[:-1], n)  # first word of each window
    a = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    count = np.diff(np.append(lo, len(window)))
    start = window[lo]
    content = hash_of_runs(prefix_hashes(words), start, start + count + width - 1)
    # a segment is known by its content and by where its anchor lies in it
    content = mix(content + mix((a[lo] - start).astype(np.uint64)))
    return text[lo], start - first[text[lo]], count, grams[a[lo]], content


def _segments(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(1)):
            w = Words(buf, off)
            text, at, n, anchor, content = segments(w.hashes(), w.first, width)
            ids, marks = (batch.column(c).slice(lo, hi - lo).take(pa.array(text)) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], ["id", "mark", "at", "n", "anchor", "segment"])


def _spread(lists: pa.Array, field: str) -> np.ndarray:
    return lists.flatten().field(field).to_numpy()


def _left_over(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each listed segment, or, where its anchor is hot, the hash of each window."""
    for batch in batches:
        asked = batch.column(3)
        for lo, hi, buf, off in chunks(batch.column(1)):
            w = Words(buf, off)
            words = w.hashes()
            mine = asked.slice(lo, hi - lo)
            of = np.repeat(np.arange(hi - lo), np.asarray(mine.value_lengths()))
            at, n = _spread(mine, "at").astype(np.int64), _spread(mine, "n").astype(np.int64)
            anchor, hot = _spread(mine, "anchor"), np.asarray(mine.flatten().field("hot").to_numpy(zero_copy_only=False), bool)
            start = w.first[of] + at
            raw = words.view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()
            cold = np.flatnonzero(~hot)
            texts = [raw[a * WIDE : b * WIDE] for a, b in zip(start[cold].tolist(), (start[cold] + n[cold] + width - 1).tolist())]
            # hot ones window by window
            of_hot, n_hot = of[hot], n[hot]
            upto = np.concatenate(([0], np.cumsum(n_hot)))
            step = np.arange(upto[-1]) - np.repeat(upto[:-1], n_hot)
            first = np.repeat(start[hot], n_hot) + step
            window = hash_of_runs(prefix_hashes(words), first, first + width) if len(first) else np.zeros(0, np.uint64)
            row = np.concatenate((of[cold], np.repeat(of_hot, n_hot)))
            ids, marks = (batch.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in (0, 2))
            blank = len(first)
            yield pa.RecordBatch.from_arrays(
                [ids, marks, pa.array(np.concatenate((at[cold], np.repeat(at[hot], n_hot) + step)).astype(np.int32)),
                 pa.concat_arrays([pa.array(anchor[cold], pa.int64()), pa.nulls(blank, pa.int64())]),
                 pa.concat_arrays([pa.array(texts, pa.binary()), pa.nulls(blank, pa.binary())]),
                 pa.concat_arrays([pa.nulls(len(cold), pa.int64()), pa.array(window.view(np.int64))])],
                ["id", "mark", "at", "anchor", "words", "window"],
            )


def search_shard(width: int, group: pa.Table) -> pa.Table:
    """(id, mark, at, n): the runs of windows of the shard's segments that start in a document of smaller id too."""
    group = group.combine_chunks()
    words = group.column("words").combine_chunks()
    size = np.asarray(pc.binary_length(words)).astype(np.int64) // WIDE
    raw = np.frombuffer(b"".join(words.to_pylist()), np.uint8).reshape(-1, WIDE)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :WIDE] = raw
    # symbol 0 parts the segments
    _, symbol = np.unique(full.view(np.uint64).ravel(), return_inverse=True)
    end = np.cumsum(size + 1) - 1
    text = np.zeros(int((size + 1).sum()), np.int64)
    place = np.ones(len(text), bool)
    place[end] = False
    text[place] = symbol + 1
    ids = group.column("id").to_numpy()
    segment = np.repeat(np.arange(len(size)), size + 1)
    index = FMIndex(text, ids[segment], width)
    first = end - size
    n = size - width + 1
    upto = np.concatenate(([0], np.cumsum(n)))
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(upto[-1]) - upto[of]
    length, lo, hi = index.matching(text, first[of] + step + width, width)
    rows = np.flatnonzero(length == width)
    rows = rows[index.smallest_owner(lo[rows], hi[rows]) < ids[of[rows]]]
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(rows) != 1) | (of[rows[1:]] != of[rows[:-1]])
    head = np.flatnonzero(new)
    runs = np.diff(np.append(head, len(rows)))
    at = group.column("at").to_numpy()[of[rows[head]]] + step[rows[head]]
    pick = pa.array(of[rows[head]])
    return pa.table({"id": group.column("id").take(pick), "mark": group.column("mark").take(pick), "at": pa.array(at.astype(np.int32)), "n": pa.array(runs.astype(np.int32))})


def cut_words(w: Words, of: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Whether each word is kept when the runs of n windows from ``at`` on in text ``of`` go."""
    change = np.zeros(len(w.start) + 1, np.int64)
    start = w.first[of] + at
    np.add.at(change, start, 1)
    np.add.at(change, start + n + width - 1, -1)
    return np.cumsum(change[:-1]) == 0


def kept_text(w: Words, keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the kept words of each text, joined by one space."""
    n = len(w.buf)
    inside = np.zeros(n + 1, np.int8)
    inside[w.start[keep]] += 1
    np.subtract.at(inside, w.end[keep], 1)
    mask = np.cumsum(inside[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(keep)
    text = w.text_of_words()[kept]
    gap = w.end[kept[:-1][text[1:] == text[:-1]]]  # another kept word follows in the same text, so this byte is white space
    out = w.buf.copy()
    out[gap] = 0x20
    mask[gap] = True
    upto = np.concatenate(([0], np.cumsum(mask)))
    return out[mask], upto[off]


def _cut(width: int, give_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(3)
        for lo, hi, buf, off in chunks(batch.column(1)):
            w = Words(buf, off)
            mine = gone.slice(lo, hi - lo)
            sizes = np.nan_to_num(np.asarray(mine.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            of = np.repeat(np.arange(hi - lo), sizes)
            keep = cut_words(w, of, _spread(mine, "at").astype(np.int64), _spread(mine, "n").astype(np.int64), width)
            data, at = kept_text(w, keep, off)
            words = np.diff(w.first)
            removed = words - np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
            raw = data.tobytes()
            parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if give_text:
                columns.append(pa.array([p.decode() for p in parts], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark); the mark tells rows of one id with other texts apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("mark", F.xxhash64("text"))


def repeated_windows(texts: DataFrame, stage: Stage, width: int, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(id, mark, gone: array<struct<at, n>>): for each text with repeated windows, runs of n of them from window ``at`` on."""
    texts = texts.where("id is not null and text is not null")
    rows = stage.table(texts.mapInArrow(lambda it: _segments(width, it), "id long, mark long, at int, n int, anchor long, segment long"))
    shared = rows.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("segment").alias("s0"), F.max("segment").alias("s1"))
    shared = shared.where("first < last").select("anchor", (F.col("s0") != F.col("s1")).alias("differ"))
    # joined as a table of its own: beside an aggregate in the same stage a hot anchor could not be split
    rows = stage.table(rows.join(stage.table(shared).hint("merge"), "anchor"))
    earliest = stage.table(rows.groupBy("segment").agg(F.min("id").alias("earliest")))
    rows = stage.table(rows.join(earliest.hint("merge"), "segment").select("id", "mark", "at", "n", "anchor", "differ", "earliest"))
    whole = rows.where("earliest < id").select("id", "mark", "at", "n")
    left = rows.where("differ and earliest = id").select("id", "mark", "at", "n", "anchor")
    sizes = stage.table(left.groupBy("anchor").agg((F.count("*") > hot).alias("hot"), F.count("*").alias("size")))
    segments_left = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    asked = left.join(sizes.select("anchor", "hot").hint("merge"), "anchor").groupBy("id", "mark").agg(F.collect_set(F.struct("at", "n", "anchor", "hot")).alias("asked"))
    # always a merge join: what is asked for grows with the documents
    found = texts.join(asked.hint("merge"), ["id", "mark"]).select("id", "text", "mark", "asked")
    found = stage.table(found.mapInArrow(lambda it: _left_over(width, it), "id long, mark long, at int, anchor long, words binary, window long"))
    windows = found.where("window is not null")
    before = windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    single = windows.join(stage.table(before).hint("merge"), "window").where("first < id").select("id", "mark", "at", F.lit(1).alias("n"))
    shards = max(1, -(-segments_left // shard))
    dealt = found.where("words is not null").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    matched = dealt.select("shard", "id", "mark", "at", "words").groupBy("shard").applyInArrow(lambda t: search_shard(width, t), "id long, mark long, at int, n int")
    return stage.table(whole.union(single).union(matched).groupBy("id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("gone")))


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", give_text: bool = True, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept_text]) for each row of docs."""
    texts = _texts(docs, id_col, text_col)
    gone = repeated_windows(texts, Stage(docs.sparkSession, "substring"), width, shard, hot)
    shape = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if give_text else "")
    out = texts.join(gone.hint("merge"), ["id", "mark"], "left").select("id", "text", "mark", "gone")
    return out.mapInArrow(lambda it: _cut(width, give_text, it), shape).withColumnRenamed("id", id_col)
