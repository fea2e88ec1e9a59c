"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Several orthogonal rotations are learnt (ITQ, each from another random start) on a bounded sample, so that the signs of
the rotated unit vectors are balanced binary codes. Each code is cut into substrings; a substring is one hash
table, and two vectors meet where any substring is equal. The number of tables follows from the threshold: the chance
that a pair at exactly the threshold meets in none is at most MISS. Pairs that meet are reranked by cosine in double
precision, so no false link is made. The tables first hold ids and one packed code only: a vector with no other one of its
bucket within the Hamming radius RADIUS ends there, and vectors travel to the buckets of the rest. A pair is counted only in the first table in which it meets (both codes are at
hand there), so links are counted without ever being written as pairs; a bucket emits one row for each
linked vector: its links there and the smallest id of its connected part of the bucket.

Defined results: null, zero or empty vectors, and those with null or non-finite components, link with nothing; equal
vectors are one class whose links are counted by multiplicity; a row with a null id is left unlinked (component null,
kept). Vectors of different lengths never link. Of several rows with one id each counts as a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest import matrix
from .shared import Stage, connected_components

SAMPLE, MISS, BUCKET, CODE_BITS = 20_000, 0.0015, 1024, 64
#: Chance that a pair at the threshold is further apart than the Hamming radius.
FAR = 0.0005


def radius_for(threshold: float, bits: int) -> int:
    """The distance of two codes of so many bits that a pair at the threshold exceeds with a chance of FAR at most."""
    p = math.acos(threshold) / math.pi
    left, r = 1.0, -1
    while left > FAR:
        r += 1
        left -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def learn_rotations(sample: np.ndarray, count: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """(count, dim, bits) projections: principal directions, then a rotation that minimises the quantisation error."""
    dim = sample.shape[1]
    bits = min(CODE_BITS, dim)
    values, vectors = np.linalg.eigh(sample.T @ sample)
    main = vectors[:, np.argsort(values)[::-1][:bits]]
    v, out = sample @ main, []
    for i in range(count):
        r, _ = np.linalg.qr(np.random.default_rng(seed + i).normal(size=(bits, bits)))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ wt).T
        out.append(main @ r)
    return np.stack(out)


def tables_for(threshold: float, key_bits: int) -> int:
    """Tables of key_bits bits after which a pair at the threshold is missed with a chance of MISS at most."""
    same = (1 - math.acos(threshold) / math.pi) ** key_bits
    return math.ceil(math.log(MISS) / math.log(1 - same))


def table_keys(m: np.ndarray, rotations: np.ndarray, key_bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys of unit vectors."""
    per_code = rotations.shape[2] // key_bits
    weight = 1 << np.arange(key_bits)
    out = []
    for r in rotations:
        bits = (m @ r[:, : per_code * key_bits] > 0).reshape(len(m), per_code, key_bits)
        out.append(bits @ weight)
    return np.concatenate(out, 1)[:, :tables].astype(np.int32)


def packed(projected: np.ndarray) -> np.ndarray:
    """The signs of up to 64 columns as one number."""
    bits = np.zeros((len(projected), 64), np.uint8)
    bits[:, : projected.shape[1]] = projected > 0
    return np.packbits(bits, 1).view(np.int64).ravel()


def _rows(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rotations, key_bits, tables = model
    for batch in batches:
        rows, m = matrix(batch.column("embedding"), rotations.shape[1])
        unit = m / np.sqrt((m * m).sum(1))[:, None]
        keys = table_keys(unit, rotations, key_bits, tables)
        pick = pa.array(rows)
        with np.errstate(over="ignore"):
            narrow = m.astype(np.float32)
        exact = (narrow == m).all(1)  # float32 input travels as float32
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pick), batch.column("n").take(pick),
             pa.array([(f if e else x).tobytes() for f, x, e in zip(narrow, m, exact)], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(keys.ravel())), pa.array(packed(unit @ rotations[0]))],
            ["id", "n", "vector", "codes", "keys", "code"],
        )


def _link_bucket(table: int, threshold: float, ids, n, m, keys, left: np.ndarray | None):
    """Links of one bucket, or of one pair of its parts (``left`` marks the first part). -> (ids, link counts, smallest id of each part)"""
    norm = np.sqrt((m * m).sum(1))
    unit = m / norm[:, None]
    linked = unit @ unit.T >= threshold - 1e-9
    np.fill_diagonal(linked, False)
    if left is not None:
        linked &= left[:, None] != left
    a, b = np.nonzero(np.triu(linked))
    exact = (np.einsum("ij,ij->i", m[a], m[b]) / (norm[a] * norm[b])) >= threshold
    exact &= ~(keys[a, :table] == keys[b, :table]).any(1)
    a, b = a[exact], b[exact]
    count = np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))
    root = ids.copy()
    while True:  # smallest id of the connected part
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    has = count > 0
    return ids[has], count[has].astype(np.int64), root[has]


TILE_KEYS = ["t", "key", "i", "j"]


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, bounds of the tiles in them): rows come sorted by tile, and a tile may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(c)[-1].as_py() for c in TILE_KEYS]
        if len(held) > 1 and last == [held[0].column(c)[0].as_py() for c in TILE_KEYS]:
            continue  # still one tile
        t = pa.Table.from_batches(held).combine_chunks()
        # keep the last tile, which may go on
        same = np.ones(t.num_rows, bool)
        for c, v in zip(TILE_KEYS, last):
            same &= t.column(c).to_numpy() == v
        cut = int(np.argmax(same))
        if cut:
            yield bounded(t.slice(0, cut))
        held = t.slice(cut).to_batches()
    if held:
        yield bounded(pa.Table.from_batches(held).combine_chunks())


def bounded(t: pa.Table) -> tuple[pa.Table, list[int]]:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for c in TILE_KEYS:
        x = t.column(c).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return t, np.append(np.flatnonzero(change), t.num_rows).tolist()


def _candidates(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, key, id) of the rows that have another row of their tile within the radius."""
    for t, at in tiles(batches):
        code, part, i, j = (t.column(c).to_numpy() for c in ("code", "part", "i", "j"))
        near = np.zeros(t.num_rows, bool)
        for lo, hi in zip(at[:-1], at[1:]):
            own = code[lo:hi].view(np.uint64)
            left = np.flatnonzero(part[lo:hi] == i[lo])
            right = np.flatnonzero(part[lo:hi] == j[lo])
            for a in range(0, len(left), 512):
                rows = left[a : a + 512]
                close = np.bitwise_count(own[rows, None] ^ own[right]) <= radius
                close &= rows[:, None] != right
                near[lo + rows] |= close.any(1)
                near[lo + right] |= close.any(0)
        pick = pa.array(np.flatnonzero(near))
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pick) for c in ("t", "key", "id")], ["t", "key", "id"])


def _buckets(threshold: float, dim: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in tiles(batches):
        num = {c: t.column(c).to_numpy() for c in ("t", "i", "j", "part", "id", "n")}
        raw = t.column("vector").to_pylist()
        vec = np.array([np.frombuffer(x, np.float64 if len(x) == 8 * dim else np.float32) for x in raw], np.float64)
        keys = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(t.num_rows, -1)
        got = []
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo > 1:
                left = num["part"][lo:hi] == num["i"][lo] if num["i"][lo] != num["j"][lo] else None
                got.append(_link_bucket(int(num["t"][lo]), threshold, num["id"][lo:hi], num["n"][lo:hi], vec[lo:hi], keys[lo:hi], left))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], ["id", "links", "root"])


def dealt(keyed: DataFrame, stage: Stage) -> DataFrame:
    """Rows with a column t and key, dealt into tiles: a bucket of over BUCKET rows is cut into parts, and each pair of parts is a tile."""
    sizes = stage.table(keyed.groupBy("t", "key").count().where("count > 1").select("t", "key", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts")))
    out = keyed.join(sizes.hint("merge"), ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    stage = Stage(spark, "itq")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = stage.table(v.withColumn("class", F.when(F.coalesce(usable, F.lit(False)) & F.col("id").isNotNull(), F.sha2(F.concat_ws(" ", e.cast("array<string>")), 256))))
    classes = v.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    one = v.where("class is not null").dropDuplicates(["class"]).select("class", "embedding")
    classes = stage.table(classes.join(one, "class"))
    lengths = [r for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()]
    found = None
    for dim, total in lengths:  # one model for each vector length
        own = classes.where(F.size("embedding") == dim)
        every = max(1, total // SAMPLE)
        fit = own.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("embedding").limit(2 * SAMPLE).toArrow()
        _, sample = matrix(fit.column("embedding").combine_chunks() if fit.num_rows else pa.array([], pa.list_(pa.float64())), dim)
        if not len(sample):
            _, sample = matrix(own.select("embedding").limit(SAMPLE).toArrow().column("embedding").combine_chunks(), dim)
        sample = sample / np.sqrt((sample * sample).sum(1))[:, None]
        key_bits = int(min(dim, CODE_BITS, max(8, round(math.log2(max(2, total))) - 3)))
        tables = tables_for(threshold, key_bits)
        per_code = min(CODE_BITS, dim) // key_bits
        model = (learn_rotations(sample, -(-tables // per_code)), key_bits, tables)
        rows = own.select("id", "n", "embedding").mapInArrow(lambda it, m=model: _rows(m, it), "id long, n long, vector binary, codes binary, keys array<int>, code long")
        rows = stage.table(rows)
        narrow = dealt(rows.select("id", "code", F.posexplode("keys").alias("t", "key")), stage)
        radius = radius_for(threshold, min(CODE_BITS, dim))
        narrow = narrow.repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS).select(*TILE_KEYS, "part", "id", "code")
        active = stage.table(narrow.mapInArrow(lambda it, r=radius: _candidates(r, it), "t int, key int, id long").distinct())
        wide = dealt(active, stage).join(rows.select("id", "n", "vector", "codes").hint("merge"), "id")
        wide = wide.select(*TILE_KEYS, "part", "id", "n", "vector", "codes").repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS)
        some = stage.table(wide.mapInArrow(lambda it, d=dim: _buckets(threshold, d, it), "id long, links long, root long"))
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    joined = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), stage)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("class", "id", "n").join(links, "id", "left").join(joined, "id", "left")
    known = known.select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = v.select("id", "class").join(known, "class", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
