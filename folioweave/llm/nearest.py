"""Exact nearest neighbours by largest inner product: a block matrix join of quantised tiles.

Vectors are cut into blocks. A pair of blocks (queries x candidates) is one task: both sides are quantised to int8
with one scale a row, the tile of integer products gives every inner product within a rigorous error bound, and
only candidates whose upper bound reaches the k-th best lower bound are recomputed in float64. A bounded heap for each query
merges the tiles of a task; the heaps of all tasks are merged at the end.

Defined results: vectors that are null, empty, zero, or with null or non-finite components take no part, rows with a null
id neither; a query meets vectors of its own length only. Ties go to the smaller id. Of several rows with one id
each is a candidate of its own and, if it asks, has a ranking of its own, but a query never meets rows of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stage

#: Rows of a block at most, of a tile, and pairs whose vectors are gathered at once.
BLOCK, TILE, PAIRS = 8192, 1024, 1 << 15


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the usable vectors of a list column, all of length ``dim`` (or the first usable one's)."""
    column = column.cast(pa.large_list(pa.float64()))
    size = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.zeros(0, np.int64)
    valid = np.asarray(column.is_valid()) & (size > 0) if len(column) else np.zeros(0, bool)
    rows, parts = np.flatnonzero(valid), []
    flat = column.filter(pa.array(valid)).flatten().to_numpy(zero_copy_only=False)  # a null component reads as NaN
    at = np.concatenate(([0], np.cumsum(size[rows])))
    if dim is None and len(rows):
        dim = int(size[rows[0]])
    fit = size[rows] == dim
    if fit.all() and len(rows):
        m = flat.reshape(len(rows), dim)
    else:
        parts = [flat[a:b] for a, b, ok in zip(at[:-1], at[1:], fit) if ok]
        rows, m = rows[fit], np.array(parts).reshape(len(parts), dim or 0)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    return rows[good], m[good]


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms, norms of the quantisation error)."""
    scale = np.abs(m).max(1) / 127
    scale[scale == 0] = 1  # subnormal vectors
    codes = np.rint(m / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt((m * m).sum(1)), np.sqrt(((m - codes * scale[:, None]) ** 2).sum(1))


def tile_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows. float32 holds each sum exactly up to 1040 dimensions; beyond, float64."""
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    return q.astype(kind) @ c.astype(kind).T


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that a score does not depend on how numpy blocks the sum."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_of(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best candidates, found through quantised tiles."""
    heap_id = np.full((len(q), k), np.iinfo(np.int64).max)
    heap = np.full((len(q), k), -np.inf)
    qc, qs, qn, qe = quantised(q)
    for lo in range(0, len(c), TILE):
        part, ids = c[lo : lo + TILE], cid[lo : lo + TILE]
        cc, cs, cn, ce = quantised(part)
        approx = tile_products(qc, cc) * qs[:, None] * cs
        # |q.c - approx| <= |e_q||c| + |q - e_q||e_c|; the factor covers rounding
        bound = (qe[:, None] * cn + (qn + qe)[:, None] * ce) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn
        own = qid[:, None] == ids
        low = np.where(own, -np.inf, approx - bound)
        floor = heap[:, -1]
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(low, len(ids) - k, 1)[:, len(ids) - k])
        row, col = np.nonzero((approx + bound >= floor[:, None]) & ~own)
        score = np.concatenate([np.zeros(0), *(inner_products(q[row[x : x + PAIRS]], part[col[x : x + PAIRS]]) for x in range(0, len(row), PAIRS))])
        rows = np.concatenate((np.repeat(np.arange(len(q)), k), row))
        scores = np.concatenate((heap.ravel(), score))
        all_ids = np.concatenate((heap_id.ravel(), ids[col]))
        order = np.lexsort((all_ids, -scores, rows))
        first = np.searchsorted(rows[order], np.arange(len(q)))
        take = order[first[:, None] + np.arange(k)]
        heap, heap_id = scores[take], all_ids[take]
    row, rank = np.nonzero(heap > -np.inf)
    return row, heap_id[row, rank], heap[row, rank]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All usable rows of a block as one row: the ids and the matrix."""
    for batch in batches:
        rows, m = matrix(batch.column("embedding"))
        for lo in range(0, len(rows), BLOCK):
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows[lo : lo + BLOCK]].astype(np.int64)
            part = m[lo : lo + BLOCK]
            narrow = part.astype(np.float32)
            exact = bool((narrow == part).all())  # float32 input travels as float32
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.tobytes()]), pa.array([(narrow if exact else part).tobytes()]), pa.array([part.shape[1]], pa.int32())], ["ids", "matrix", "dim"]
            )


def _as_table(group: pa.Table) -> pa.Table:
    shape = pa.schema([("ids", pa.binary()), ("matrix", pa.binary()), ("dim", pa.int32())])
    return pa.Table.from_batches(_blocks(group.combine_chunks().to_batches()), shape)


def _unpack(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(m) == 4 * dim * len(own) else np.float64
    return own, np.frombuffer(m, kind).reshape(len(own), dim).astype(np.float64)


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in range(batch.num_rows):
            r = {name: batch.column(name)[x].as_py() for name in batch.schema.names}
            if r["dim"] != r["q_dim"]:
                continue
            qid, q = _unpack(r["q_ids"], r["q_matrix"], r["q_dim"])
            cid, c = _unpack(r["ids"], r["matrix"], r["dim"])
            for lo in range(0, len(q), TILE):  # bounds the tile's memory
                own = qid[lo : lo + TILE]
                row, near, score = best_of(own, q[lo : lo + TILE], cid, c, k)
                at = pa.array(np.full(len(row), r["at"]))
                yield pa.RecordBatch.from_arrays([at, pa.array(lo + row), pa.array(own[row]), pa.array(near), pa.array(score)], ["at", "row", "query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (a Column over the table), its k nearest other rows.

    The query set meets all rows block by block: a candidate block is sent once for each query block.
    """
    stage = Stage(vectors.sparkSession, "nearest")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("q"))
    counted = rows.agg(F.count("*"), F.count_if("q")).first()
    # blocks small enough that their pairs keep all cores busy
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    block = int(min(BLOCK, max(TILE, -(-counted[0] // (2 * cores)))))
    n_blocks, n_query = max(1, -(-counted[0] // block)), max(1, -(-counted[1] // block))
    shape = "ids binary, matrix binary, dim int"

    def blocks(of: DataFrame, n: int) -> DataFrame:
        dealt = of.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        return stage.table(dealt.groupBy("block", F.size("embedding")).applyInArrow(_as_table, shape)).withColumn("no", F.monotonically_increasing_id())

    asked, every = stage.table(blocks(rows.where("q"), n_query)), stage.table(blocks(rows, n_blocks))
    asked = asked.select(F.col("no").alias("at"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "matrix", "dim")))
    # block numbers only, one for each block of rows
    at, no = (F.lit([r[0] for r in t.collect()] or [-1]) for t in (asked.select("at"), every.select("no")))
    # each pair of blocks has a key of its own, so the pairs are dealt to all tasks
    pairs = every.withColumn("at", F.explode(at)).join(asked.withColumn("no", F.explode(no)).hint("shuffle_hash"), ["no", "at"])
    found = pairs.mapInArrow(lambda it: _search(k, it), "at long, row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id", "at", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
