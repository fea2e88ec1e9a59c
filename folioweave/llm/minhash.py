"""Near-duplicate documents by one-permutation MinHash.

Every document's distinct k-word shingles are hashed once; the hash's top bits pick one of BINS bins and each bin
keeps its minimum. Empty bins borrow by optimal densification: a fixed universal probe sequence for each bin, the same for all documents,
is followed to the first bin that has a value. Bands of ROWS bins key the buckets. A bucket gives a star of
candidate edges, never its pairs: round one from the smallest id; round two, in buckets that still hold more than
one component, from the members of smallest and largest keyed hash (a different pair of centres in each bucket). Buckets that
are still mixed are settled exactly: dealt into parts of about PART members, each two parts are compared member by member across
components. There a parity sketch of each set comes first: two sketches differ in at most as many bits as the sets have
elements that are not in both, so it rejects no true link. Edges are confirmed on full shingle sets, so no false link is made.

Defined results: null, empty or blank text has no shingles and is linked with nothing; texts with equal shingle sets
are linked; several rows of one id are one vertex; a row with a null id is its own class (component null, kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stage, connected_components, trimmed
from .text import Words, chunks, mix, shingle_sets

BINS, ROWS = 128, 4
#: Members in a part of a mixed bucket; bits of the shortest and the longest sketch; numbers held at once in a comparison.
PART, BITS, TILE = 512, (512, 1 << 16), 1 << 21
_shift = np.uint64(64 - BINS.bit_length() + 1)
_edges = np.arange(BINS, dtype=np.uint64) << _shift
_probe = np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])
_bin = np.arange(BINS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted non-empty shingle set."""
    at = np.searchsorted(shingles, _edges)
    upto = np.append(at[1:], len(shingles))
    full = at < upto
    sig = np.zeros(BINS, np.uint64)
    sig[full] = shingles[at[full]]
    if not full.all():
        empty = np.flatnonzero(~full)
        sig[empty] = sig[_probe[empty, full[_probe[empty]].argmax(1)]]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of signatures (rows)."""
    rows = sig.reshape(len(sig), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), rows.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key.view(np.int64)


def _signatures(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, off in chunks(batch.column(1)):
            w = Words(buf, off, lower=True)
            sizes, prints, keys, has = [], [], [], []
            for s in shingle_sets(w.hashes(), w.first, k):
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                has.append(len(s) > 0)
                if len(s):
                    keys.append(signature(s))
            flat = bands(np.stack(keys)) if keys else np.zeros((0, BINS // ROWS), np.int64)
            offsets = np.concatenate(([0], np.cumsum(has))) * (BINS // ROWS)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.ravel()))],
                ["id", "n_shingles", "print", "bands"],
            )


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(1)):
            w = Words(buf, off, lower=True)
            sets = list(shingle_sets(w.hashes(), w.first, k))
            flat = np.concatenate(sets).view(np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["id", "shingles"],
            )


def sketch(shingles: np.ndarray) -> bytes:
    """Parity, for each value of the low bits, of the number of shingles that have it."""
    bits = min(max(1 << int(2 * len(shingles) - 1).bit_length(), BITS[0]), BITS[1])
    return np.packbits((np.bincount(shingles & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        flat, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        made = [sketch(flat[a:b]) for a, b in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off).astype(np.int64)), pa.array(made, pa.binary())], ["id", "size", "sketch"])


def close(size: np.ndarray, sketches: list[bytes], part: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the pairs of different components that may be linked: between two parts, or within a single one."""
    width = np.array([len(x) for x in sketches]) // 8
    found = []
    apart = part.min() != part.max()
    groups = {w: (np.flatnonzero(width == w), np.frombuffer(b"".join(x for x in sketches if len(x) == 8 * w), np.uint64).reshape(-1, w)) for w in np.unique(width)}
    for w, (a, x) in groups.items():
        # sizes of linked sets differ by less than a factor of two at 50 percent or more, and their widths by one step
        for v, (b, y) in groups.items():
            if v < w or (percent > 50 and v > 2 * w):
                continue
            while y.shape[1] > w:  # the halves' parities add up
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, TILE // (len(b) * w))
            for lo in range(0, len(a), step):
                own = a[lo : lo + step]
                both = size[own, None] + size[b]
                fit = (component[own, None] != component[b]) & (100 * np.minimum(size[own, None], size[b]) >= percent * np.maximum(size[own, None], size[b]))
                fit &= part[own, None] != part[b] if apart else np.ones(1, bool)
                if v == w:
                    fit &= own[:, None] < b
                i, j = np.nonzero(fit)
                for at in range(0, len(i), max(1, TILE // w)):
                    p, q = i[at : at + TILE // w], j[at : at + TILE // w]
                    differ = np.bitwise_count(x[lo + p] ^ y[q]).sum(1, dtype=np.int64)
                    ok = differ * (100 + percent) <= both[p, q] * (100 - percent)
                    found.append((own[p[ok]], b[q[ok]]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _settled(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each group of rows with equal key, i and j; rows come in that order."""

    def compared(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        ids, part, component, size = (t.column(c).to_numpy() for c in ("id", "p", "k", "size"))
        # both parts of a group may be empty but for one
        whole = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        none = not whole and part.min() == part.max()
        a, b = close(size, t.column("sketch").to_pylist(), part, component, percent) if not none else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["c", "m"])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
        starts = np.flatnonzero(np.any(now[:, 1:] != now[:, :-1], 0)) + 1
        for lo, hi in zip([0, *starts], [*starts, batch.num_rows]):
            if held and tuple(now[:, lo]) != last:
                yield compared(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(now[:, lo])
    if held:
        yield compared(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs; links need 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = stage.table(texts.mapInArrow(lambda it: trimmed(_signatures(k, it)), "id long, n_shingles long, print binary, bands array<long>"))
    some = every.where("n_shingles > 0 and id is not null")
    classes = stage.table(some.groupBy("print").agg(F.min("id").alias("id"), F.min("n_shingles").alias("size")))
    one = some.join(classes.select("print", "id"), ["print", "id"], "left_semi")
    keyed = one.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    centres = keyed.groupBy("key").agg(F.min(F.struct("id", "size")).alias("c"), F.max("id").alias("z"), F.count("*").alias("n")).where("c.id <> z")
    # each table of keys is written before it is joined: beside its aggregate in one stage a hot key could not be split
    centres = stage.table(centres.select("key", F.col("c.id").alias("c"), F.col("c.size").alias("cs"), "n"))
    member = stage.table(keyed.join(centres.hint("merge"), "key"))
    # sizes alone settle most false candidates, before any set is fetched
    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # round one: stars from the smallest id of each bucket
    first = stage.table(member.where("id <> c").where(fits(F.col("size"), F.col("cs"))).select("c", F.col("id").alias("m")).distinct())
    # always a merge join: the ids grow with the documents, so a broadcast that holds at one size fails at the next
    wanted = member.select("id").distinct()
    sets = stage.table(texts.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(lambda it: trimmed(_sets(k, it)), "id long, shingles array<long>"))

    def confirmed(edges: DataFrame) -> DataFrame:
        m = edges.join(sets.select(F.col("id").alias("m"), F.col("shingles").alias("sm")).hint("merge"), "m")
        both = m.join(sets.select(F.col("id").alias("c"), F.col("shingles").alias("sc")).hint("merge"), "c")
        both = both.where(fits(F.size("sm"), F.size("sc"))).select("c", "m", (F.size("sm") + F.size("sc")).cast("long").alias("both"), F.size(F.array_intersect("sm", "sc")).cast("long").alias("x"))
        return both.where(F.col("x") * 100 >= (F.col("both") - F.col("x")) * percent).select(F.col("c").alias("a"), F.col("m").alias("b"))

    # an id whose rows have several sets is one vertex: it is tied to the representative of each
    several = every.where("id is not null").groupBy("id").agg(F.min("print").alias("p0"), F.max("print").alias("p1")).where("p0 <> p1").select("id")
    ties = some.join(several.hint("merge"), "id", "left_semi").join(classes.select("print", F.col("id").alias("rep")), "print")
    ties = stage.table(ties.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    links = stage.table(confirmed(first).union(ties.where("a <> b")))
    joined = stage.table(connected_components(links, stage))

    def mixed_members() -> DataFrame:
        """Members of the buckets of three or more that still hold several components."""
        of = stage.table(member.where("n > 2").join(joined.hint("merge"), "id", "left").select("key", "id", "size", "c", F.coalesce("component_id", "id").alias("k")))
        mixed = of.groupBy("key").agg(
            F.min("k").alias("k0"), F.max("k").alias("k1"), F.count("*").alias("n"),
            F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "k", "size")).alias("lo"),
            F.max(F.struct(F.xxhash64("id", "key").alias("h"), "id", "k", "size")).alias("hi"),
        ).where("k0 <> k1")
        return of.join(stage.table(mixed.select("key", "n", "lo", "hi")).hint("merge"), "key")

    # round two: from the members of smallest and largest keyed hash
    second = mixed_members().withColumn("o", F.explode(F.array("lo", "hi"))).where("id <> o.id and k <> o.k and o.id <> c and id <> c")
    second = second.where(fits(F.col("size"), F.col("o.size"))).select(F.greatest("id", "o.id").alias("m"), F.least("id", "o.id").alias("c")).distinct()
    second = stage.table(second.join(first.hint("merge"), ["c", "m"], "left_anti"))
    links = stage.table(links.union(confirmed(second)))
    joined = stage.table(connected_components(links, stage))

    # buckets that are mixed even now: all pairs of different components, part by part
    rest = mixed_members().select("key", "id", "k", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rest = stage.table(rest)
    marks = sets.join(rest.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(_sketches, "id long, size long, sketch binary")
    rest = rest.join(stage.table(marks).hint("merge"), "id").withColumn("p", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    rest = rest.select("key", "id", "k", "size", "sketch", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    rest = rest.select("key", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "id", "k", "size", "sketch")
    third = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: trimmed(_settled(percent, it)), "c long, m long")
    third = stage.table(third.distinct().join(first.union(second.select("c", "m")), ["c", "m"], "left_anti"))
    more_links = stage.table(confirmed(third))
    if not more_links.isEmpty():
        joined = stage.table(connected_components(joined.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more_links), stage))

    of_class = classes.select("print", F.col("id").alias("rep")).join(joined.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    of_class = of_class.select(F.col("print").alias("v"), F.coalesce("component_id", "rep").alias("component_id"))
    # a row without shingles goes with the other rows of its id, which is in no class
    blank = every.where("n_shingles = 0").select("id").distinct().join(joined.hint("merge"), "id").select(F.col("id").cast("string").cast("binary").alias("v"), "component_id")
    out = every.select("id", "n_shingles", F.when(F.col("id").isNull(), None).when(F.col("n_shingles") > 0, F.col("print")).otherwise(F.col("id").cast("string").cast("binary")).alias("v"))
    out = out.join(stage.table(of_class.union(blank)).hint("merge"), "v", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
