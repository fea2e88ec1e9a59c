"""Staging of intermediate tables and distributed connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def trimmed(batches: Iterator) -> Iterator:
    """The batches; after the last one the worker gives memory back that it no longer needs, since it stays alive beside later stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables, visible to all executors.

    It is the one named by ``spark.checkpoint.dir``. Only a single-JVM session (``local[...]``)
    without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="folioweave-")
    return _local_roots[app]


#: Where Spark has this setting, a write's shuffle files go as soon as the table is written: nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Tables of one operator run, written as Parquet so that a lost executor costs no lineage.

    They are deleted when the session's JVM ends, or before by ``drop`` and ``drop_table``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)

    def table(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        """df, written and read again; ``by``: columns by whose values the files are parted."""
        self._n += 1
        at = f"{self.path}/{self._n:03d}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(at, partitionBy=by, compression="snappy")
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_table(self, table: DataFrame) -> None:
        """Delete the files of a table of this run that nothing reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            self._delete(path)

    def drop(self) -> None:
        """Delete all tables of this run (results read from them become unusable)."""
        self._delete(self.path)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return int(row[0]), int(row[1] or 0)


def connected_components(edges: DataFrame, stage: Stage, max_rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` longs -> ``(id, component_id)`` for each endpoint; component_id is the smallest id reachable.

    Alternating large-star / small-star contraction. Each round is two minimum aggregations (with map-side
    combine) and two equi-joins whose skewed keys AQE can split, so a hub vertex never has to be
    gathered in one task. Self loops and null endpoints are dropped; an empty input gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stage.table(e.where("a <> b").distinct())
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, stage.table(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        stage.drop_table(last)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)
