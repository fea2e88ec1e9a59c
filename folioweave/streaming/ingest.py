"""Structured Streaming over a Markdown folder: each micro-batch parses new or changed files and is merged into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sections import parse


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends (path, sha256, sections, problems, version) rows below ``target``; ``current`` gives each path's latest."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("version"))
        rows = parse(own).join(own.select("path", "version", F.sha2("content", 256).alias("sha256")), "path")
        # a batch that runs again overwrites its own folder
        rows.select("path", "sha256", "sections", "problems", "version").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(path, sha256, sections, problems) of each path's latest version."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy("path").agg(F.max_by(F.struct("sha256", "sections", "problems"), F.struct("version", "batch")).alias("x"))
    return latest.select("path", "x.*")
