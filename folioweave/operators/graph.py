"""The section graph: sections (nodes), directives, and edges between them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import kept
from .sections import parse


class ParseFailed(ValueError):
    pass


@dataclass(frozen=True)
class Graph:
    sections: DataFrame  # uri is unique
    directives: DataFrame  # src_uri, file_path, ord, type, target_uri, label
    problems: DataFrame  # path, type, detail

    @cached_property
    def edges(self) -> DataFrame:
        """(src, dst, type): distinct pairs of ref and include directives, with the type of the first; broken targets are edges too."""
        own = self.directives.where(F.col("type").isin("ref", "include"))
        return own.groupBy(F.col("src_uri").alias("src"), F.col("target_uri").alias("dst")).agg(F.min_by("type", "ord").alias("type"))

    @cached_property
    def include_edges(self) -> DataFrame:
        own = self.directives.where("type = 'include'")
        return own.select(F.col("src_uri").alias("src"), F.col("target_uri").alias("dst")).distinct()

    def save(self, path: str) -> None:
        for name in ("sections", "directives", "problems"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("sections", "directives", "problems")))


def from_parsed(parsed: DataFrame) -> Graph:
    rows = parsed.select(F.explode("sections").alias("s")).select("s.*")
    directives = rows.select(F.col("uri").alias("src_uri"), "file_path", F.explode("directives").alias("d")).select("src_uri", "file_path", "d.*")
    problems = parsed.select("path", F.explode("problems").alias("p")).select("path", "p.*")
    return Graph(rows.drop("directives"), directives, problems)


def build(documents: DataFrame, permissive: bool = True) -> Graph:
    """The graph of documents(path, content): parsed once, written to the shared folder and read from there.

    Unless permissive, any problem in any document raises ParseFailed.
    """
    parsed = kept(parse(documents, permissive))
    graph = from_parsed(parsed)
    if not permissive and (first := graph.problems.orderBy("path").first()):
        raise ParseFailed(f"{first['path']}: {first['detail']}")
    return graph


def update(spark: SparkSession, stored: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed table, plan) after changes. stored: path, sha256, sections, problems. Only new or changed documents are parsed; deleted ones go.

    plan(path, action): reuse, parse or drop.
    """
    now = documents.withColumn("sha256", F.sha2(F.col("content"), 256))
    same = now.join(stored.select("path", "sha256"), ["path", "sha256"], "left_semi")
    fresh = now.join(stored.select("path", "sha256"), ["path", "sha256"], "left_anti")
    gone = stored.select("path").join(now.select("path"), "path", "left_anti")
    action = lambda df, name: df.select("path", F.lit(name).alias("action"))
    plan = action(same, "reuse").union(action(fresh, "parse")).union(action(gone, "drop"))
    parsed = parse(fresh).join(fresh.select("path", "sha256"), "path")
    reused = stored.join(same.select("path"), "path", "left_semi")
    return reused.select("path", "sha256", "sections", "problems").union(parsed.select("path", "sha256", "sections", "problems")), plan
