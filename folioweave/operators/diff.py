"""Structural differences between two snapshots of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    gone = old.select(*keys).join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    come = new.select(*keys).join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return come.union(gone)


def diff(old: Graph, new: Graph) -> DataFrame:
    """(kind, change, src, dst): sections and edges that were added or removed."""
    nodes = _sides(old.sections, new.sections, ["uri"]).select(F.lit("section").alias("kind"), "change", F.col("uri").alias("src"), F.lit(None).cast("string").alias("dst"))
    edges = _sides(old.edges, new.edges, ["src", "dst"]).select(F.lit("edge").alias("kind"), "change", "src", "dst")
    return nodes.union(edges).orderBy("kind", "change", "src", "dst")


def metadata_changes(old: Graph, new: Graph) -> DataFrame:
    """(uri, key, old, new) of top-level metadata that differs between sections both snapshots have (an extension)."""
    flat = lambda g, name: g.sections.select("uri", F.explode("meta_str").alias("key", name))
    both = old.sections.select("uri").join(new.sections.select("uri"), "uri")
    pairs = flat(old, "old").join(flat(new, "new"), ["uri", "key"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return pairs.join(both, "uri", "left_semi").select("uri", "key", "old", "new")
