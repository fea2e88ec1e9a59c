"""Point look-ups, metadata search and one-hop queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import split_uri
from .graph import Graph
from .predicates import column_of, compile_query, parse_predicate


def section(graph: Graph, uri: str) -> DataFrame:
    """The node of a URI: no row if there is none."""
    split_uri(uri)
    return graph.sections.where(F.col("uri") == uri)


def get(graph: Graph, uri: str) -> DataFrame:
    """uri, file_path, source_start_line, source_end_line, content: the exact source slice, with a final newline."""
    ended = F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    return section(graph, uri).select("uri", "file_path", F.col("start_line").alias("source_start_line"), F.col("end_line").alias("source_end_line"), ended.alias("content"))


def search(graph: Graph, predicate: str) -> DataFrame:
    """Sections that meet one predicate (no pseudo fields, no regex); an unknown form matches nothing."""
    return graph.sections.where(column_of(parse_predicate(predicate), pseudo=False)).select("uri", "meta_json").orderBy("uri")


def query(graph: Graph, expression: str, strict: bool = False) -> DataFrame:
    return graph.sections.where(compile_query(expression, strict)).select("uri", "meta_json").orderBy("uri")


def backlinks(graph: Graph, uri: str | None = None) -> DataFrame:
    """(target, uri, type) of the edges into one URI, or into all."""
    e = graph.edges if uri is None else graph.edges.where(F.col("dst") == uri)
    return e.select(F.col("dst").alias("target"), F.col("src").alias("uri"), "type").orderBy("target", "uri")


def labels(graph: Graph) -> DataFrame:
    return graph.sections.select("uri", F.coalesce("title", "id", "uri").alias("label"))


def context(graph: Graph, uri: str | None = None) -> DataFrame:
    """uri, meta_json, outgoing and incoming arrays of (uri, type), sorted; for one URI or for all sections."""
    nodes, e = graph.sections.select("uri", "meta_json"), graph.edges
    outgoing, incoming = e, e
    if uri is not None:
        nodes, outgoing, incoming = nodes.where(F.col("uri") == uri), e.where(F.col("src") == uri), e.where(F.col("dst") == uri)

    def side(edges: DataFrame, own: str, other: str, name: str) -> DataFrame:
        return edges.groupBy(F.col(own).alias("uri")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("uri"), "type"))).alias(name))

    empty = F.array().cast("array<struct<uri:string,type:string>>")
    out = nodes.join(side(outgoing, "src", "dst", "outgoing"), "uri", "left").join(side(incoming, "dst", "src", "incoming"), "uri", "left")
    return out.select("uri", "meta_json", F.coalesce("outgoing", empty).alias("outgoing"), F.coalesce("incoming", empty).alias("incoming"))


def metadata(graph: Graph, path: str | None = None, uri: str | None = None) -> DataFrame:
    """(uri, value): the JSON of the metadata, or of the value at a dotted path (missing: no row)."""
    own = graph.sections if uri is None else section(graph, uri)
    if path is None:
        return own.select("uri", F.col("meta_json").alias("value"))
    if path.split(".")[0] == "section" or not all(path.split(".")):
        raise ValueError(f"no metadata path: {path!r}")
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    value = F.expr(f"to_json(try_variant_get(parse_json(meta_json), {_quoted(at)}, 'variant'))")
    return own.select("uri", value.alias("value")).where("value is not null")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
