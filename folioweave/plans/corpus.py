"""Graphs derived from the tables: documents rendered as Markdown sections, and the foreign keys of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph, build
from ..sources.store import spread

SCHEMA = {
    "type": "object",
    "required": ["title", "status"],
    "properties": {"priority": {"type": "integer", "maximum": 5}, "status": {"enum": ["todo", "doing", "done"]}, "reviewed": {"type": "boolean"}},
}
WORKFLOWS = [
    {"name": "even", "section_pattern": r"d\d*[02468]$", "allowed_statuses": ["done"], "allowed_transitions": [{"from": "blocked", "to": ["done"]}]},
    {"name": "seven", "section_pattern": r"d7", "allowed_statuses": ["todo", "doing", "done", "blocked"], "allowed_transitions": [{"from": "todo", "to": ["doing", "done"]}, {"from": "done", "to": ["blocked"]}]},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _link(kind: str, label: str, target: Column) -> Column:
    return F.format_string(f"[@{kind}: {label}](d%d.md#d%d)", target, target)


def rendered(docs: DataFrame, n: int, body: bool = True, step: int = 7, shift: int = 3, status: int = 0) -> DataFrame:
    """(path, content, doc_id): each document as one Markdown section with a payload and links; ids run from 0 to n - 1."""
    i = F.col("doc_id").cast("long")
    state = F.element_at(F.array(*map(F.lit, ("todo", "doing", "done", "blocked"))), (F.pmod(i + status, F.lit(4)) + 1).cast("int"))
    last = F.pmod(i, F.lit(100))
    lines = [
        F.format_string("# Doc %d", i), F.lit("\n```yaml"), F.format_string("section: d%d", i), F.format_string("title: Document %d", i),
        F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("status: "), state),
        F.format_string("owner: team%d", F.pmod(i, F.lit(7))), F.format_string("priority: %d", F.pmod(i, F.lit(7))),
        F.when(F.pmod(i, F.lit(2)) == 0, "reviewed: true").otherwise("reviewed: false"), F.format_string("created: 2024-01-%02d", F.pmod(i, F.lit(28)) + 1),
        F.format_string("tags: [%s, %s]", "lang", "source"), F.format_string("limits: {retries: %d, mode: strict}", F.pmod(i, F.lit(9))),
        F.when(F.pmod(i, F.lit(5)) == 0, "schema: schema.json"), F.lit("```\n"),
        _link("ref", "next", F.pmod(i * step + shift, F.lit(n + 5))), F.when(i == 0, _link("include", "three", F.lit(3))),
        F.when((i >= 1) & (F.pmod(i, F.lit(3)) != 0), _link("include", "half", F.floor(i / 2).cast("long"))),
        F.when((last == 98) & (i + 1 < n), _link("include", "pair", i + 1)), F.when(last == 99, _link("include", "pair", i - 1)),
        *([F.concat(F.lit("\n"), "text")] if body else []),
    ]
    return docs.select(F.format_string("/corpus/d%d.md", i).alias("path"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("content"), F.col("doc_id"))


def corpus_documents(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rendered(spread(docs), docs.count(), **how)


def corpus_graph(spark: SparkSession, sf_dir: str, **how) -> Graph:
    return build(corpus_documents(spark, sf_dir, **how))


def key_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Rows as nodes, foreign keys as edges (type ref); orders refer to the parts of their lines too."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    links = [("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey")]
    uri = lambda name, key: F.concat(F.lit(f"{name}#"), F.col(key).cast("string"))
    nodes = e = None
    for name, key in keys.items():
        own = t[name].select(uri(name, key).alias("uri"), F.lit(name).alias("file_path"), F.col(key).cast("string").alias("id"))
        nodes = own if nodes is None else nodes.union(own)
    for src, key, dst, foreign in links:
        own = t[src].select(uri(src, key).alias("src_uri"), F.lit(src).alias("file_path"), uri(dst, foreign).alias("target_uri"))
        e = own if e is None else e.union(own)
    parts = t["lineitem"].select(uri("orders", "l_orderkey").alias("src_uri"), F.lit("orders").alias("file_path"), uri("part", "l_partkey").alias("target_uri"))
    directives = e.union(parts).select("src_uri", "file_path", F.lit(0).alias("ord"), F.lit("ref").alias("type"), "target_uri", F.lit(None).cast("string").alias("label"))
    return Graph(nodes, directives, spark.createDataFrame([], "path string, type string, detail string"))
