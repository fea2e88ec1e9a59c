"""Composition: a section's text with its include lines replaced by the included sections, recursively.

The skeleton of includes is expanded level by level as rows keyed by a path of line numbers; then every instance's
lines between its includes are cut, re-levelled and concatenated in the order of their keys, all in DataFrame functions.
An include of a section that is already on the path is dropped (with a warning), one beyond the depth is dropped,
a missing one leaves a placeholder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept
from .graph import Graph

NEWLINE = r"\r\n|\n|\r"


class MissingSection(ValueError):
    pass


def placeholder(uri: Column) -> Column:
    return F.format_string('<!-- unresolved uri="%s" -->', uri)


def relevelled(line: Column, offset: Column) -> Column:
    """A line that starts with # gets offset more of them, one at least."""
    marks = F.length(F.regexp_extract(line, "^#+", 0))
    moved = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), marks + offset)), F.substring(line, marks + 1, F.length(line)))
    return F.when((offset != 0) & line.startswith("#"), moved).otherwise(line)


def _lines(content: Column) -> Column:
    """Lines without their ends, cut at a single byte: patterns took most of a composition's time."""
    text = F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), "\n")


def expand(graph: Graph, roots: DataFrame, depth: int | None = None, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances, warnings). instances(root, key, uri, offset, depth, missing); warnings(root, kind, uri)."""
    nodes = graph.sections.select("uri", "heading_level", "includes")
    level = roots.select(F.col("uri").alias("root"), F.array().cast("array<int>").alias("key"), "uri", F.lit(None).cast("int").alias("parent_level"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"))
    shown, warned, d = None, None, 0
    while True:
        met = level.join(nodes.hint("merge"), "uri", "left")
        offset = F.when(F.col("heading_level").isNull(), F.lit(0)).otherwise(F.coalesce("parent_level", F.lit(0)) + 1 - F.col("heading_level"))
        met = kept(met.select("root", "key", "uri", offset.alias("offset"), "depth", F.col("heading_level").isNull().alias("missing"), F.array_append("path", F.col("uri")).alias("path"), (F.col("heading_level") + offset).alias("new_level"), "includes"))
        if met.isEmpty():
            break
        found = met.select("root", "key", "uri", "offset", "depth", "missing")
        shown = found if shown is None else shown.union(found)
        child = met.where("not missing").select("root", "key", "path", "new_level", F.explode("includes").alias("i"))
        cyclic = F.array_contains("path", F.col("i.target"))
        notes = child.where(cyclic).select("root", F.lit("cycle").alias("kind"), F.col("i.target").alias("uri")).union(met.where("missing").select("root", F.lit("missing"), "uri"))
        warned = notes if warned is None else warned.union(notes)
        if depth is not None and d >= depth:
            break
        d += 1
        level = child.where(~cyclic).select("root", F.array_append("key", F.col("i.ln")).alias("key"), F.col("i.target").alias("uri"), F.col("new_level").alias("parent_level"), "path", F.lit(d).alias("depth"))
    if shown is None:  # no roots
        spark = graph.sections.sparkSession
        return spark.createDataFrame([], "root string, key array<int>, uri string, offset int, depth int, missing boolean"), spark.createDataFrame([], "root string, kind string, uri string")
    return shown, warned


def pieces(graph: Graph, instances: DataFrame) -> DataFrame:
    """(root, key, text, depth): the runs of lines of each instance between its include lines."""
    whole = instances.where("not missing").join(graph.sections.select("uri", "content", F.transform("includes", lambda x: x.ln).alias("cut")).hint("merge"), "uri")
    whole = whole.select("root", "key", "offset", "depth", "cut", _lines(F.col("content")).alias("lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda x: x + 1))
    ends = F.concat(F.col("cut"), F.array(F.size("lines")))
    # outer, though there always is a run: for a plain one Spark adds a filter on its size, which cuts the lines once more
    run = whole.select("root", "key", "offset", "depth", "lines", F.explode_outer(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r")).where("r.a < r.b")
    text = F.concat_ws("\n", F.transform(F.slice("lines", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), lambda x: relevelled(x, F.col("offset"))))
    own = run.select("root", F.array_append("key", F.col("r.a")).alias("key"), text.alias("text"), "depth")
    return own.union(instances.where("missing").select("root", "key", placeholder(F.col("uri")), "depth"))


def joined(parts: DataFrame) -> DataFrame:
    """(root, content): the pieces of each root in the order of their keys."""
    ordered = F.array_sort(F.collect_list(F.struct("key", "text")))
    return parts.groupBy("root").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["text"])).alias("content"))


def compose(graph: Graph, uri: str | None = None, depth: int | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """((root, content), warnings) for one section, or for all. The root becomes heading level 1, each include one below its parent."""
    roots = graph.sections.select("uri") if uri is None else graph.sections.where(F.col("uri") == uri).select("uri")
    if uri is not None and roots.isEmpty():
        raise MissingSection(f"no section {uri!r}")
    shown, warned = expand(graph, roots, depth)
    if strict and (bad := warned.where("kind = 'missing'").first()):
        raise MissingSection(f"no section {bad['uri']!r}")
    return joined(pieces(graph, shown)), warned


def compose_once(graph: Graph, uri: str, depth: int | None = None, strict: bool = False) -> str:
    """The composition of one section where a section that comes again is a reference to it.

    Which occurrence is the first depends on depth-first order, so the skeleton of the includes that the root reaches is
    walked on the driver: one document's includes, not the corpus. The texts are fetched for visited sections only.
    """
    from .traverse import bfs

    e = graph.sections.select(F.col("uri").alias("src"), F.explode("includes").alias("i")).select("src", F.col("i.target").alias("dst"), F.lit("o").alias("direction"))
    spark = graph.sections.sparkSession
    near = kept(bfs(e, spark.createDataFrame([(uri, uri)], "seed string, uri string"), depth).select("uri"))
    nodes = {r["uri"]: r for r in graph.sections.join(near, "uri", "left_semi").select("uri", "heading_level", "includes", "content").toLocalIterator()}
    if uri not in nodes:
        raise MissingSection(f"no section {uri!r}")
    import re

    seen: set[str] = set()
    out: list[str] = []
    # frames: (uri, lines, next line, offset, path, depth left)
    stack: list[list] = []

    def enter(at: str, parent_level: int, path: frozenset, left: int | None) -> None:
        if at not in nodes:
            if strict:
                raise MissingSection(f"no section {at!r}")
            out.append(f'<!-- unresolved uri="{at}" -->')
        elif at in seen:
            out.append(f"@ref({at})")
        else:
            seen.add(at)
            n = nodes[at]
            stack.append([n, re.split(NEWLINE, re.sub(rf"(?:{NEWLINE})\Z", "", n["content"])), 0, parent_level + 1 - n["heading_level"], path | {at}, left])

    enter(uri, 0, frozenset(), depth)
    while stack:
        frame = stack[-1]
        node, lines, i, offset, path, left = frame
        if i >= len(lines):
            stack.pop()
            continue
        frame[2] += 1
        target = next((x["target"] for x in node["includes"] if x["ln"] == i), None)
        if target is None:
            marks = len(lines[i]) - len(lines[i].lstrip("#"))
            out.append("#" * max(1, marks + offset) + lines[i][marks:] if marks and offset else lines[i])
        elif target not in path and (left is None or left > 0):
            enter(target, node["heading_level"] + offset, path, None if left is None else left - 1)
    return "\n".join(out)


def context_compose(graph: Graph, uri: str | None = None, depth: int | None = None, token_limit: int | None = None) -> DataFrame:
    """(root, content, token_estimate, truncated): the composition cut to 4 * token_limit characters; a token is four characters."""
    text, _ = compose(graph, uri, depth)
    if token_limit is None:
        return text.select("root", "content", F.expr("length(content) div 4").alias("token_estimate"), F.lit(False).alias("truncated"))
    cut = F.substring("content", 1, 4 * token_limit)
    out = text.select("root", cut.alias("content"), (F.length("content") > 4 * token_limit).alias("truncated"))
    return out.select("root", "content", F.expr("length(content) div 4").alias("token_estimate"), "truncated")
