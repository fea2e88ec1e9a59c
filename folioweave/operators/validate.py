"""Integrity findings: (phase, type, uri, detail, schema, schema_path, path), all phases as one DataFrame."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as js
from ..functions.values import resolve
from ..sources.batches import mapped
from .graph import Graph
from .predicates import java_regex
from .traverse import include_cycles, reachable_files

FIELDS = ["phase", "type", "uri", "detail", "schema", "schema_path", "path"]


def _finding(df: DataFrame, phase: int, kind: Column | str, uri: Column | str, detail: Column, **more: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    uri = F.col(uri) if isinstance(uri, str) else uri
    rest = [more.get(k, F.lit(None)).cast("string").alias(k) for k in FIELDS[4:]]
    return df.select(F.lit(phase).alias("phase"), kind.alias("type"), uri.alias("uri"), detail.alias("detail"), *rest)


def parse_errors(graph: Graph) -> DataFrame:
    return _finding(graph.problems, 0, F.col("type"), "path", F.col("detail"))


def broken_targets(graph: Graph, only_file: str | None = None) -> DataFrame:
    """One finding for each ref or include directive without a target; with only_file targets in other files are not judged."""
    links = graph.directives.where(F.col("type").isin("ref", "include"))
    if only_file is not None:
        links = links.where(F.substring_index("target_uri", "#", 1) == only_file)
    lost = links.join(graph.sections.select(F.col("uri").alias("target_uri")), "target_uri", "left_anti")
    return _finding(lost, 1, F.concat(F.lit("broken_"), F.col("type")), "src_uri", F.concat(F.lit("no section "), F.col("target_uri")))


def cycles(graph: Graph) -> DataFrame:
    return _finding(include_cycles(graph), 2, "cycle", "uri", F.lit("the section is on a cycle of includes"))


def _checked(loaded: dict[str, dict | str | None], rows: list[dict]) -> list[dict]:
    out = []
    for row in rows:
        value, where = json.loads(row["meta_json"]), row["schema_path"]
        where = where if "://" in where else resolve(where, "/")
        try:
            if not isinstance(value.get("schema"), str):
                raise js.Invalid("schema_validation_error", ["schema"], "the schema reference must be a string")
            if loaded.get(where) is None:
                raise js.Invalid("schema_unreachable_uri" if re.match("https?://", where) else "schema_not_found", ["schema"], f"no schema at {where}")
            if isinstance(loaded[where], str):
                raise js.Invalid("schema_invalid", ["schema"], loaded[where])
            js.check(value, loaded[where])
        except js.Invalid as bad:
            out.append({"uri": row["uri"], "type": bad.kind, "detail": bad.detail, "schema": row["schema_ref"], "schema_path": where, "path": bad.path})
    return out


def schema_findings(graph: Graph, schemas: dict[str, dict | str | None]) -> DataFrame:
    """The first violation of each section that names a schema. schemas: documents by resolved path or web address; a text tells why one can't be used."""
    named = graph.sections.where("schema_ref is not null")
    local = F.concat(F.regexp_replace("file_path", "/[^/]*$", "/"), F.col("schema_ref"))
    known = json.loads(json.dumps(schemas))
    refs = named.select("uri", "meta_json", "schema_ref", "file_path").withColumn("schema_path", F.when(F.col("schema_ref").rlike("^(https?:/)?/"), F.col("schema_ref")).otherwise(local))

    found = mapped(refs, lambda rows: _checked(known, rows), "uri string, type string, detail string, schema string, schema_path string, path string")
    return _finding(found, 3, F.col("type"), "uri", F.col("detail"), schema=F.col("schema"), schema_path=F.col("schema_path"), path=F.col("path"))


def workflow_findings(graph: Graph, workflows: list[dict], history: DataFrame | None = None) -> DataFrame:
    """Statuses outside a workflow's list and, with history(file_path, id, old_status), transitions it does not allow.

    The workflows are a configuration; each is one filter with a constant pattern, matched at the start of the id.
    """
    nodes = graph.sections.select("uri", "file_path", "id", "status")
    out = None
    for w in workflows:
        if not w.get("name") or not w.get("section_pattern"):
            continue
        try:
            pattern = java_regex(w["section_pattern"])
        except ValueError:
            continue  # a pattern that no engine reads names no section
        allowed = [str(s) for s in w.get("allowed_statuses") or []]
        own = nodes.where(F.col("id").rlike(f"^(?:{pattern})"))
        fits = F.coalesce(F.col("status").isin(*allowed), F.lit(False)) if allowed else F.lit(False)
        shown = F.coalesce("status", F.lit("None"))
        part = _finding(own.where(~fits), 4, "workflow_status_error", "uri", F.format_string(f"status '%s' is not allowed in workflow '{w['name']}'", shown))
        out = part if out is None else out.union(part)
        if history is not None:
            moves = [(str(t.get("from")), str(to)) for t in w.get("allowed_transitions") or [] for to in t.get("to") or []]
            changed = own.where(fits).join(history.select("file_path", "id", "old_status"), ["file_path", "id"]).where("old_status <> '' and old_status <> status")
            legal = F.lit(False)
            for a, b in moves:
                legal = legal | ((F.col("old_status") == a) & (F.col("status") == b))
            out = out.union(_finding(changed.where(~legal), 4, "workflow_transition_error", "uri", F.format_string(f"status may not go from '%s' to '%s' in workflow '{w['name']}'", "old_status", "status")))
    if out is None:
        return _finding(nodes.limit(0), 4, "workflow_status_error", "uri", F.lit(""))
    return out


def status_history(old: Graph) -> DataFrame:
    """(file_path, id, old_status) of a snapshot; of several sections with one key the last counts."""
    return old.sections.groupBy("file_path", "id").agg(F.max_by("status", "ord").alias("old_status")).where("old_status is not null")


SKIPPED = ["node_modules", "__pycache__", "venv", "tests"]


def conformity(graph: Graph, files: DataFrame, root: str, memory_root: str | None = None, entry: str = "CONSTITUTION.md") -> DataFrame:
    """``missing_constitution``, or ``unreachable_file`` for each Markdown file (hidden and tool folders apart) that links do not lead to from the entry file."""
    folders = [*([memory_root] if memory_root else []), "", "scrum", "docs", "memory", "kanban", "product", "engineering", "minimal"]
    wanted = [f"{root}/{f}/{entry}" if f else f"{root}/{entry}" for f in folders]
    there = {r[0] for r in files.where(F.col("path").isin(*wanted)).select("path").collect()}
    first = next((w for w in wanted if w in there), None)
    if first is None:
        spark = files.sparkSession
        return _finding(spark.createDataFrame([(root,)], "uri string"), 5, "missing_constitution", "uri", F.lit(f"no {entry} in the usual folders"))
    part = F.split(F.substring(F.col("path"), len(root) + 2, 1 << 20), "/")
    judged = files.where(F.col("path").startswith(root + "/") & ~F.exists(part, lambda p: p.startswith(".") | p.isin(*SKIPPED))).select("path")
    lost = judged.join(reachable_files(graph, [first], files).withColumnRenamed("file_path", "path"), "path", "left_anti")
    return _finding(lost, 5, "unreachable_file", "path", F.lit(f"no links lead here from {first}"))


def validate(graph: Graph, schemas: dict[str, dict | str | None] | None = None, workflows: list[dict] | None = None, history: DataFrame | None = None, files: DataFrame | None = None, root: str | None = None, memory_root: str | None = None, only_file: str | None = None) -> DataFrame:
    out = parse_errors(graph).union(broken_targets(graph, only_file)).union(cycles(graph)).union(schema_findings(graph, schemas or {}))
    out = out.union(workflow_findings(graph, workflows or [], history))
    if files is not None and root is not None and only_file is None:
        out = out.union(conformity(graph, files, root, memory_root))
    return out.orderBy("phase", "uri", "detail")


def summary(graph: Graph, findings: DataFrame | None = None) -> DataFrame:
    """(total_sections, total_edges, errors, warnings)"""
    nodes = graph.sections.agg(F.count("*").alias("total_sections"))
    edges = graph.edges.agg(F.count("*").alias("total_edges"))
    errors = (findings.agg(F.count("*").alias("errors"))) if findings is not None else nodes.select(F.lit(0).cast("long").alias("errors"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  three rows of totals
    return one(nodes).join(one(edges), "k").join(one(errors), "k").select("total_sections", "total_edges", "errors", F.lit(0).cast("long").alias("warnings"))
