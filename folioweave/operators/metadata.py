"""Edits of a section's metadata inside its Markdown text: only the lines between the payload's fences change."""

from __future__ import annotations

import json
import re

import yaml
from pyspark.sql import DataFrame

from ..functions.values import assign, descend, load_yaml, remove
from ..sources.batches import mapped
from ..sources.markdown import scan_lines


def payload_at(text: str, section_id: str) -> tuple[list[str], int, int, dict]:
    """(lines with their ends, first, end, metadata): the payload lines of a section; its yaml fence may stand anywhere in its direct content."""
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    for b in scan_lines([x.rstrip("\r\n") for x in lines]).blocks:
        if b.kind == "fence" and b.info == "yaml":
            try:
                value = load_yaml(b.text)
            except yaml.YAMLError:
                continue
            if isinstance(value, dict) and str(value.get("section")) == section_id:
                return lines, b.start + 1, b.end - 1, value
    raise KeyError(f"no section {section_id!r}")


def read(text: str, section_id: str, path: str | None = None):
    """The raw metadata (with its key ``section``), or the value at a dotted path."""
    value = payload_at(text, section_id)[3]
    return value if path is None else descend(value, path)


def _rewritten(text: str, section_id: str, change) -> str:
    lines, first, end, value = payload_at(text, section_id)
    change(value)
    body = yaml.safe_dump(value, sort_keys=False, allow_unicode=True, default_flow_style=False)
    return "".join(lines[:first]) + body + "".join(lines[end:])


def updated(text: str, section_id: str, path: str, value_json: str) -> str:
    return _rewritten(text, section_id, lambda meta: assign(meta, path, json.loads(value_json)))


def unset(text: str, section_id: str, path: str) -> str:
    return _rewritten(text, section_id, lambda meta: remove(meta, path))


def edit(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """documents(path, content) joined with edits(path, id, key, value_json; a null value unsets) -> (path, content, error), edited documents only.

    The edits of one document are applied in the order of id and key; the first that fails is reported and the content stays.
    """

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            text, error = row["content"], None
            try:
                for e in sorted(row["edits"], key=lambda e: (e["id"], e["key"])):
                    text = unset(text, e["id"], e["key"]) if e["value_json"] is None else updated(text, e["id"], e["key"], e["value_json"])
            except (KeyError, ValueError) as bad:
                text, error = row["content"], str(bad.args[0] if bad.args else bad)
            out.append({"path": row["path"], "content": text, "error": error})
        return out

    from pyspark.sql import functions as F

    todo = edits.groupBy("path").agg(F.collect_list(F.struct("id", "key", "value_json")).alias("edits"))
    return mapped(documents.join(todo, "path").select("path", "content", "edits"), work, "path string, content string, error string")
