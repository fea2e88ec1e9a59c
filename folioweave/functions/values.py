"""Metadata values: YAML loading and the text forms that predicates compare."""

from __future__ import annotations

import json
import posixpath
import re
from typing import Any

import yaml

_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def load_yaml(text: str) -> Any:
    return yaml.load(text, _Loader)  # noqa: S506  a safe loader


def to_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def tags_of(value: Any) -> tuple[list[str] | None, str]:
    """(tags, kind): a list's text elements, a comma string's trimmed parts; other kinds have none."""
    if isinstance(value, str):
        return [t.strip() for t in value.split(",")], "str"
    if isinstance(value, list):
        return [t for t in value if isinstance(t, str)], "list"
    return None, "other"


def resolve(target: str, source: str) -> str:
    """A link target as a URI: relative paths against the folder of ``source``; the fragment is kept."""
    path, mark, fragment = target.partition("#")
    if not target:
        return target
    if not path:
        return source + mark + fragment
    if not path.startswith("/"):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(source) or "/", path))
    else:
        path = re.sub(r"(?<=.)/+$", "", re.sub(r"/(?:\./)+", "/", re.sub(r"//+", "/", path)))
    return path + mark + fragment


def split_uri(uri: str) -> tuple[str, str]:
    path, _, fragment = uri.partition("#")
    if not path or not fragment:
        raise ValueError(f"a section URI is <path>#<id>, got {uri!r}")
    return path, fragment


def descend(value: Any, path: str) -> Any:
    """The value at a dotted path; KeyError where it is missing or crosses something that is no mapping."""
    for part in _parts(path):
        if not isinstance(value, dict):
            raise KeyError(f"{path!r} crosses a value that is no mapping")
        if part not in value:
            raise KeyError(f"{path!r} is missing")
        value = value[part]
    return value


def _parts(path: str) -> list[str]:
    parts = path.split(".")
    if not all(parts):
        raise KeyError(f"{path!r} has an empty part")
    if parts[0] == "section":
        raise KeyError("the section id is protected")
    return parts


def assign(value: dict, path: str, new: Any) -> None:
    *outer, last = _parts(path)
    for part in outer:
        value = value.setdefault(part, {})
        if not isinstance(value, dict):
            raise KeyError(f"{path!r} crosses a value that is no mapping")
    value[last] = new


def remove(value: dict, path: str) -> None:
    *outer, last = _parts(path)
    for part in outer:
        value = value.get(part) if isinstance(value, dict) else None
    if not isinstance(value, dict) or last not in value:
        raise KeyError(f"{path!r} is missing")
    del value[last]
