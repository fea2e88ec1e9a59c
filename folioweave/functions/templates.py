"""Rendering of ``{{ name }}`` and ``{% for x in list %}...{% endfor %}``; an unknown name is an error."""

from __future__ import annotations

import re
from typing import Any

LOOP = re.compile(r"\{%-?\s*for\s+(\w+)\s+in\s+([\w.]+)\s*-?%\}\n?|\{%-?\s*endfor\s*-?%\}\n?")
NAME = re.compile(r"\{\{-?\s*([\w.]+)\s*-?\}\}")


def _value(name: str, scope: dict[str, Any]) -> Any:
    value: Any = scope
    for part in name.split("."):
        if not isinstance(value, dict) or part not in value:
            raise KeyError(f"{name!r} is undefined")
        value = value[part]
    return value


def render(text: str, scope: dict[str, Any]) -> str:
    m = LOOP.search(text)
    if not m:
        if "{%" in text:
            raise ValueError("only for loops are supported")
        return NAME.sub(lambda n: str(_value(n[1], scope)), text)
    if not m[1]:
        raise ValueError("endfor without for")
    depth, at = 1, m.end()
    while depth:
        end = LOOP.search(text, at)
        if not end:
            raise ValueError("for without endfor")
        depth += 1 if end[1] else -1
        at = end.end()
    items = _value(m[2], scope)
    body = "".join(render(text[m.end() : end.start()], {**scope, m[1]: x}) for x in items)
    return render(text[: m.start()], scope) + body + render(text[at:], scope)


def final_newline(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"
