"""The metadata query language, compiled to Column expressions.

    expr := term (OR term)*      term := factor (AND factor)*      factor := NOT factor | ( expr ) | predicate
    predicate := key=value | key~=text | key~=/regex/ | key!=value | tag:value

Values may be quoted ("two words"). Results for text that follows a complete expression: it is ignored, or refused if strict;
an empty expression matches all; an operator without an operand has a true one. Predicates compare Python's text of a value.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\(|\)|(?:AND|OR|NOT)\b|(?:\"[^\"]*\"|[^\s()\"])+", re.I)
PSEUDO = {"section": "id", "id": "id", "path": "file_path", "file": "file_path", "heading": "heading_text"}
COLUMNS = ("title", "status", "owner")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    key: str
    op: str
    value: str


def parse_predicate(text: str) -> Predicate | None:
    for pattern, op in ((r"tag:(.+)", "tag"), (r"([^~=!]+)~=(.+)", "~="), (r"([^~=!]+)!=(.+)", "!="), (r"([^~=]+)=(.+)", "=")):
        if m := re.fullmatch(pattern, text, re.S):
            *key, value = m.groups()
            value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
            return Predicate(key[0].strip() if key else "tags", op, value)
    return None


def _field(key: str, pseudo: bool) -> Column:
    if pseudo and key in PSEUDO:
        return F.col(PSEUDO[key])
    text = F.col("meta_str")[key]
    if key in COLUMNS:  # promoted columns reach the scan; a null value reads as None
        return F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.coalesce(text, F.lit("")))
    return F.coalesce(text, F.lit(""))


def java_regex(pattern: str) -> str:
    """A Python pattern in Java's dialect, with Unicode classes."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"invalid regex: {e}") from None
    return "(?U)" + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def column_of(p: Predicate | None, pseudo: bool = True) -> Column:
    if p is None:
        return F.lit(False)
    if p.op == "tag":
        return F.coalesce(F.array_contains("tags", p.value), F.lit(False))
    if p.op == "=" and p.key in COLUMNS and p.value != "None":
        return F.coalesce(F.col(p.key) == p.value, F.lit(False))
    f = _field(p.key, pseudo)
    if p.op == "~=":
        if pseudo and len(p.value) > 1 and p.value.startswith("/") and p.value.endswith("/"):
            return f.rlike(java_regex(p.value[1:-1]))
        return F.lower(f).contains(p.value.lower())
    return f != p.value if p.op == "!=" else f == p.value


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *words: str) -> bool:
        if self.peek().upper() in words and self.peek():
            self.at += 1
            return True
        return False

    def chain(self, word: str, part, join) -> Column:
        out = part()
        while self.take(word):
            out = join(out, part())
        return out

    def expr(self) -> Column:
        return self.chain("OR", self.term, lambda a, b: a | b)

    def term(self) -> Column:
        return self.chain("AND", self.factor, lambda a, b: a & b)

    def factor(self) -> Column:
        if self.take("NOT"):
            return ~self.factor()
        if self.take("("):
            out = self.expr()
            self.take(")")
            return out
        token = self.peek()
        if not token or token == ")":
            return F.lit(True)
        self.at += 1
        return column_of(parse_predicate(token))


def compile_query(text: str, strict: bool = False) -> Column:
    parser = _Parser(text)
    if not parser.tokens:
        return F.lit(True)
    out = parser.expr()
    if parser.at < len(parser.tokens):
        rest = " ".join(parser.tokens[parser.at :])
        if strict:
            raise QueryError(f"unexpected {rest!r}")
        warnings.warn(f"ignored after the expression: {rest!r}", stacklevel=2)
    return out
