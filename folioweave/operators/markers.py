"""Text blocks between a start and an end marker, put into or taken out of text columns or strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _span(start: str, end: str) -> str:
    return f"(?s){re.escape(start)}.*?{re.escape(end)}"


def upsert(text: Column, block: str, start: str, end: str, at_top: bool = True) -> Column:
    """The text with the block between the markers replaced, or put at the top or the bottom where there is none; null text is the block alone."""
    whole = f"{start}\n{block}\n{end}"
    has = text.contains(start) & (F.instr(F.substring_index(text, start, -1), end) > 0)
    quoted = whole.replace("\\", "\\\\").replace("$", "\\$")
    replaced = F.regexp_replace(text, _span(start, end), quoted)
    put = F.concat(F.lit(whole + "\n\n"), text) if at_top else F.concat(F.rtrim(F.regexp_replace(text, r"\s+$", "")), F.lit("\n\n" + whole + "\n"))
    return F.when(text.isNull(), F.lit(whole + "\n")).when(has, replaced).otherwise(put)


def removed(text: Column, start: str, end: str) -> Column:
    """The text without the block; null where nothing but white space is left."""
    out = F.regexp_replace(text, rf"(?s)\s*{re.escape(start)}.*?{re.escape(end)}\s*", "\n")
    return F.when(text.rlike(_span(start, end)), F.when(F.trim(F.regexp_replace(out, r"\s+", " ")) == "", F.lit(None)).otherwise(out)).otherwise(text)


def present(text: Column, start: str, end: str) -> Column:
    return F.coalesce(text.rlike(_span(start, end)), F.lit(False))
