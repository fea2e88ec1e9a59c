"""A scanner for the CommonMark blocks and inline links that sections and directives need. Pure Python, no Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r"^ {0,3}> ?")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:( +)(.*)|[ \t]*)$")
HTML = re.compile(r"^ {0,3}<(?:!--|\?|![A-Z]|/?[A-Za-z][A-Za-z0-9-]*(?:[ \t/>]|$))")
REFERENCE = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*(<[^>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
#: Kinds of blocks that count as text in front of a payload.
TEXTUAL = frozenset({"paragraph", "list", "quote", "html", "rule"})


@dataclass
class Block:
    kind: str
    start: int
    end: int
    text: str = ""
    info: str = ""
    level: int = 0


@dataclass
class Scan:
    blocks: list[Block] = field(default_factory=list)
    references: dict[str, str] = field(default_factory=dict)


def _expanded(line: str) -> str:
    return line.replace("\t", "    ")


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph."""
    if ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line):
        return True
    m = ITEM.match(line)
    if m and m[4] and (not m[2][0].isdigit() or m[2][:-1] == "1"):
        return True
    return bool(re.match(r"^ {0,3}<(?:!--|\?|/?(?:address|article|aside|blockquote|body|details|div|dl|fieldset|footer|form|h[1-6]|header|hr|html|iframe|li|link|main|menu|nav|ol|p|script|section|style|summary|table|td|th|tr|ul)(?:[ \t/>]|$))", line, re.I))


def _paragraph(scan: Scan, lines: list[str], start: int, base: int) -> int:
    end, level = start + 1, 0
    while end < len(lines) and lines[end].strip():
        m = SETEXT.match(lines[end])
        if m:
            level = 1 if m[1][0] == "=" else 2
            break
        if _starts_block(lines[end]):
            break
        end += 1
    own = [x.strip() for x in lines[start:end]]
    while own and (m := REFERENCE.match(own[0])):
        scan.references.setdefault(" ".join(m[1].lower().split()), m[2].strip("<>"))
        own.pop(0)
    if level and own:
        scan.blocks.append(Block("heading", base + start, base + end + 1, "\n".join(own), level=level))
        return end + 1
    if own:
        scan.blocks.append(Block("paragraph", base + start, base + end, "\n".join(own)))
    return end + (1 if level else 0)


def scan_lines(lines: list[str], base: int = 0, scan: Scan | None = None, depth: int = 0) -> Scan:
    """The blocks of lines in order; the blocks inside of quotes and list items follow their container."""
    scan = scan or Scan()
    i, n = 0, len(lines)
    while i < n:
        line = _expanded(lines[i])
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            end = i + 1
            while end < n and (not lines[end].strip() or _expanded(lines[end]).startswith("    ")):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            scan.blocks.append(Block("code", base + i, base + end))
            i = end
        elif m := ATX.match(line):
            scan.blocks.append(Block("heading", base + i, base + i + 1, (m[2] or "").strip() if set(m[2] or "#") != {"#"} else "", level=len(m[1])))
            i += 1
        elif (m := FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            end = i + 1
            while end < n and not close.match(lines[end]):
                end += 1
            indent = len(m[1])
            body = [x[min(indent, len(x) - len(x.lstrip(" "))) :] for x in lines[i + 1 : end]]
            scan.blocks.append(Block("fence", base + i, base + min(end + 1, n), "\n".join(body) + "\n" if body else "", m[3].strip()))
            i = end + 1
        elif QUOTE.match(line) and depth < 20:
            end, inner = i, []
            while end < n and (QUOTE.match(lines[end]) or (inner and lines[end].strip() and inner[-1].strip() and not _starts_block(lines[end]))):
                inner.append(QUOTE.sub("", lines[end], count=1))
                end += 1
            scan.blocks.append(Block("quote", base + i, base + end))
            scan_lines(inner, base + i, scan, depth + 1)
            i = end
        elif RULE.match(line):
            scan.blocks.append(Block("rule", base + i, base + i + 1))
            i += 1
        elif (m := ITEM.match(line)) and depth < 20:
            width = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] and len(m[3]) < 5 else 1)
            end, inner = i + 1, [line[width:]]
            while end < n:
                own = _expanded(lines[end])
                if own.strip() and not own.startswith(" " * width):
                    if not lines[end - 1].strip() or _starts_block(own) or not inner[-1].strip():
                        break
                inner.append(own[width:] if own.startswith(" " * width) else own.lstrip())
                end += 1
            while not inner[-1].strip() and len(inner) > 1:
                inner.pop()
                end -= 1
            scan.blocks.append(Block("list", base + i, base + end))
            scan_lines(inner, base + i, scan, depth + 1)
            i = end
        elif HTML.match(line):
            end = i + 1
            comment = line.lstrip().startswith("<!--")
            while end < n and (("-->" not in lines[end - 1]) if comment else lines[end].strip()):
                end += 1
            scan.blocks.append(Block("html", base + i, base + end))
            i = end
        else:
            i = _paragraph(scan, lines, i, base)
    return scan


DEST = re.compile(r"\(\s*(<[^<>\n]*>|[^\s()<>](?:[^\s()]|\([^\s()]*\))*)?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
CODE = re.compile(r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)", re.S)
TOKEN = re.compile(r"\\.|\[|\]|`+", re.S)


def links(text: str, references: dict[str, str]) -> list[tuple[str, str]]:
    """(text, target) of the inline and reference links, in order; code spans and escapes are no links."""
    out, open_at, i = [], [], 0
    while m := TOKEN.search(text, i):
        i = m.end()
        if m[0][0] == "`":
            code = CODE.match(text, m.start())
            i = code.end() if code else i
        elif m[0] == "[":
            open_at.append(m.start())
        elif m[0] == "]" and open_at:
            start = open_at.pop()
            inner = text[start + 1 : m.start()]
            d = DEST.match(text, m.end())
            if d:
                target, i = (d[1] or "").strip("<>"), d.end()
            else:
                r = re.match(r"\[([^\]]*)\]", text[m.end() :])
                label = " ".join(((r[1] if r else "") or inner).lower().split())
                if label not in references:
                    continue
                target, i = references[label], m.end() + (r.end() if r else 0)
            if start and text[start - 1] == "!":
                continue
            out.append((inner, target))
            open_at.clear()
    return out


def first_inline(text: str) -> str:
    """The content of the first inline element of a heading: plain text up to the first markup, or a code span's content."""
    if text.startswith("`") and (m := CODE.match(text)):
        return m[2].strip()
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", re.split(r"[*`\[<]|!\[|\n", text, maxsplit=1)[0]) if text[:1] not in "*_[<" else ""
