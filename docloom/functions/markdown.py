"""Markdown of one page, without Spark: its top-level blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_QUOTE = re.compile(r" {0,3}>")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*")
_DASHES = re.compile(r":?-+:?")
_BAR = re.compile(r"(?<!\\)\|")


def cells(line: str) -> list[str]:
    """The trimmed cells of a table line; bars after a backslash belong to a cell."""
    s = line.strip()
    s = s[1:] if s.startswith("|") else s
    s = s[:-1] if s.endswith("|") and not s.endswith("\\|") else s
    return [c.strip() for c in _BAR.split(s)]


def plain(text: str) -> str:
    """Inline Markdown without its marks: links and images by their text, emphasis and code bare."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])\*(?=\S)([^*]+?)(?<=\S)\*(?![\w*])|(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)", lambda m: m[1] or m[2], text)
    return re.sub(r"`([^`]+)`", r"\1", text).replace("\\|", "|")


def _starts(lines: list[str], i: int) -> str:
    """The kind of block that line i can begin in the middle of text; empty for running text."""
    line = lines[i]
    if not line.strip():
        return "blank"
    for kind, mark in (("heading", _HEADING), ("thematicBreak", _RULE)):
        if mark.fullmatch(line):
            return kind
    for kind, mark in (("code", _FENCE), ("blockquote", _QUOTE), ("list", _ITEM)):
        if mark.match(line):
            return kind
    return ""


def _is_table(lines: list[str], i: int) -> bool:
    if i + 1 >= len(lines) or "|" not in lines[i] + lines[i + 1]:
        return False
    rule = cells(lines[i + 1])
    return all(map(_DASHES.fullmatch, rule)) and len(rule) == len(cells(lines[i]))


def _extent(lines: list[str], i: int) -> tuple[str, int]:
    """Kind of the block at line i, and the line after its last."""
    kind, end = _starts(lines, i), i + 1
    if kind in ("heading", "thematicBreak"):
        return kind, end
    if kind == "code":
        fence = _FENCE.match(lines[i])[1]
        while end < len(lines) and not re.fullmatch(rf" {{0,3}}{fence[0]}{{{len(fence)},}}[ \t]*", lines[end]):
            end += 1
        return kind, min(end + 1, len(lines))
    if kind == "list":
        # blank lines part a list only where neither an item nor an indented line follows
        while end < len(lines):
            after = end
            while after < len(lines) and not lines[after].strip():
                after += 1
            if after == len(lines) or (_starts(lines, after) != "list" and not lines[after].startswith(("  ", "\t")) and (after > end or _starts(lines, after))):
                break
            end = after + 1
        return kind, end
    if _is_table(lines, i):
        kind, end = "table", i + 2
    elif not kind:
        kind = "html" if re.match(r" {0,3}<[A-Za-z/!]", lines[i]) else "paragraph"
    while end < len(lines) and (lines[end].strip() if kind in ("html", "blockquote") else not _starts(lines, end)):
        if kind == "paragraph" and _is_table(lines, end):
            break
        end += 1
    if kind == "paragraph" and end < len(lines) and _RULE.fullmatch(lines[end]) and _UNDERLINE.fullmatch(lines[end]):
        return "heading", end + 1
    if kind == "paragraph" and end - i > 1 and _UNDERLINE.fullmatch(lines[end - 1]):
        return "heading", end
    return kind, end


def blocks(text: str | None, is_plain: bool = False) -> Iterator[dict]:
    """Blocks of a page in order: kind, text, start and stop (characters), depth and title of headings, and the rows of
    tables as plain cells, of which the first are the column labels. Plain text is one paragraph."""
    text = text or ""
    if is_plain:
        if text.strip():
            yield {"kind": "paragraph", "text": text, "start": 0, "stop": len(text), "depth": None, "title": None, "rows": None}
        return
    lines, at = text.split("\n"), [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    i = 0
    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        kind, end = _extent(lines, i)
        last = end
        while last > i + 1 and not lines[last - 1].strip():
            last -= 1
        start, stop = at[i] + len(lines[i]) - len(lines[i].lstrip(" ")), at[last] - 1
        found = {"kind": kind, "text": text[start:stop], "start": start, "stop": stop, "depth": None, "title": None, "rows": None}
        if kind == "heading":
            marked = _HEADING.fullmatch(lines[i])
            found["depth"] = len(marked[1]) if marked else 1 if "=" in lines[end - 1] else 2
            found["title"] = plain((marked[2] or "") if marked else " ".join(x.strip() for x in lines[i : end - 1])).strip()
        elif kind == "table":
            found["rows"] = [[plain(c) for c in cells(x)] for x in [lines[i], *lines[i + 2 : end]]]
        yield found
        i = end


def cut_point(text: str) -> tuple[int, str]:
    """Where a text that is too long is cut, and the separator that goes: at the line break nearest the middle, else at the
    blank after a sentence end nearest it in the middle half, else at the nearest blank, else in the middle."""
    middle, last, quarter = len(text) // 2, len(text) - 2, len(text) // 4
    blanks = [m.start() for m in re.finditer(r"\s", text)]
    inner = [i for i in blanks if 1 <= i <= last]
    wanted = (
        [i for i in inner if text[i] == "\n"],
        [i for i in blanks if quarter <= i <= len(text) - quarter and i and text[i - 1] in ".;:!?"],
        inner,
    )
    for places in wanted:
        if places:
            at = min(places, key=lambda i: (abs(i - middle), i))
            return at, text[at]
    return middle, ""
