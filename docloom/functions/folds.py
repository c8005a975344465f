"""Ordered work on one document at a time, without Spark: small pure functions that the operators run inside tasks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np

def text_sources(text: str, most: int = 12_000) -> list[str]:
    """Pieces of at most ``most`` characters, cut after the last blank line if that lies past the half."""
    out = []
    while text:
        cut = min(most, len(text))
        if cut < len(text):
            blank = text.rfind("\n\n", 0, cut + 2)
            if blank > cut / 2:
                cut = blank + 2
        out.append(text[:cut])
        text = text[cut:]
    return out or [""]


#: Matching pairs for each unit, on average, beyond which rows of bits are faster than pairs.
DENSE = 64


def kept_in_order(old: list, new: list) -> int:
    """Length of the longest common subsequence.

    Units of one side only are left out. The pairs of equal units, by place in ``old`` and falling place in ``new``, are
    dealt on piles (the least end of a common subsequence of each length), in time of the pairs times the logarithm of
    the length. Where a few units repeat so often that there are too many pairs, a row of bits stands for the piles."""
    places: dict = {}
    for j, x in enumerate(new):
        places.setdefault(x, []).append(j)
    a = [x for x in old if x in places]
    if sum(len(places[x]) for x in a) > DENSE * (len(a) + len(new)):
        return _kept_by_bits(a, new)
    ends: list[int] = []
    for x in a:
        for j in reversed(places[x]):
            at = bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
            else:
                ends[at] = j
    return len(ends)


def _kept_by_bits(old: list, new: list) -> int:
    shared = set(old)
    new = [x for x in new if x in shared]
    number = {x: i for i, x in enumerate(shared)}
    coded = np.array([number[x] for x in new], np.int64)
    bits = {x: int.from_bytes(np.packbits(coded == i, bitorder="little").tobytes(), "little") for x, i in number.items()}
    whole = (1 << len(new)) - 1
    row = whole  # a zero is a place where a longer common subsequence ends
    for x in old:
        met = row & bits[x]
        row = ((row + met) | (row - met)) & whole
    return len(new) - row.bit_count()


def match_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def word_places(text: str) -> dict[str, list[int]]:
    """The places of each word of a text."""
    found: dict[str, list[int]] = {}
    for i, w in enumerate(match_words(text)):
        found.setdefault(w, []).append(i)
    return found


def holds(unit: list[str], places: dict[str, list[int]]) -> bool:
    """Whether a chunk (word_places) has the unit's words in order: all of three or fewer, nine in ten of more."""
    at = found = 0
    for w in unit:
        own = places.get(w, ())
        k = bisect_left(own, at)
        if k < len(own):
            at, found = own[k] + 1, found + 1
    return found == len(unit) if len(unit) <= 3 else found / len(unit) >= 0.9


def follow(candidates: Iterable[list[int] | None]) -> list[int | None]:
    """Of each unit's candidates (ascending places of chunks), the first from the last hit onwards, else the first."""
    cursor, out = 0, []
    for own in candidates:
        hit = None if own is None or not len(own) else own[k] if (k := bisect_left(own, cursor)) < len(own) else own[0]
        out.append(hit)
        cursor = cursor if hit is None else hit
    return out


def _summary_pieces(text: str, most: int, count: Callable[[str], int], slice_chars: int) -> Iterable[tuple[str, int]]:
    """(what is printed, tokens): paragraphs of over 40 characters, in sentences or slices of these where they're too long."""
    for paragraph in text.split("\n\n"):
        if len(paragraph.strip()) <= 40:
            continue
        if count(paragraph) <= most:
            parts = [f"{paragraph}\n\n"]
        else:
            sentences = re.split(r"(?<=[.?!])\s+", paragraph)
            cut = lambda s: [x[k : k + slice_chars] for x in s.split("\n") for k in range(0, len(x), slice_chars)]
            parts = [x for s in sentences for x in ([s] if count(s) <= most else cut(s))]
        whole = len(parts) == 1 and parts[0].endswith("\n\n")
        yield from ((f"{x} " + ("" if whole or i < len(parts) - 1 else "\n\n"), count(x)) for i, x in enumerate(parts))


def summary_batches(text: str, most: int, count: Callable[[str], int], slice_chars: int = 12_000) -> list[str]:
    """The pieces of a text packed in order up to ``most`` tokens: each batch goes as far as the running total allows."""
    pieces = list(_summary_pieces(text, most, count, slice_chars))
    upto = [0, *accumulate(n for _, n in pieces)]
    cuts = [0]
    while cuts[-1] < len(pieces):
        cuts.append(max(cuts[-1] + 1, bisect_right(upto, upto[cuts[-1]] + most) - 1))
    batches = ["".join(x for x, _ in pieces[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [x.strip() for x in batches[:-1]] + batches[-1:]


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, pieces still too long at the next
    ones, and neighbours share up to ``overlap`` characters of whole pieces."""
    sep, rest = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if s == "" or s in text), ("", ()))
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out, run = [], []

    def merge() -> None:
        chunk: list[str] = []
        total = 0
        for p in run:
            extra = len(p) + (len(sep) if chunk else 0)
            if chunk and total + extra > size:
                if joined := sep.join(chunk).strip():
                    out.append(joined)
                while chunk and (total > overlap or (total + len(p) + len(sep) > size and total > 0)):
                    total -= len(chunk.pop(0)) + (len(sep) if chunk else 0)
            chunk.append(p)
            total += len(p) + (len(sep) if len(chunk) > 1 else 0)
        if chunk and (joined := sep.join(chunk).strip()):
            out.append(joined)
        run.clear()

    for p in pieces:
        if len(p) <= size:
            run.append(p)
        else:
            merge()
            out.extend(recursive_split(p, size, overlap, rest) if rest else [p])
    merge()
    return out


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, tables and links of HTML as Markdown; scripts, styles and navigation are left out."""

    SKIP, BLOCK = {"script", "style", "nav", "footer", "head", "noscript"}, {"p", "div", "section", "article", "header", "main", "blockquote", "pre", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.images, self.rows, self.cell, self.links, self.lists = [], 0, 0, None, None, [], []

    def text(self, s: str) -> None:
        (self.cell if self.cell is not None else self.out).append(s)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.text("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.text("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.text("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "img":
            self.images += 1
            self.text(f"[Embedded image {self.images}]")
        elif tag in ("b", "strong"):
            self.text("**")
        elif tag in ("i", "em"):
            self.text("_")
        elif tag == "a":
            self.links.append(a.get("href"))
            self.text("[")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = []
        elif tag in self.BLOCK:
            self.text("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("b", "strong"):
            self.text("**")
        elif tag in ("i", "em"):
            self.text("_")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.text(f"]({href})" if href else "]")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.text("\n\n" if not self.lists else "")
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()).replace("|", "\\|"))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.text("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        elif tag in self.BLOCK or re.fullmatch("h[1-6]", tag):
            self.text("\n\n")

    def handle_data(self, data):
        if not self.skip and (self.rows is None or self.cell is not None):
            self.text(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    lines = [x.strip() if not re.match(r"\s+(- |\d+\. )", x) else x.rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
