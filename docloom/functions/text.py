"""Column expressions over text: normal forms, hashes and line classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts on the web see it: Unicode spaces and the byte-order mark.
SPACE = r"(?U)[\s\x{FEFF}]+"


def collapse(text: Column) -> Column:
    """White space evened out to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Lower case, straight quotes, plain dashes, single blanks: what the unit hash is taken of."""
    return collapse(F.translate(F.lower(text), "‘’“”–—", "''\"\"--"))


def unit_hash(text: Column) -> Column:
    return F.substring(F.sha2(normalize_text(text), 256), 1, 16)


def chunk_hash(text: Column) -> Column:
    """Like unit_hash, but case and punctuation count; only white space is evened out."""
    return F.substring(F.sha2(collapse(text), 256), 1, 16)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def is_page_number(line: Column) -> Column:
    return line.rlike(r"(?i)^(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?$")


def furniture_key(line: Column) -> Column:
    """A line's normal form with its digits masked, so that numbered footers are alike."""
    return F.regexp_replace(normalize_text(line), r"\d+", "#")


def is_toc_chunk(heading_path: Column, text: Column) -> Column:
    """Under a contents heading, or three dot-leader lines that end in a number."""
    dotted = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\.{3,}|\. \. \.") & x.rlike(r"\d+\s*$"))
    return F.contains(F.lower(F.array_join(F.coalesce(heading_path, F.array().cast("array<string>")), " ")), F.lit("contents")) | (F.size(dotted) >= 3)


def words(text: Column) -> Column:
    """Runs of ASCII word characters and hyphens, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\w\s-]", " ")), r"\s+"), lambda w: w != "")
