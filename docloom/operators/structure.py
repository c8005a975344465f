"""Document structure: contents lists, the outline they give, appendix ranges and boundaries, table rows, references.

Contents lines: doc_id, page, line_no, text. Outline entries: doc_id, idx (order), code, title, target_page, page_count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.frames import stored, united
from docloom.functions.references import cross_references

from . import postings

#: Fixed value: an appendix code, after an optional letter label.
APPENDIX = r"(?i)^(?:[A-Z]\s*[-–—]?\s+)?((?:Appendix|Annexure|Annex)[\s-]+[A-Z0-9]+)\b"


def normalize_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def clean_line(text: Column) -> Column:
    """A line without heading marks, bullets, table bars and bold marks."""
    for pattern in (r"^\s*#{1,6}\s+", r"^\s*[-*]\s+", r"^\s*\|\s*", r"\*\*"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def appendix_code(text: Column) -> Column:
    """``Appendix A`` of a line, null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(clean_line(F.coalesce(text, F.lit(""))), APPENDIX, 1), r"[\s-]+", " "), F.lit(""))


def outline_title(code: Column, title: Column) -> Column:
    """The entry's title with its code in front, unless the title has it already."""
    code, title = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    appendix = appendix_code(title)
    plain = F.when(appendix.isNotNull(), F.regexp_replace(title, r"(?i)^[A-Z]\s*[-–—]?\s+(?=Appendix|Annex)", "")).otherwise(title)
    inside = F.coalesce((F.lower(appendix_code(code)) == F.lower(appendix)) | F.endswith(F.lower(appendix), F.concat(F.lit(" "), F.lower(code))), F.lit(False))
    bare = (code == "") | inside | F.startswith(F.lower(plain), F.lower(code))
    return F.when(bare, F.when(plain == "", code).otherwise(plain)).otherwise(F.concat(code, F.lit(" - "), plain))


def entry_appendix(code: Column, title: Column) -> Column:
    return F.coalesce(appendix_code(code), appendix_code(outline_title(code, title)))


def contents_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, is_toc) that are flagged as contents or have a line that says so."""
    said = F.coalesce("text", F.lit("")).rlike(r"(?im)^(?:#{1,6}\s+)?(?:Table of Contents|Contents)\s*$")
    return pages.where(F.col("is_toc").eqNullSafe(F.lit(True)) | said)


def parse_contents_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page, line_no, code, title, target_page, page_count of lines with three dot leaders and a page number."""
    pattern = r"^(.+?)\s*(?:\.\s*){3,}(\d+)\s*$"
    text = clean_line(F.col("text"))
    rows = lines.where(text.rlike(pattern)).withColumns({"title": F.trim(F.regexp_extract(text, pattern, 1)), "target_page": F.regexp_extract(text, pattern, 2).try_cast("int")})
    code = F.coalesce(appendix_code(F.col("title")), F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\s+", 1))
    pages = F.nullif(F.regexp_extract("title", r"(?i)\b(\d+)\s+pages?\b", 1), F.lit("")).try_cast("int")
    return rows.select("doc_id", "page", "line_no", code.alias("code"), "title", "target_page", pages.alias("page_count"))


def merge_outline(entries: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outline and its warnings. The first mapping of a key wins; a later one that agrees may fill in the page count,
    one that doesn't is a ``conflict``; impossible pages or ranges are ``invalid_page`` or ``invalid_range``; entries
    without a page are ignored. totals: doc_id, total_pages."""
    rows = entries.where("target_page is not null").join(totals, "doc_id").withColumn("full", outline_title(F.col("code"), F.col("title")))
    rows = rows.withColumn("key", normalize_words(F.coalesce(entry_appendix(F.col("code"), F.col("title")), "full")))
    wrong = F.when((F.col("target_page") < 1) | (F.col("target_page") > F.col("total_pages")), "invalid_page").when((F.col("page_count") < 1) | (F.col("target_page") + F.col("page_count") - 1 > F.col("total_pages")), "invalid_range")
    rows = rows.withColumn("wrong", wrong)
    w = Window.partitionBy("doc_id", "key").orderBy("idx")
    good = rows.where("wrong is null").withColumn("first_page", F.first("target_page").over(w)).withColumn("same", F.col("target_page") == F.col("first_page"))
    # the page count that stands before an entry: the first one that an agreeing entry gave
    good = good.withColumn("known", F.first(F.when(F.col("same"), F.col("page_count")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    good = good.withColumn("conflict", ~F.col("same") | F.coalesce(F.col("known") != F.col("page_count"), F.lit(False)))
    last = good.where("not conflict").groupBy("doc_id", "key").agg(F.min("idx").alias("idx"), F.max_by("code", "idx").alias("code"), F.max_by("title", "idx").alias("title"), F.first("first_page").alias("target_page"), F.max("page_count").alias("page_count"))
    warnings = rows.where("wrong is not null").select("doc_id", "idx", F.col("wrong").alias("type"), "full", "target_page")
    return last.select("doc_id", "idx", "code", "title", "target_page", "page_count"), warnings.unionByName(good.where("conflict").select("doc_id", "idx", F.lit("conflict").alias("type"), "full", "target_page"))


def missing_appendices(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, code (lower case): appendices on contents lines that the outline lacks."""
    seen = lines.select("doc_id", F.lower(appendix_code(F.col("text"))).alias("code")).where("code is not null").distinct()
    return seen.join(outline.select("doc_id", F.lower(entry_appendix(F.col("code"), F.col("title"))).alias("code")), ["doc_id", "code"], "left_anti")


def appendix_ranges(outline: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, idx, title, first, last: the pages of each appendix, up to the next top-level entry or its page count."""
    rows = outline.withColumn("appendix", entry_appendix(F.col("code"), F.col("title"))).withColumn("label", outline_title(F.col("code"), F.col("title")))
    inner = F.when(F.coalesce("code", F.lit("")) != "", F.col("code")).otherwise(F.col("title")).rlike(r"^\s*(?:\d+|[A-Z])\.\d+")
    top = F.when(~inner, F.col("target_page"))
    # entries in page order, then contents order: the next top-level entry is the nearest one behind
    w = Window.partitionBy("doc_id").orderBy("target_page", "idx").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("next", F.first(top, ignorenulls=True).over(w)).join(totals, "doc_id").where("appendix is not null")
    last = F.greatest("target_page", F.coalesce("next", F.col("total_pages") + 1) - 1)
    return rows.select("doc_id", "idx", F.col("label").alias("title"), F.col("target_page").alias("first"), F.when(F.col("page_count").isNotNull(), F.least(F.col("target_page") + F.col("page_count") - 1, last)).otherwise(last).alias("last"))


def appendix_at_page(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page) with the title of the appendix they lie in: the earliest start, then contents order.

    In that order a range matters only from where all before it have ended. So ranges become intervals that don't overlap,
    and one sweep over the starts of intervals and the pages tells each page the last start before it: the work is that
    of pages plus ranges, however they nest."""
    before = Window.partitionBy("doc_id").orderBy("first", "idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("first", F.coalesce(F.max("last").over(before) + 1, "first"))
    held = ranges.select("doc_id", "idx", "title", "first", "last").withColumn("start", start).where("start <= last")
    none = F.lit(None).cast("struct<title:string,last:int>")
    marks = held.select("doc_id", F.col("start").cast("int").alias("page"), F.lit(0).alias("kind"), F.struct("title", F.col("last").cast("int").alias("last")).alias("open"))
    asked = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.lit(1).alias("kind"), none.alias("open")).distinct()
    sweep = Window.partitionBy("doc_id").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = united([marks, asked]).withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("kind = 1")
    found = seen.select("doc_id", "page", F.when(F.col("open.last") >= F.col("page"), F.col("open.title")).alias("appendix"))
    return pages.join(found, ["doc_id", "page"], "left")


def table_passages(tables: DataFrame) -> DataFrame:
    """One row per table row: table_id, row_no, passage with a ``label: cell`` line for each cell. A blank first label is
    "Row", other blank ones "Column N". tables: table_id, labels (array), rows (array of arrays)."""
    r = tables.select("table_id", "labels", F.posexplode("rows").alias("row_no", "cells"))
    named = F.transform("cells", lambda c, i: F.concat(F.coalesce(F.nullif(F.trim(F.coalesce(F.get(F.col("labels"), i), F.lit(""))), F.lit("")), F.when(i == 0, "Row").otherwise(F.concat(F.lit("Column "), (i + 1).cast("string")))), F.lit(": "), F.coalesce(c, F.lit(""))))
    return r.select("table_id", "row_no", F.array_join(named, "\n").alias("passage"))


def verified_references(chunks: DataFrame) -> DataFrame:
    """``chunks`` (text, extracted, supplied) with references: those extracted, then supplied ones found in the text."""
    kept = F.filter(F.coalesce("supplied", F.array().cast("array<string>")), lambda r: (F.trim(r) != "") & F.contains(F.lower(F.col("text")), F.lower(r)))
    return chunks.withColumn("references", F.array_distinct(F.concat(F.coalesce("extracted", F.array().cast("array<string>")), kept)))


def link_neighbors(chunks: DataFrame) -> DataFrame:
    """document_id, id, prev_id, next_id by chunk_index, only within a section or under the same first heading."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    link = lambda f: F.when((f("section_id") == F.col("section_id")) | ((f("heading") == F.col("heading")) & (F.col("heading") != "")), f("id"))
    return chunks.select("document_id", "id", link(lambda c: F.lag(c).over(w)).alias("prev_id"), link(lambda c: F.lead(c).over(w)).alias("next_id"))


def chunking_totals(parents: DataFrame, children: DataFrame) -> DataFrame:
    """document_id, sections, parents, children."""
    c = children.groupBy("document_id").agg(F.count("*").alias("children"))
    p = parents.groupBy("document_id").agg(F.countDistinct("section_id").alias("sections"), F.count("*").alias("parents"))
    return p.join(c, "document_id", "full").na.fill(0)


#: What in a page's first six lines tells a document inside the file, and the name it then gets.
HEADINGS = (
    (r"(?i)MINUTES OF (?:A )?MEETING", "Board minutes"),
    (r"(?i)(?:Office of the Chief Financial Officer|Subject:\s*Restatement)", "CFO restatement letter"),
    (r"(?i)FACTORY ACCEPTANCE TEST RECORD|FORM\s+FAT", "Factory acceptance test record"),
)
ATTACHED = r"(?i)(?:appendix|annex|exhibit|schedule|attachment|minutes|restatement)"


def document_boundaries(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, page, boundary: where a document inside the file begins, null elsewhere. In this order: the first outline
    entry that is appendix-like and points to the page, or whose code has no dot and whose title is in the first six
    lines; the extractor's flag; an appendix heading; minutes, a letter or a test record. pages: doc_id, page, text,
    is_boundary, boundary_title."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    p = pages.withColumn("head", F.array_join(F.slice(lines, 1, 6), " "))
    code, title = F.trim(F.coalesce("code", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    label = F.when((code != "") & (title != "") & ~F.startswith(F.lower(title), F.lower(code)), F.concat(code, F.lit(" - "), title)).when(title != "", title).otherwise(code)
    # what an outline is made of is long, and it is read three times
    o = stored(outline.select("doc_id", "idx", "target_page", "code", "title"), "outline").select("doc_id", "idx", "target_page", label.alias("label"), F.concat_ws(" ", "code", "title").rlike(ATTACHED).alias("attached"), F.when(~F.coalesce("code", F.lit("")).rlike(r"\d+\.\d+") & (title != ""), F.lower("title")).alias("top"))
    # by the page that an entry points to, and by its title in an index of the pages' first lines
    pointed = o.where("attached").select("doc_id", F.col("target_page").alias("page"), "idx", "label")
    heads = p.select(F.struct("doc_id", "page").alias("id"), F.col("doc_id").alias("scope"), F.lower("head").alias("text")).distinct()
    titled = o.where("top is not null").select(F.col("doc_id").alias("scope"), F.col("top").alias("pattern"), "idx", "label")
    held = postings.containing(heads, titled).join(titled, ["scope", "pattern"]).select("id.doc_id", "id.page", "idx", "label")
    first = united([pointed, held]).groupBy("doc_id", "page").agg(F.min_by("label", "idx").alias("listed"))
    flagged = F.when(F.col("is_boundary"), F.nullif(F.trim("boundary_title"), F.lit("")))
    appendix = F.nullif(F.trim(F.regexp_extract("head", r"(?i)^(?:[A-Z]\s+)?(Appendix\s+[A-Z0-9]+[\s:\-–—]+.+)", 1)), F.lit(""))
    named = [F.when(F.col("head").rlike(pattern), F.lit(name)) for pattern, name in HEADINGS]
    return p.join(first, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("listed", flagged, appendix, *named).alias("boundary"))


def extract_references(text: Column) -> Column:
    """Distinct cross-references of a text, by kind and then in order; null text has none."""

    @F.pandas_udf("array<string>")
    def found(t: pd.Series) -> pd.Series:
        return pd.Series([cross_references(x) for x in t])

    return found(text)
