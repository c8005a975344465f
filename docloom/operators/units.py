"""Text cleaning and units: page furniture, line widths, and the differences between two lists of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import furniture_key, is_page_number, trim_all, unit_hash

EDGE = 2


def strip_page_furniture(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``lines`` (doc_id, page, line_no, text) trimmed, without blanks, page numbers and lines that repeat at the edges
    of at least max(3, half) of the document's pages. Null text: dropped as blank. Pages without text count: they are
    those of blank ``lines``, or ``pages`` (doc_id, pages) says how many there are."""
    if pages is None:
        pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    lines = lines.withColumn("text", trim_all(F.col("text"))).where("text <> ''").withColumn("_key", furniture_key(F.col("text")))
    page = Window.partitionBy("doc_id", "page")
    up, down = (F.row_number().over(page.orderBy(x)) for x in (F.col("line_no"), F.col("line_no").desc()))
    edges = lines.select("doc_id", "page", "_key", F.least(up, down).alias("n")).where(F.col("n") <= EDGE)
    seen = edges.groupBy("doc_id", "_key").agg(F.countDistinct("page").alias("n"))
    repeated = seen.join(pages, "doc_id").where("n >= greatest(3, ceil(pages / 2))").select("doc_id", "_key")
    return lines.where(~is_page_number(F.col("text"))).join(repeated, ["doc_id", "_key"], "left_anti").drop("_key").select("doc_id", "page", "line_no", "text")


def wide_line_length(lines: DataFrame) -> DataFrame:
    """doc_id, wide: floor(0.75 x the line length at 90 % of the sorted lengths); lines with tabs don't count, and a
    document without others has null. Lengths are counted first, so no document is sorted line by line."""
    counted = lines.groupBy("doc_id", F.when(~F.contains("text", F.lit("\t")), F.char_length("text")).alias("len")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("doc_id")
    usable = counted.where("len is not null")
    up = usable.withColumn("upto", F.sum("n").over(whole.orderBy("len"))).withColumn("all", F.sum("n").over(whole))
    at = up.where(F.col("upto") > F.floor(F.col("all") * 0.9)).groupBy("doc_id").agg(F.floor(F.min("len") * 0.75).cast("int").alias("wide"))
    return counted.select("doc_id").distinct().join(at, "doc_id", "left")


def diff_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, same (kept or moved), added, removed: multisets of unit hashes (column hash) compared per document."""
    a = old.groupBy("doc_id", "hash").agg(F.count("*").alias("a"))
    b = new.groupBy("doc_id", "hash").agg(F.count("*").alias("b"))
    both = a.join(b, ["doc_id", "hash"], "full").na.fill(0, ["a", "b"])
    return both.groupBy("doc_id").agg(
        F.sum(F.least("a", "b")).alias("same"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed")
    )


def with_hash(units: DataFrame) -> DataFrame:
    return units.withColumn("hash", unit_hash(F.col("text")))


def demote_h1(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """First-level headings that aren't the document's title become second-level; later repeats of the title go.

    ``lines``: doc_id, page, line_no, text; ``titles``: doc_id, title. The first title heading is found by an aggregate,
    not by numbering the document's lines.
    """
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b))
    rows = lines.join(titles, "doc_id", "left").withColumn("h1", F.regexp_extract("text", r"^#\s+(.*)$", 1)).withColumn("is_title", F.coalesce((F.col("h1") != "") & same(F.col("h1"), F.col("title")), F.lit(False)))
    first = rows.where("is_title").groupBy("doc_id").agg(F.min(F.struct("page", "line_no")).alias("first"))
    rows = rows.join(first, "doc_id", "left").where(~F.col("is_title") | (F.struct("page", "line_no") == F.col("first")))
    text = F.when((F.col("h1") != "") & ~F.col("is_title"), F.concat(F.lit("#"), F.col("text"))).otherwise(F.col("text"))
    return rows.select("doc_id", "page", "line_no", text.alias("text"))
