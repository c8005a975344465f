"""Whole-document steps: HTML to Markdown, text sources, units and their links, summary batches and character splits.

A document's lines are brought together by a shuffle on doc_id; a task holds one document's lines at a time. Steps that
need only a row's own text stay where the row is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import folds
from docloom.functions.text import collapse, trim_all, unit_hash



def text_sources(docs: DataFrame, most: int = 12_000) -> DataFrame:
    """doc_id, source_no, text: ordered pieces of each text; an empty or null text is one empty source."""

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series) -> pd.Series:
        return t.fillna("").map(lambda x: folds.text_sources(x, most))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("source_no", "text"))


def html_to_markdown(html: Column) -> Column:
    """Markdown of an HTML column; null gives empty text."""

    @F.pandas_udf("string")
    def turn(h: pd.Series) -> pd.Series:
        return h.map(folds.html_to_markdown)

    return turn(html)


#: Where a sentence ends, and a number that goes with the sentence after it.
SENTENCE_END, LABEL = r"""(?<=[.?!])\s+(?=[A-Z0-9("“])""", r"(^|\x01)(\d+(?:\.\d+)*\.)\x01([^\x01]*)"


def build_units(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """doc_id, position, kind, text, page, hash: the units of each document. lines: doc_id, page, line_no, text; widths:
    doc_id, wide (null: no line is).

    A line ends its unit if it is short, ends a sentence, or is a row (has tabs), or if a row follows: units are the runs
    between such ends, numbered by a running count. A run's lines are joined, without a blank after a hyphen, and split
    into sentences."""
    rows = lines.join(widths, "doc_id", "left")
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    row = F.contains("text", F.lit("\t"))
    ends = (F.char_length("text") < F.coalesce("wide", F.lit(1 << 30))) | F.right("text", F.lit(1)).isin(*".?!:;")
    rows = rows.withColumns({"row": row, "ends": row | ends | F.coalesce(F.lead(row).over(order), F.lit(False))})
    run = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.when(F.col("row"), F.replace("text", F.lit("\t"), F.lit(" | "))).otherwise(F.concat("text", F.when(F.col("text").rlike("[A-Za-z]-$"), "").otherwise(" ")))
    runs = rows.select("doc_id", run.alias("run"), "page", "line_no", part.alias("part"), "row").groupBy("doc_id", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "part"))), lambda x: x["part"]), "").alias("whole"), F.min("page").alias("page"), F.bool_or("row").alias("row")
    )
    # sentences between marks; a number and the sentence after it are one, in time of the text's length
    marked = F.array_join(F.split(F.regexp_replace("whole", " $", ""), SENTENCE_END), "\x01")
    joined = F.split(F.regexp_replace(marked, LABEL, "$1$2 $3"), "\x01")
    runs = runs.withColumn("parts", F.when(F.col("row"), F.array("whole")).otherwise(joined))
    sentence = (F.size("parts") > 1) | F.right(trim_all(F.col("whole")), F.lit(1)).isin(*".?!")
    kind = F.when(F.col("row"), "row").when(sentence, "sentence").otherwise("line")
    units = runs.select("doc_id", "run", "page", kind.alias("kind"), F.posexplode("parts").alias("i", "text")).withColumn("text", collapse(F.col("text"))).where("text <> ''")
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "i")) - 1
    return units.select("doc_id", position.alias("position"), "kind", "text", "page", unit_hash(F.col("text")).alias("hash"))


def diff_moved(old: DataFrame, new: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` (of units.diff_counts) with kept and moved in place of same. Documents without any added or removed unit
    and equal order still need the comparison only if they changed at all. A document's hashes are one row of either side."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "hash"))), lambda x: x["hash"])
    a, b = (df.groupBy("doc_id").agg(listed.alias(n)) for df, n in ((old, "_a"), (new, "_b")))

    @F.pandas_udf("long")
    def in_order(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([folds.kept_in_order(list(m), list(n)) for m, n in zip(x, y)], dtype="int64")

    kept = a.join(b, "doc_id").where("_a <> _b").select("doc_id", in_order("_a", "_b").alias("kept"))
    found = counts.join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", "same"))
    return found.select("doc_id", "kept", (F.col("same") - F.col("kept")).alias("moved"), "added", "removed")


def link_units(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, position, chunk_id of each unit: the chunk on its page that holds it, tried from the last unit's chunk onwards
    and then from the start. units: doc_id, position, page, text; chunks: doc_id, chunk_id, chunk_index, source_pages, text.

    A page's units and its chunks are one row each, so every text goes to Python once a page. What depends on reading order,
    the last hit, is a fold over the numbers of chunks that hold each unit, without any text."""

    @F.pandas_udf("array<array<int>>")
    def held(units: pd.Series, chunks: pd.Series, numbers: pd.Series) -> pd.Series:
        found = []
        for u, c, n in zip(units, chunks, numbers):
            places = [] if c is None else [(int(k), folds.word_places(x)) for k, x in zip(n, c)]
            found.append([[k for k, p in places if w and folds.holds(w, p)] for w in map(folds.match_words, u)])
        return pd.Series(found)

    @F.pandas_udf("array<int>")
    def followed(numbers: pd.Series) -> pd.Series:
        return numbers.map(folds.follow)

    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")) - 1
    numbered = chunks.select("doc_id", "chunk_id", number.alias("number"), "source_pages", F.coalesce("text", F.lit("")).alias("chunk"))
    rows = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    near = numbered.select("doc_id", "number", "chunk", F.explode(F.array_distinct("source_pages")).alias("page")).groupBy("doc_id", "page").agg(rows("number", "chunk").alias("near"))
    pages = units.select("doc_id", F.col("position").cast("int").alias("position"), "page", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id", "page").agg(rows("position", "text").alias("own"))
    met = pages.join(near, ["doc_id", "page"], "left").select("doc_id", F.col("own.position").alias("position"), held("own.text", "near.chunk", "near.number").alias("numbers"))
    hits = met.select("doc_id", F.inline(F.arrays_zip("position", "numbers"))).groupBy("doc_id").agg(rows("position", "numbers").alias("read"))
    read = hits.select("doc_id", F.col("read.position").alias("position"), followed("read.numbers").alias("number"))
    read = read.select("doc_id", F.inline(F.arrays_zip("position", "number")))
    numbered = numbered.select("doc_id", "chunk_id", "number")
    return read.join(numbered, ["doc_id", "number"], "left").select("doc_id", "position", "chunk_id")


def word_count(text: str) -> int:
    return len(text.split())


def summary_batches(docs: DataFrame, most: int = 5_000, count=word_count) -> DataFrame:
    """doc_id, batch_no, text: paragraphs packed for summaries. ``count`` gives a text's tokens."""

    @F.pandas_udf("array<string>")
    def pack(t: pd.Series) -> pd.Series:
        return t.fillna("").map(lambda x: folds.summary_batches(x, most, count))

    return docs.select("doc_id", F.posexplode(pack("text")).alias("batch_no", "text"))


def recursive_split(docs: DataFrame, size: int, overlap: int, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The id columns, chunk_no and text: chunks of at most ``size`` characters with ``overlap``."""

    @F.pandas_udf("array<string>")
    def split(t: pd.Series) -> pd.Series:
        return t.fillna("").map(lambda x: folds.recursive_split(x, size, overlap))

    return docs.select(*id_columns, F.posexplode(split("text")).alias("chunk_no", "text"))


def parent_child_split(docs: DataFrame) -> DataFrame:
    """doc_id, parent_no, chunk_no, text: children of 400 characters (overlap 50) in parents of 1,200 (overlap 200)."""
    parents = recursive_split(docs, 1_200, 200).withColumnRenamed("chunk_no", "parent_no")
    return recursive_split(parents, 400, 50, ("doc_id", "parent_no"))


def token_guard(chunks: DataFrame, limit: int = 256, special: int = 2) -> tuple[DataFrame, DataFrame]:
    """Chunks within the token limit, and those over it as error rows; nothing is cut. Tokens: words plus specials."""
    n = F.regexp_count(F.coalesce("search_text", F.lit("")), F.lit(r"\S+")) + special
    rows = chunks.withColumn("tokens", n.cast("int"))
    return rows.where(F.col("tokens") <= limit), rows.where(F.col("tokens") > limit)


def embed(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """``chunks`` with a unit-length embedding of search_text: a hashed bag of words, the default encoder where no model
    files are at hand. A word adds to two places with signs of its own; where a text's words cancel out, the hash of all its
    words names one place. Texts without words have null."""
    import numpy as np

    def vector(words: list[str]) -> np.ndarray:
        h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        places = np.concatenate([h % dim, (h // dim) % dim])
        v = np.bincount(places, np.concatenate([h >> 31, (h >> 30) & 1]) * 2.0 - 1, dim)
        if not v.any():
            v[zlib.crc32(" ".join(words).encode()) % dim] = 1
        return (v / np.linalg.norm(v)).astype(np.float32)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            listed = texts.fillna("").map(folds.match_words)
            yield pd.Series([vector(w) if w else None for w in listed])

    return chunks.withColumn("embedding", encode("search_text"))
