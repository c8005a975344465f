"""Queries: sources, units, links, splits and embeddings (S, T and C rows that work on whole documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import documents as O
from docloom.operators import units
from docloom.registry import query

from .retrieval import parents
from .tables import LINES_SQL, hash_sql, lines, new_lines, stored, table
from .text import FURNITURE_SQL


#: The documents have no blank lines, so that every piece but the last is full.
@query("s2_text_sources", """SELECT doc_id, CAST(k AS INT) AS source_no, length(substr(text, k * 12000 + 1, 12000)) AS n_chars, md5(substr(text, k * 12000 + 1, 12000)) AS text_md5
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, (length(text) - 1) // 12000))) AS k FROM documents)""")
def sources(spark, sf_dir):
    return O.text_sources(table(spark, sf_dir, "documents")).select("doc_id", "source_no", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("s2_text_sources_total", "SELECT doc_id, sum(length(text)) AS n_chars, md5(string_agg(text, '')) AS text_md5 FROM documents GROUP BY doc_id")
def source_totals(spark, sf_dir):
    """The sources of a document make up its text."""
    pieces = O.text_sources(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_no", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return pieces.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


@query("s3_html_to_markdown")
def markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", O.html_to_markdown(F.col("html")).alias("markdown"))


def cleaned(spark, sf_dir):
    return units.strip_page_furniture(lines(spark, sf_dir))


#: Units in SQL: runs of lines numbered by a running count of ends, joined, split at sentence ends, labels put back.
UNITS_SQL = rf"""WITH {LINES_SQL}, {FURNITURE_SQL},
usable AS (SELECT doc_id, length(text) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM body WHERE NOT contains(text, chr(9))),
wide AS (SELECT doc_id, CAST(floor(len * 0.75) AS INT) AS wide FROM usable WHERE i = floor(n * 0.9)),
marked AS (SELECT body.*, contains(text, chr(9)) AS is_row, length(text) < coalesce(wide, 1000000000) OR contains('.?!:;', right(text, 1)) OR contains(text, chr(9)) AS ends FROM body LEFT JOIN wide USING (doc_id)),
numbered AS (SELECT *, coalesce(sum(CAST(ends OR coalesce(next_row, false) AS INT)) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
    FROM (SELECT *, lead(is_row) OVER (PARTITION BY doc_id ORDER BY page, line_no) AS next_row FROM marked)),
runs AS (SELECT doc_id, run, min(page) AS page, bool_or(is_row) AS is_row, rtrim(string_agg(CASE WHEN is_row THEN replace(text, chr(9), ' | ') WHEN regexp_matches(text, '[A-Za-z]-$') THEN text ELSE text || ' ' END, '' ORDER BY page, line_no)) AS whole FROM numbered GROUP BY 1, 2),
split AS (SELECT *, CASE WHEN is_row THEN [whole] ELSE string_split(list_reduce(string_split(regexp_replace(whole, '([.?!])\s+([A-Z0-9("“])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda a, b: a || CASE WHEN regexp_matches(regexp_extract(a, '[^' || chr(1) || ']*$'), '^\d+(\.\d+)*\.$') THEN ' ' ELSE chr(1) END || b), chr(1)) END AS parts FROM runs),
units AS (SELECT doc_id, run, page, CASE WHEN is_row THEN 'row' WHEN len(parts) > 1 OR contains('.?!', right(whole, 1)) THEN 'sentence' ELSE 'line' END AS kind, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM split),
clean AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM units)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, i) - 1 AS INT) AS position, kind, text, page, {hash_sql('text')} AS hash FROM clean WHERE text <> ''"""


@query("t6_build_units", UNITS_SQL)
def built(spark, sf_dir):
    rows = stored(cleaned(spark, sf_dir), "cleaned-lines")
    return O.build_units(rows, units.wide_line_length(rows))


@query("t7_kept_and_moved")
def moved(spark, sf_dir):
    old = lines(spark, sf_dir)
    numbered = lambda df: stored(units.with_hash(df).select("doc_id", F.col("line_no").alias("position"), "hash"), "unit-hashes")
    a, b = numbered(old), numbered(new_lines(old))
    return O.diff_moved(a, b, units.diff_counts(a, b))


@query("t8_link_units")
def linked(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("position"), "page", "text")
    chunks = parents(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.col("id").alias("chunk_id"), "chunk_index", "source_pages", "text")
    return O.link_units(rows, chunks)


@query("t10_summary_batches")
def batches(spark, sf_dir):
    return O.summary_batches(table(spark, sf_dir, "documents"), 500).select("doc_id", "batch_no", F.char_length("text").alias("n_chars"))


@query("t11_recursive_split")
def split(spark, sf_dir):
    return O.parent_child_split(table(spark, sf_dir, "documents")).select("doc_id", "parent_no", "chunk_no", F.char_length("text").alias("n_chars"))


@query("c7_token_guard", r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) + 2 AS tokens FROM documents WHERE len(regexp_extract_all(text, '\S+')) + 2 > 256")
def guarded(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("search_text"))
    return O.token_guard(chunks)[1].select("doc_id", F.col("tokens").cast("long").alias("tokens"))


@query("c8_embed")
def embedded(spark, sf_dir):
    chunks = parents(spark, sf_dir).select("id", F.col("text").alias("search_text"))
    return O.embed(chunks).select("id", "embedding")
