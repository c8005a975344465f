"""Queries: text cleaning, hashes, page furniture and unit differences (T rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import units
from docloom.registry import query

from .tables import LINES_SQL, NEW_LINES_SQL, hash_sql, lines, new_lines, normal_sql, table


@query("t1_normalize_text", f"SELECT doc_id, sha256({normal_sql('text')}) AS normal_sha256, length({normal_sql('text')}) AS n_chars FROM documents")
def normalize(spark, sf_dir):
    normal = X.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normal, 256).alias("normal_sha256"), F.char_length(normal).cast("long").alias("n_chars"))


@query("t2_unit_hash", f"WITH {LINES_SQL} SELECT doc_id, line_no, {hash_sql('text')} AS hash FROM lines")
def unit_hashes(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", X.unit_hash(F.col("text")).alias("hash"))


@query("t2_file_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.file_hash(F.col("text").cast("binary")).alias("file_hash"))


@query("t3_chunk_hash", r"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS hash FROM documents")
def chunk_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_hash(F.col("text")).alias("hash"))


FURNITURE_SQL = rf"""keyed AS (SELECT *, regexp_replace({normal_sql('text')}, '\d+', '#', 'g') AS k FROM lines),
edges AS (SELECT doc_id, page, k FROM keyed
    QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) <= 2 OR row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) <= 2),
repeated AS (SELECT doc_id, k FROM edges JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY doc_id) USING (doc_id)
    GROUP BY doc_id, k, pages HAVING count(DISTINCT page) >= greatest(3, ceil(pages / 2))),
body AS (SELECT doc_id, page, line_no, text FROM keyed WHERE NOT regexp_matches(text, '(?i)^(page\s*)?\d{{1,4}}(\s*(of|/)\s*\d{{1,4}})?$')
    AND (doc_id, k) NOT IN (SELECT doc_id, k FROM repeated))"""


@query("t4_strip_page_furniture", f"WITH {LINES_SQL}, {FURNITURE_SQL} SELECT doc_id, page, line_no, md5(text) AS text_md5 FROM body")
def furniture(spark, sf_dir):
    return units.strip_page_furniture(lines(spark, sf_dir)).select("doc_id", "page", "line_no", F.md5("text").alias("text_md5"))


@query("t5_wide_line_length", rf"""WITH {LINES_SQL}, usable AS (SELECT doc_id, length(text) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) - 1 AS i,
    count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE NOT contains(text, chr(9)))
SELECT d.doc_id, w.wide FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN (SELECT doc_id, CAST(floor(len * 0.75) AS INT) AS wide FROM usable WHERE i = floor(n * 0.9)) w USING (doc_id)""")
def wide(spark, sf_dir):
    return units.wide_line_length(lines(spark, sf_dir))


DIFF_SQL = f"""old_units AS (SELECT doc_id, {hash_sql('text')} AS hash, count(*) AS a FROM lines GROUP BY 1, 2),
new_units AS (SELECT doc_id, {hash_sql('text')} AS hash, count(*) AS b FROM new_lines GROUP BY 1, 2),
diff AS (SELECT doc_id, CAST(sum(least(coalesce(a, 0), coalesce(b, 0))) AS BIGINT) AS same, CAST(sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0)) AS BIGINT) AS added,
    CAST(sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0)) AS BIGINT) AS removed FROM old_units FULL JOIN new_units USING (doc_id, hash) GROUP BY doc_id)"""


@query("t7_diff_units", f"WITH {LINES_SQL}, {NEW_LINES_SQL}, {DIFF_SQL} SELECT * FROM diff")
def diff(spark, sf_dir):
    old = lines(spark, sf_dir)
    return units.diff_counts(units.with_hash(old), units.with_hash(new_lines(old)))


@query("t9_demote_h1", f"""WITH {LINES_SQL}, marked AS (
    SELECT doc_id, page, line_no, CASE WHEN line_no % 6 = 0 THEN '# ' || split_part(text, ' ', 1) ELSE text END AS text,
        CASE WHEN line_no % 6 = 0 THEN split_part(text, ' ', 1) END AS h1 FROM lines),
titles AS (SELECT doc_id, arg_min(split_part(text, ' ', 1), line_no) AS title FROM lines GROUP BY doc_id),
judged AS (SELECT *, coalesce(h1 <> '' AND lower(trim(h1)) = lower(trim(title)), false) AS is_title FROM marked LEFT JOIN titles USING (doc_id)),
kept AS (SELECT *, min(CASE WHEN is_title THEN line_no END) OVER (PARTITION BY doc_id) AS first FROM judged)
SELECT doc_id, page, line_no, CASE WHEN h1 <> '' AND NOT is_title THEN '#' || text ELSE text END AS text FROM kept WHERE NOT is_title OR line_no = first""")
def demoted(spark, sf_dir):
    plain = lines(spark, sf_dir)
    word = F.split("text", " ")[0]
    marked = plain.withColumn("text", F.when(F.col("line_no") % 6 == 0, F.concat(F.lit("# "), word)).otherwise(F.col("text")))
    titles = plain.groupBy("doc_id").agg(F.min_by(word, "line_no").alias("title"))
    return units.demote_h1(marked, titles)
