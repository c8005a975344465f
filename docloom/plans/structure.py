"""Queries: document structure (D rows, C5 and C6). Contents lists are made of the first words of all lines of a document,
which has as many pages as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import is_toc_chunk
from docloom.operators import structure as D
from docloom.registry import query

from .retrieval import BASE as RETRIEVAL
from .retrieval import children, parents
from .tables import LINES_SQL, lines, table, trim_as_sql


def contents(spark, sf_dir):
    """The lines of each document as contents lines of four kinds."""
    n, w = F.col("line_no"), F.regexp_extract("text", "^[^ .,]+", 0)
    k = F.floor(n / 4).cast("int")
    letter = F.char(F.lit(65) + k % 26)
    text = (
        F.when(n % 4 == 0, F.concat(F.lit("Appendix "), letter, F.lit(" - "), w, F.lit(" ..... "), (n + 1).cast("string")))
        .when(n % 4 == 1, F.concat(F.lit("- 1."), n.cast("string"), F.lit(" "), w, F.lit(" (2 pages) . . . . "), n.cast("string")))
        .when(n % 4 == 2, F.concat(F.lit("| **Annexure "), letter, F.lit("** "), w, F.lit(" ...... "), (n * 3).cast("string")))
        .otherwise(F.concat(F.lit("## "), w))
    )
    rows = lines(spark, sf_dir)
    return rows.select("doc_id", "page", "line_no", text.alias("text"))


CONTENTS = f"""{LINES_SQL}, kinds AS (SELECT doc_id, page, line_no, regexp_extract(text, '^[^ .,]+') AS w, chr(65 + line_no // 4 % 26) AS letter FROM lines),
contents AS (SELECT doc_id, page, line_no, CASE line_no % 4 WHEN 0 THEN 'Appendix ' || letter || ' - ' || w || ' ..... ' || (line_no + 1)
    WHEN 1 THEN '- 1.' || line_no || ' ' || w || ' (2 pages) . . . . ' || line_no WHEN 2 THEN '| **Annexure ' || letter || '** ' || w || ' ...... ' || (line_no * 3) ELSE '## ' || w END AS text FROM kinds),
cleaned AS (SELECT doc_id, page, line_no, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\s*#{{1,6}}\\s+', ''), '^\\s*[-*]\\s+', ''), '^\\s*\\|\\s*', ''), '\\*\\*', '', 'g')) AS t FROM contents),
entries AS (SELECT doc_id, page, line_no, coalesce(nullif(regexp_replace(regexp_extract(title, '{D.APPENDIX}', 1), '[\\s-]+', ' ', 'g'), ''), regexp_extract(title, '^(\\d+(?:\\.\\d+)*)\\s+', 1)) AS code,
    title, target_page, CAST(nullif(regexp_extract(title, '(?i)\\b(\\d+)\\s+pages?\\b', 1), '') AS INT) AS page_count FROM (
    SELECT doc_id, page, line_no, trim(regexp_extract(t, '^(.+?)\\s*(?:\\.\\s*){{3,}}(\\d+)\\s*$', 1)) AS title, CAST(nullif(regexp_extract(t, '^(.+?)\\s*(?:\\.\\s*){{3,}}(\\d+)\\s*$', 2), '') AS INT) AS target_page FROM cleaned) WHERE title <> '')"""


WHOLE = f"""{CONTENTS},
totals AS (SELECT doc_id, max(line_no) + 1 AS total FROM lines GROUP BY doc_id),
possible AS (SELECT entries.*, total FROM entries JOIN totals USING (doc_id) WHERE target_page BETWEEN 1 AND total)"""


def entries(spark, sf_dir):
    return D.parse_contents_lines(contents(spark, sf_dir)).withColumnRenamed("line_no", "idx")


def totals(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg((F.max("line_no") + 1).alias("total_pages"))


@query("d2_contents_pages", rf"""WITH {LINES_SQL}, pages AS (SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN '# Contents' || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY line_no) AS text, page = 2 AS is_toc FROM lines GROUP BY doc_id, page)
SELECT doc_id, page FROM pages WHERE is_toc OR regexp_matches(text, '(?im)^(?:#{{1,6}}\s+)?(?:Table of Contents|Contents)\s*$')""")
def contents_pages(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    pages = lines(spark, sf_dir).groupBy("doc_id", "page").agg(text.alias("text"))
    pages = pages.select("doc_id", "page", F.concat(F.when(F.col("doc_id") % 3 == 0, "# Contents\n").otherwise(""), "text").alias("text"), (F.col("page") == 2).alias("is_toc"))
    return D.contents_pages(pages).select("doc_id", "page")


@query("d3_contents_lines", f"WITH {WHOLE} SELECT * FROM entries")
def contents_lines(spark, sf_dir):
    return D.parse_contents_lines(contents(spark, sf_dir))


@query("d4_merge_outline", f"""WITH {WHOLE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(code) ORDER BY line_no) AS k FROM possible)
SELECT doc_id, line_no AS idx, code, title, target_page, page_count FROM ranked WHERE (page_count IS NULL OR target_page + page_count - 1 <= total) AND (k = 1 OR NOT regexp_matches(code, '(?i)^(appendix|annex)'))""")
def outline(spark, sf_dir):
    return D.merge_outline(entries(spark, sf_dir), totals(spark, sf_dir))[0]


@query("d4_outline_warnings", f"""WITH {WHOLE} SELECT doc_id, line_no AS idx, 'invalid_page' AS type, target_page FROM entries JOIN totals USING (doc_id) WHERE target_page < 1 OR target_page > total
UNION ALL SELECT doc_id, line_no, 'invalid_range', target_page FROM possible WHERE target_page + page_count - 1 > total
UNION ALL SELECT doc_id, line_no, 'conflict', target_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(code) ORDER BY line_no) AS k FROM possible WHERE regexp_matches(code, '(?i)^(appendix|annex)')) WHERE k > 1""")
def outline_warnings(spark, sf_dir):
    return D.merge_outline(entries(spark, sf_dir), totals(spark, sf_dir))[1].select("doc_id", "idx", "type", "target_page")


@query("d5_missing_appendices", f"""WITH {WHOLE} SELECT DISTINCT doc_id, lower(regexp_replace(regexp_extract(t, '{D.APPENDIX}', 1), '[\\s-]+', ' ', 'g')) AS code FROM cleaned
    WHERE line_no % 8 <> 0 AND regexp_matches(t, '{D.APPENDIX}') EXCEPT SELECT doc_id, lower(code) FROM entries WHERE line_no % 8 <> 4""")
def missing(spark, sf_dir):
    return D.missing_appendices(contents(spark, sf_dir).where("line_no % 8 <> 0"), entries(spark, sf_dir).where("idx % 8 <> 4"))


#: The next top-level entry by a window, since documents are long.
RANGES = r"""ranges AS (SELECT doc_id, idx, title, first, greatest(first, coalesce(next, total + 1) - 1) AS last FROM (
    SELECT doc_id, line_no AS idx, code, title, target_page AS first, total, first_value(CASE WHEN NOT regexp_matches(CASE WHEN code <> '' THEN code ELSE title END, '^\s*(?:\d+|[A-Z])\.\d+') THEN target_page END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY target_page, line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM possible) WHERE regexp_matches(code, '(?i)^(appendix|annex)'))"""


def possible(spark, sf_dir):
    return entries(spark, sf_dir).join(totals(spark, sf_dir), "doc_id").where("target_page between 1 and total_pages").drop("total_pages")


@query("d6_appendix_ranges", f"WITH {WHOLE}, {RANGES} SELECT * FROM ranges")
def ranges(spark, sf_dir):
    return D.appendix_ranges(possible(spark, sf_dir), totals(spark, sf_dir))


@query("d6_appendix_at_page", f"""WITH {WHOLE}, {RANGES}, pages AS (SELECT doc_id, unnest(generate_series(1, total)) AS page FROM totals)
SELECT p.doc_id, CAST(page AS INT) AS page, arg_min(title, (first, idx)) AS appendix FROM pages p LEFT JOIN ranges r ON r.doc_id = p.doc_id AND page BETWEEN first AND last GROUP BY 1, 2""")
def at_page(spark, sf_dir):
    pages = totals(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    return D.appendix_at_page(pages, D.appendix_ranges(possible(spark, sf_dir), totals(spark, sf_dir)))


BOUNDARIES = rf"""ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(code) ORDER BY line_no) AS k FROM possible),
outline AS (SELECT doc_id, line_no AS idx, trim(code) AS code, trim(title) AS title, target_page FROM ranked WHERE (page_count IS NULL OR target_page + page_count - 1 <= total) AND (k = 1 OR NOT regexp_matches(code, '(?i)^(appendix|annex)'))),
o AS (SELECT *, CASE WHEN code <> '' AND title <> '' AND NOT starts_with(lower(title), lower(code)) THEN code || ' - ' || title WHEN title <> '' THEN title ELSE code END AS label,
    regexp_matches(code || ' ' || title, '{D.ATTACHED}') AS attached, CASE WHEN NOT regexp_matches(code, '\d+\.\d+') AND title <> '' THEN lower(title) END AS top FROM outline),
heads AS (SELECT doc_id, CAST(line_no + 1 AS INT) AS page, CASE line_no % 5 WHEN 1 THEN 'Minutes of a meeting ' WHEN 2 THEN 'Form FAT ' WHEN 3 THEN 'Appendix Q: notes ' ELSE '' END || text AS head, line_no % 7 = 6 AS flagged FROM lines),
hits AS (SELECT p.doc_id, page, arg_min(label, idx) AS listed FROM heads p JOIN o ON o.doc_id = p.doc_id AND ((attached AND target_page = page) OR contains(lower(head), top)) GROUP BY 1, 2)
SELECT p.doc_id, page, coalesce(listed, CASE WHEN flagged THEN 'Part' END, nullif(trim(regexp_extract(head, '(?i)^(?:[A-Z]\s+)?(Appendix\s+[A-Z0-9]+[\s:\-–—]+.+)', 1)), ''),
    {", ".join(f"CASE WHEN regexp_matches(head, '{pattern}') THEN '{name}' END" for pattern, name in D.HEADINGS)}) AS boundary FROM heads p LEFT JOIN hits USING (doc_id, page)"""


@query("d7_document_boundaries", f"WITH {WHOLE}, {BOUNDARIES}")
def boundaries(spark, sf_dir):
    n = F.col("line_no")
    heads = F.when(n % 5 == 1, "Minutes of a meeting").when(n % 5 == 2, "Form FAT").when(n % 5 == 3, "Appendix Q: notes").otherwise("")
    pages = lines(spark, sf_dir).select("doc_id", (n + 1).alias("page"), F.concat(heads, F.lit("\n"), "text").alias("text"), (n % 7 == 6).alias("is_boundary"), F.lit(" Part ").alias("boundary_title"))
    return D.document_boundaries(pages, D.merge_outline(entries(spark, sf_dir), totals(spark, sf_dir))[0])


@query("d10_table_passages", """SELECT o_orderkey AS table_id, row_no, passage FROM (SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS row_no,
    'Row: ' || l_partkey || chr(10) || 'Supplier: ' || l_suppkey || chr(10) || 'Column 3: ' || l_linenumber AS passage FROM lineitem)""")
def passages(spark, sf_dir):
    row = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.array(x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"), x["l_linenumber"].cast("string")))
    tables = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(row.alias("rows")).withColumn("labels", F.array(F.lit(" "), F.lit("Supplier")))
    return D.table_passages(tables)


@query("d11_toc_chunks", rf"""WITH {WHOLE}, chunks AS (SELECT doc_id, line_no // 4 AS part, string_agg(text, chr(10) ORDER BY line_no) AS text FROM contents WHERE line_no % 4 <> 3 GROUP BY 1, 2)
SELECT doc_id, part, (doc_id % 4 = 1 AND part = 2) OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\.{{3,}}|\. \. \.') AND regexp_matches(x, '\d+\s*$'))) >= 3 AS is_toc FROM chunks""")
def toc_chunks(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    chunks = contents(spark, sf_dir).where("line_no % 4 <> 3").groupBy("doc_id", F.floor(F.col("line_no") / 4).alias("part")).agg(text.alias("text"))
    path = F.when((F.col("doc_id") % 4 == 1) & (F.col("part") == 2), F.array(F.lit("Front"), F.lit("Table of Contents"))).otherwise(F.array(F.lit("Body")))
    return chunks.select("doc_id", "part", is_toc_chunk(path, F.col("text")).alias("is_toc"))


def verified(rows, letters):
    """References of lines: one that is extracted, and of those supplied the ``letters`` in capitals and one that no line has."""
    rows = rows.select("doc_id", "line_no", "text", F.array(F.lit("§1")).alias("extracted"), F.array(F.upper(letters), F.lit("nowhere to be found")).alias("supplied"))
    return D.verified_references(rows).select("doc_id", "line_no", F.array_sort("references").alias("refs"))


@query("d13_verified_references", f"""WITH {LINES_SQL} SELECT doc_id, line_no, list_sort(list_distinct(['§1'] || list_filter([upper(left(text, 3)), 'nowhere to be found'], lambda r: contains(lower(text), lower(r))))) AS refs FROM lines WHERE regexp_matches(text, '^[A-Za-z]{{3}}')""")
def references(spark, sf_dir):
    return verified(lines(spark, sf_dir, trim_as_sql).where(F.col("text").rlike("^[A-Za-z]{3}")), F.substring("text", 1, 3))


@query("d13_verified_references_whole", f"""WITH {LINES_SQL} SELECT doc_id, line_no, list_sort(list_distinct(['§1'] || list_filter([upper(regexp_extract(text, '[A-Za-z]{{3}}')), 'nowhere to be found'], lambda r: r <> '' AND contains(lower(text), lower(r))))) AS refs FROM lines""")
def references_whole(spark, sf_dir):
    """All lines, with their first three letters in a row wherever these stand; some lines have none."""
    return verified(lines(spark, sf_dir, trim_as_sql), F.regexp_extract("text", "[A-Za-z]{3}", 0))


@query("c5_link_neighbors", f"""WITH {RETRIEVAL} SELECT document_id, id, CASE WHEN lag(section_id) OVER w = section_id OR lag(chapter) OVER w = chapter THEN lag(id) OVER w END AS prev_id,
    CASE WHEN lead(section_id) OVER w = section_id OR lead(chapter) OVER w = chapter THEN lead(id) OVER w END AS next_id FROM parents WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, id)""")
def neighbors(spark, sf_dir):
    return D.link_neighbors(parents(spark, sf_dir).select("document_id", "id", "chunk_index", "section_id", F.col("chapter").cast("string").alias("heading")))


@query("c6_chunking_totals", f"""WITH {RETRIEVAL}, c AS (SELECT document_id, count(*) AS children FROM kids GROUP BY 1), p AS (SELECT document_id, count(DISTINCT section_id) AS sections, count(*) AS parents FROM parents GROUP BY 1)
SELECT document_id, coalesce(sections, 0) AS sections, coalesce(parents, 0) AS parents, coalesce(children, 0) AS children FROM p FULL JOIN c USING (document_id)""")
def chunk_totals(spark, sf_dir):
    return D.chunking_totals(parents(spark, sf_dir), children(spark, sf_dir).where("removed_in is null and not is_toc"))


@query("d12_cross_references")
def cross_references(spark, sf_dir):
    n = F.col("line_no")
    said = F.when(n % 5 == 0, " see Sections 1 and 3.").when(n % 5 == 1, " Figures 3.1 to 3.4 and VEN-033").when(n % 5 == 2, F.concat(F.lit(" per Appendix B and Resolution No. "), n.cast("string"))).otherwise("")
    return lines(spark, sf_dir).select("doc_id", "line_no", D.extract_references(F.concat("text", said)).alias("refs")).where("size(refs) > 0")
