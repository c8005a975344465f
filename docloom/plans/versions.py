"""Queries: delta versioning (V rows). Parents are four lines of a document, children its lines; the new version is made
from the old by the edits of ``tables.new_lines``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import chunk_hash, file_hash, unit_hash
from docloom.operators import documents, units
from docloom.operators import versioning as V
from docloom.registry import query

from .tables import LINES_SQL, NEW_LINES_SQL, hash_sql, lines, new_lines, stored, table
from .text import DIFF_SQL

NEW = 5_000_000_000


def _parents(rows, base: int):
    part = F.floor(F.col("line_no") / 4)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    p = rows.groupBy("doc_id", part.alias("chunk_index")).agg(text.alias("text"))
    key = F.col("doc_id") * 10_000 + F.col("chunk_index") + base
    return p.select(F.col("doc_id").alias("document_id"), key.alias("id"), "text", "chunk_index", chunk_hash(F.col("text")).alias("content_hash"), (key - 1).alias("prev_id"), (key + 1).alias("next_id"), F.when(F.col("chunk_index") >= 2, F.concat(F.lit("Part "), F.floor(F.col("chunk_index") / 2).cast("string"))).alias("section"))


def _children(rows, base: int):
    n, d = F.col("line_no"), F.col("doc_id")
    context = F.concat(F.when((d % 5 == 0) & F.lit(base > 0), "new title: ").otherwise("title: "), "text")
    return rows.select((d * 100_000 + n + base).alias("id"), (d * 10_000 + F.floor(n / 4) + base).alias("parent_id"), n.alias("chunk_index"), chunk_hash(F.col("text")).alias("content_hash"), chunk_hash(context).alias("context_hash"))


def versions(spark, sf_dir):
    old = lines(spark, sf_dir)
    new = new_lines(old)
    a, b = _parents(old, 0), _parents(new, NEW)
    plan = V.plan_parents(a, b)
    return a, b, plan, V.plan_children(plan, _children(old, 0), _children(new, NEW))


SPACED = lambda c: f"substr(sha256(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), 1, 16)"
_P = lambda src, base: f"SELECT doc_id AS document_id, doc_id * 10000 + k + {base} AS id, text, k AS chunk_index, {SPACED('text')} AS content_hash, CASE WHEN k >= 2 THEN 'Part ' || (k // 2) END AS section, row_number() OVER (PARTITION BY doc_id, {SPACED('text')} ORDER BY k) AS n FROM (SELECT doc_id, line_no // 4 AS k, string_agg(text, chr(10) ORDER BY line_no) AS text FROM {src} GROUP BY 1, 2)"
_C = lambda src, base, title: f"SELECT doc_id * 100000 + line_no + {base} AS id, doc_id * 10000 + line_no // 4 + {base} AS parent_id, line_no AS chunk_index, {SPACED('text')} AS content_hash, {SPACED(title + ' || text')} AS context_hash FROM {src}"
BASE = f"""{LINES_SQL}, {NEW_LINES_SQL},
a AS ({_P('lines', 0)}), b AS ({_P('new_lines', NEW)}),
plan AS (SELECT document_id, a.id AS old_id, b.id AS new_id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'kept' END AS action FROM a FULL JOIN b USING (document_id, content_hash, n)),
kept AS (SELECT old_id, new_id FROM plan WHERE action = 'kept'),
ca AS (SELECT *, parent_id AS parent, row_number() OVER (PARTITION BY parent_id, content_hash ORDER BY chunk_index, id) AS n FROM ({_C('lines', 0, "'title: '")})),
cb AS (SELECT *, row_number() OVER (PARTITION BY parent, content_hash ORDER BY chunk_index, id) AS n FROM (SELECT c.*, coalesce(old_id, parent_id) AS parent FROM ({_C('new_lines', NEW, "CASE WHEN doc_id % 5 = 0 THEN 'new title: ' ELSE 'title: ' END")}) c LEFT JOIN kept ON kept.new_id = c.parent_id)),
kids AS (SELECT ca.id AS old_id, cb.id AS new_id, parent AS parent_id, CASE WHEN ca.id IS NULL THEN 'added' WHEN cb.id IS NULL THEN 'removed' ELSE 'kept' END AS action,
    ca.id IS NULL OR (cb.id IS NOT NULL AND ca.context_hash <> cb.context_hash) AS reembed FROM ca FULL JOIN cb USING (parent, content_hash, n)),
after AS (SELECT a.document_id, a.id, coalesce(b.text, a.text) AS text, coalesce(b.chunk_index, a.chunk_index) AS chunk_index, 1 AS added_in, CASE WHEN p.action = 'removed' AND a.document_id % 6 > 0 THEN 2 END AS removed_in
    FROM a JOIN plan p ON p.old_id = a.id LEFT JOIN b ON b.id = p.new_id AND a.document_id % 6 > 0
    UNION ALL SELECT b.document_id, b.id, b.text, b.chunk_index, 2, NULL FROM b JOIN plan p ON p.new_id = b.id WHERE action = 'added' AND b.document_id % 6 > 0)"""


@query("v1_change_gate", f"""WITH {LINES_SQL}, {NEW_LINES_SQL}, {DIFF_SQL} SELECT d.doc_id AS document_id,
    CASE WHEN d.doc_id % 4 = 0 THEN 'same_file' WHEN added = 0 AND removed = 0 THEN 'same_text' ELSE 'changed' END AS verdict, same, added, removed FROM documents d LEFT JOIN diff USING (doc_id)""")
def gate(spark, sf_dir):
    docs, old = table(spark, sf_dir, "documents"), lines(spark, sf_dir)
    h = file_hash(F.col("text").cast("binary"))
    uploads = docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 == 0, h).otherwise(F.lit("new")).alias("file_hash"))
    diff = units.diff_counts(units.with_hash(old), units.with_hash(new_lines(old)))
    return V.change_gate(uploads, docs.select(F.col("doc_id").alias("id"), h.alias("file_hash")), diff)


@query("v1_change_gate_moved")
def gate_moved(spark, sf_dir):
    """The gate with kept and moved units; every ninth document has its lines in reverse."""
    hashed = stored(units.with_hash(lines(spark, sf_dir)).select("doc_id", "line_no", "hash"), "unit-hashes")
    old = hashed.withColumn("position", F.col("line_no"))
    new = hashed.where("doc_id % 3 > 0 or line_no > 0").withColumn("position", F.when(F.col("doc_id") % 9 == 0, -F.col("line_no")).otherwise(F.col("line_no")))
    diff = documents.diff_moved(old, new, units.diff_counts(old, new))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("new").alias("file_hash"))
    return V.change_gate(docs, docs.select(F.col("document_id").alias("id"), F.lit("old").alias("file_hash")), diff)


@query("v2_plan_parents", f"WITH {BASE} SELECT * FROM plan")
def plan_parents(spark, sf_dir):
    return versions(spark, sf_dir)[2]


@query("v3_plan_children", f"WITH {BASE} SELECT * FROM kids")
def plan_children(spark, sf_dir):
    return versions(spark, sf_dir)[3]


@query("v4_remap_links", f"""WITH {BASE} SELECT coalesce(k.old_id, b.id) AS id, coalesce(p.old_id, b.id - 1) AS prev_id, coalesce(q.old_id, b.id + 1) AS next_id
    FROM b LEFT JOIN kept k ON k.new_id = b.id LEFT JOIN kept p ON p.new_id = b.id - 1 LEFT JOIN kept q ON q.new_id = b.id + 1""")
def links(spark, sf_dir):
    _, b, plan, _ = versions(spark, sf_dir)
    return V.remap_links(b.select("id", "prev_id", "next_id"), plan)


def applied(spark, sf_dir):
    a, b, plan, _ = versions(spark, sf_dir)
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 6 == 0, 3).otherwise(2).alias("version"), F.lit(1).alias("current_version"))
    current = a.select("document_id", "id", "text", "chunk_index", F.lit(1).alias("added_in"), F.lit(None).cast("int").alias("removed_in"))
    return V.apply_version(current, b.select("document_id", "id", "text", "chunk_index"), plan, wanted)


@query("v5_apply_version", f"WITH {BASE} SELECT document_id, id, md5(text) AS text_md5, chunk_index, added_in, removed_in FROM after")
def apply(spark, sf_dir):
    return applied(spark, sf_dir).select("document_id", "id", F.md5("text").alias("text_md5"), "chunk_index", "added_in", "removed_in")


def wanted(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("document_id"), F.when(d % 6 == 0, 3).otherwise(2).alias("version"), F.lit(1).alias("current_version"))


@query("v5_apply_children", f"""WITH {BASE}, texts AS (SELECT doc_id, line_no, text FROM lines), news AS (SELECT doc_id, line_no, CASE WHEN doc_id % 5 = 0 THEN 'new title: ' ELSE 'title: ' END || text AS text FROM new_lines)
SELECT t.doc_id AS document_id, k.old_id AS id, t.doc_id * 10000 + t.line_no // 4 AS parent_id, md5(CASE WHEN k.reembed AND t.doc_id % 6 > 0 THEN n.text ELSE 'title: ' || t.text END) AS text_md5,
    CASE WHEN k.action = 'kept' AND t.doc_id % 6 > 0 THEN n.line_no ELSE t.line_no END AS chunk_index, k.reembed AND t.doc_id % 6 > 0 AS embedded, 1 AS added_in, CASE WHEN k.action = 'removed' AND t.doc_id % 6 > 0 THEN 2 END AS removed_in
    FROM kids k JOIN texts t ON k.old_id = t.doc_id * 100000 + t.line_no LEFT JOIN news n ON k.new_id = n.doc_id * 100000 + n.line_no + {NEW}
UNION ALL SELECT n.doc_id, k.new_id, k.parent_id, md5(n.text), n.line_no, true, 2, NULL FROM kids k JOIN news n ON k.new_id = n.doc_id * 100000 + n.line_no + {NEW} WHERE k.action = 'added' AND n.doc_id % 6 > 0""")
def apply_children(spark, sf_dir):
    *_, plan = versions(spark, sf_dir)
    old, fresh = lines(spark, sf_dir), new_lines(lines(spark, sf_dir))

    def rows(df, base, title):
        d, n = F.col("doc_id"), F.col("line_no")
        return df.select(d.alias("document_id"), (d * 100_000 + n + base).alias("id"), (d * 10_000 + F.floor(n / 4)).alias("parent_id"), F.concat(title, "text").alias("search_text"), n.alias("chunk_index"))

    current = rows(old, 0, F.lit("title: ")).withColumns({"embedding": F.lit(None).cast("array<float>"), "added_in": F.lit(1), "removed_in": F.lit(None).cast("int")})
    new = rows(fresh, NEW, F.when(F.col("doc_id") % 5 == 0, "new title: ").otherwise("title: "))
    found = V.apply_children(current, new, plan, wanted(spark, sf_dir), documents.embed)
    return found.select("document_id", "id", "parent_id", F.md5("search_text").alias("text_md5"), "chunk_index", F.col("embedding").isNotNull().alias("embedded"), "added_in", "removed_in")


@query("v5_apply_links", f"""WITH {BASE} SELECT coalesce(k.old_id, b.id) AS id, coalesce(p.old_id, b.id - 1) AS prev_id, coalesce(q.old_id, b.id + 1) AS next_id
    FROM b LEFT JOIN kept k ON k.new_id = b.id LEFT JOIN kept p ON p.new_id = b.id - 1 LEFT JOIN kept q ON q.new_id = b.id + 1 WHERE b.document_id % 6 > 0""")
def apply_links(spark, sf_dir):
    _, b, plan, _ = versions(spark, sf_dir)
    return V.apply_links(applied(spark, sf_dir), b, plan, wanted(spark, sf_dir))


@query("v5_replace_units", f"WITH {LINES_SQL}, {NEW_LINES_SQL} SELECT doc_id AS document_id, line_no, md5(text) AS text_md5 FROM lines WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, line_no, md5(text) FROM new_lines WHERE doc_id % 6 > 0")
def replaced_units(spark, sf_dir):
    old = lines(spark, sf_dir)
    a, b = (df.select(F.col("doc_id").alias("document_id"), "line_no", F.md5("text").alias("text_md5")) for df in (old, new_lines(old)))
    return V.replace_units(a, b, wanted(spark, sf_dir))


@query("v6_version_changes", f"WITH {BASE} SELECT document_id, count(*) FILTER (added_in = 2) AS added, count(*) FILTER (removed_in = 2) AS removed, count(*) FILTER (added_in < 2 AND (removed_in IS NULL OR removed_in > 2)) AS kept FROM after GROUP BY document_id")
def changes(spark, sf_dir):
    return V.version_changes(applied(spark, sf_dir), F.lit(2))


@query("v7_section_report", f"""WITH {BASE}, parts AS (SELECT *, coalesce(CASE WHEN chunk_index >= 2 THEN 'Part ' || (chunk_index // 2) END, 'Title and cover') AS section FROM after),
o AS (SELECT document_id, section, id, row_number() OVER (PARTITION BY document_id, section ORDER BY chunk_index, id) AS n FROM parts WHERE removed_in = 2),
w AS (SELECT document_id, section, id, row_number() OVER (PARTITION BY document_id, section ORDER BY chunk_index, id) AS n FROM parts WHERE added_in = 2)
SELECT document_id, section, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS type, o.id AS before, w.id AS after FROM o FULL JOIN w USING (document_id, section, n)""")
def report(spark, sf_dir):
    n = F.col("chunk_index")
    sections = applied(spark, sf_dir).withColumn("section", F.when(n >= 2, F.concat(F.lit("Part "), F.floor(n / 2).cast("string"))))
    return V.section_report(sections, F.lit(2))


@query("v8_replace_summary", f"""WITH {BASE}, p AS (SELECT count(*) FILTER (action = 'kept') AS parents_kept, count(*) FILTER (action = 'added') AS parents_added, count(*) FILTER (action = 'removed') AS parents_removed FROM plan)
SELECT p.*, k.* FROM p, (SELECT count(*) FILTER (action = 'kept') AS children_kept, count(*) FILTER (action = 'added') AS children_added, count(*) FILTER (action = 'removed') AS children_removed, count(*) FILTER (reembed) AS embedded FROM kids) k""")
def summary(spark, sf_dir):
    return V.replace_summary(*versions(spark, sf_dir)[2:])
