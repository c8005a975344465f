"""Queries: hybrid retrieval (R rows). Parents are four lines of a document, children its lines and the embeddings (each
a child of the first parent of the document with its number); queries are the benchmark's items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import FREE, STOP_WORDS
from docloom.operators import access as A
from docloom.operators import retrieval as R
from docloom.registry import query
from docloom.sources import files

from . import access
from .tables import LINES_SQL, lines, new_folder, stored, table

PER_PARENT = 4
LIMITS = FREE.across_documents()


def documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("filename"), F.when(F.col("doc_id") % 7 == 6, "PROCESSING").otherwise("COMPLETED").alias("status"))


def children(spark, sf_dir):
    n = F.col("line_no")
    own = lines(spark, sf_dir).select(
        (F.col("doc_id") * 100_000 + n).alias("id"), (F.col("doc_id") * 10_000 + F.floor(n / PER_PARENT)).alias("parent_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("search_text"),
        F.lit(None).cast("array<float>").alias("embedding"), F.when(n % 13 == 12, 2).alias("removed_in"), (n % 17 == 16).alias("is_toc"),
    )
    v = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select((-v - 1).alias("id"), (v * 10_000).alias("parent_id"), v.alias("document_id"), F.lit("").alias("search_text"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("int").alias("removed_in"), F.lit(False).alias("is_toc"))
    return own.unionByName(vectors)


def parents(spark, sf_dir):
    """Four lines each, with the links and metadata that expansion follows."""
    rows = lines(spark, sf_dir).withColumn("part", F.floor(F.col("line_no") / PER_PARENT))
    part = F.col("part")
    p = rows.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("page").alias("page_number"))
    key = F.col("doc_id") * 10_000 + part
    last = rows.groupBy("doc_id").agg(F.max("part").alias("last"))
    same = lambda k: F.floor((part + k) / 3) == F.floor(part / 3)
    return p.join(last, "doc_id").select(
        key.alias("id"), F.col("doc_id").alias("document_id"), "text", part.cast("int").alias("chunk_index"), "page_number", F.array("page_number", F.col("page_number") + (part % 2).cast("int")).alias("source_pages"),
        F.when((part > 0) & same(-1), key - 1).alias("prev_id"), F.when((part < F.col("last")) & same(1), key + 1).alias("next_id"),
        (F.col("doc_id") * 1_000 + F.floor(part / 3)).alias("section_id"), F.floor(part / 6).alias("chapter"), F.array((part % 5).cast("int")).alias("table_ids"), F.when(part % 4 == 0, F.array((part % 3).cast("int"))).otherwise(F.array().cast("array<int>")).alias("linked_table_ids"),
        F.when(part % 11 == 10, 2).alias("removed_in"), (part % 9 == 8).alias("is_toc"),
    )


def asked(spark, sf_dir):
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    w = F.split("text", " ")
    q = b.select(F.col("item_id").alias("query_id"), "text", F.slice(w, 1, 8).alias("keywords"), F.array(F.get(w, F.lit(10))).alias("identifiers"), F.array(F.concat(F.get(w, F.lit(3)), F.lit(" "), F.get(w, F.lit(4)))).alias("entities"))
    return q.join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


WORDS = lambda t, keep="-": f"list_filter(string_split_regex(lower(regexp_replace({t}, '[^a-zA-Z0-9_\\s{keep}]', ' ', 'g')), '\\s+'), lambda x: x <> '')"
BASE = rf"""{LINES_SQL},
docs AS (SELECT doc_id AS id, source || '/' || doc_id AS filename, CASE WHEN doc_id % 7 = 6 THEN 'PROCESSING' ELSE 'COMPLETED' END AS status FROM documents),
kids AS (SELECT doc_id * 100000 + line_no AS id, doc_id * 10000 + line_no // {PER_PARENT} AS parent_id, doc_id AS document_id, text AS search_text, CAST(NULL AS FLOAT[]) AS embedding FROM lines WHERE line_no % 13 <> 12 AND line_no % 17 <> 16
    UNION ALL SELECT -vec_id - 1, vec_id * 10000, vec_id, '', embedding FROM embeddings),
live AS (SELECT * FROM kids WHERE document_id IN (SELECT id FROM docs WHERE status = 'COMPLETED')),
asked AS (SELECT item_id AS query_id, text, list_slice(string_split(text, ' '), 1, 8) AS keywords, string_split(text, ' ')[11] AS identifier, string_split(text, ' ')[4] || ' ' || string_split(text, ' ')[5] AS entity FROM benchmark),
tiers AS (SELECT query_id, CASE WHEN length(trim(identifier)) >= 3 THEN lower(trim(identifier)) END AS code,
    nullif(trim(regexp_replace(lower(regexp_replace(entity, '[^a-zA-Z0-9_\s]', ' ', 'g')), '\s+', ' ', 'g')), '') AS phrase,
    list_distinct(list_filter({WORDS("array_to_string(keywords, ' ')")}, lambda w: length(w) > 1 AND w NOT IN {STOP_WORDS})) AS terms FROM asked),
vector AS (SELECT query_id, child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY d, child_id) AS rank FROM (
    SELECT q.item_id AS query_id, c.id AS child_id, c.parent_id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS d
    FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id JOIN live c ON c.embedding IS NOT NULL) QUALIFY rank <= {LIMITS.vector}),
identifier AS (SELECT query_id, c.id AS child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY c.id) AS rank FROM tiers JOIN live c ON contains(lower(search_text), code) QUALIFY rank <= {LIMITS.keyword}),
padded AS (SELECT id, parent_id, array_to_string(list_transform({WORDS("search_text", "")}, lambda w: ' ' || w || ' '), '') AS t FROM live),
phrase AS (SELECT query_id, id AS child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS rank FROM (
    SELECT query_id, id, parent_id, (length(t) - length(replace(t, p, ''))) / length(p) AS n FROM padded JOIN (SELECT query_id, ' ' || replace(phrase, ' ', '  ') || ' ' AS p FROM tiers WHERE phrase IS NOT NULL) ON contains(t, p)) QUALIFY rank <= {LIMITS.keyword}),
hits AS (SELECT query_id, id AS child_id, parent_id, count(*) AS n FROM (SELECT id, parent_id, unnest({WORDS("search_text")}) AS term FROM live) JOIN (SELECT query_id, unnest(terms) AS term FROM tiers) USING (term) GROUP BY ALL),
keyword AS (SELECT query_id, child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, child_id) AS rank FROM hits QUALIFY rank <= {LIMITS.keyword}),
parts AS (SELECT query_id, parent_id, 'vector' AS source, rank, CAST(1.0 AS DOUBLE) / (10 + rank) AS part FROM vector UNION ALL SELECT query_id, parent_id, 'identifier', rank, CAST(2.5 AS DOUBLE) / (10 + rank) FROM identifier
    UNION ALL SELECT query_id, parent_id, 'phrase', rank, CAST(1.5 AS DOUBLE) / (10 + rank) FROM phrase UNION ALL SELECT query_id, parent_id, 'keyword', rank, CAST(1.0 AS DOUBLE) / (10 + rank) FROM keyword),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS position FROM (
    SELECT query_id, parent_id, round(sum(part), 10) AS score, min(rank) FILTER (source = 'vector') AS vector_rank, min(rank) FILTER (source = 'identifier') AS identifier_rank,
        min(rank) FILTER (source = 'phrase') AS phrase_rank, min(rank) FILTER (source = 'keyword') AS keyword_rank FROM parts GROUP BY 1, 2) QUALIFY position <= {LIMITS.parents}),
parents AS (SELECT doc_id * 10000 + part AS id, doc_id AS document_id, text, CAST(part AS INT) AS chunk_index, page_number,
    CASE WHEN part > 0 AND (part - 1) // 3 = part // 3 THEN doc_id * 10000 + part - 1 END AS prev_id, CASE WHEN part < last AND (part + 1) // 3 = part // 3 THEN doc_id * 10000 + part + 1 END AS next_id,
    doc_id * 1000 + part // 3 AS section_id, part // 6 AS chapter, part % 5 AS table_id, CASE WHEN part % 4 = 0 THEN part % 3 END AS linked_id, part % 11 = 10 AS removed, part % 9 = 8 AS is_toc, part
    FROM (SELECT doc_id, line_no // {PER_PARENT} AS part, string_agg(text, chr(10) ORDER BY line_no) AS text, max(page) AS page_number FROM lines GROUP BY 1, 2) JOIN (SELECT doc_id, max(line_no // {PER_PARENT}) AS last FROM lines GROUP BY 1) USING (doc_id)),
seeds AS (SELECT query_id AS question_id, position AS seed, parent_id FROM fused WHERE position <= 4)"""


def live(spark, sf_dir):
    return R.active_chunks(children(spark, sf_dir), documents(spark, sf_dir))


def fused(spark, sf_dir):
    """All four searches read the children, so these are written once."""
    return R.search_all_documents(asked(spark, sf_dir), stored(live(spark, sf_dir), "children"), FREE)


def seeds(spark, sf_dir):
    """Written once: every way of expansion starts from them."""
    return stored(seeds_of(fused(spark, sf_dir)), "seeds")


def seeds_of(found):
    return found.where("position <= 4").select(F.col("query_id").alias("question_id"), F.col("position").alias("seed"), "parent_id")


@query("r1_search_tiers", f"WITH {BASE} SELECT query_id, CASE WHEN code IS NULL THEN [] ELSE [code] END AS id_patterns, CASE WHEN phrase IS NULL THEN [] ELSE [phrase] END AS phrases, list_sort(terms) AS terms FROM tiers")
def tiers(spark, sf_dir):
    return R.build_search_tiers(asked(spark, sf_dir)).select("query_id", "id_patterns", "phrases", F.array_sort("terms").alias("terms"))


@query("r2_active_chunks", f"WITH {BASE} SELECT document_id, count(*) AS n FROM live GROUP BY document_id")
def active(spark, sf_dir):
    return live(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"))


@query("r3_vector_topk", f"WITH {BASE} SELECT * FROM vector")
def vector(spark, sf_dir):
    return R.vector_topk(asked(spark, sf_dir), live(spark, sf_dir), LIMITS.vector)


@query("r4_identifier_match", f"WITH {BASE} SELECT * FROM identifier")
def identifier(spark, sf_dir):
    return R.identifier_match(R.build_search_tiers(asked(spark, sf_dir)), live(spark, sf_dir), LIMITS.keyword)


@query("r5_phrase_match", f"WITH {BASE} SELECT * FROM phrase")
def phrase(spark, sf_dir):
    return R.phrase_match(R.build_search_tiers(asked(spark, sf_dir)), live(spark, sf_dir), LIMITS.keyword)


@query("r6_keyword_match", f"WITH {BASE} SELECT * FROM keyword")
def keyword(spark, sf_dir):
    return R.keyword_match(R.keyword_hits(R.build_search_tiers(asked(spark, sf_dir)), live(spark, sf_dir)), LIMITS.keyword)


@query("r7_tier_counts", f"WITH {BASE} SELECT query_id, (SELECT count(*) FROM hits h WHERE h.query_id = t.query_id) AS keyword_count, (SELECT count(*) FROM live WHERE embedding IS NOT NULL) AS vector_count FROM tiers t")
def counts(spark, sf_dir):
    q, c = asked(spark, sf_dir), live(spark, sf_dir)
    return R.tier_counts(q, R.keyword_hits(R.build_search_tiers(q), c), c)


@query("r8_weighted_rrf", f"WITH {BASE} SELECT * FROM fused")
def rrf(spark, sf_dir):
    return fused(spark, sf_dir)


@query("w2_hybrid_search", f"""WITH {BASE} SELECT query_id, position, f.parent_id, score, p.document_id, filename AS document_title, md5(p.text) AS text_md5, prev_id, next_id,
    list_filter([CASE WHEN vector_rank IS NOT NULL THEN 'vector' END, CASE WHEN identifier_rank IS NOT NULL THEN 'identifier' END, CASE WHEN phrase_rank IS NOT NULL THEN 'phrase' END, CASE WHEN keyword_rank IS NOT NULL THEN 'keyword' END], lambda x: x IS NOT NULL) AS matched_by
    FROM fused f JOIN parents p ON p.id = f.parent_id JOIN docs d ON d.id = p.document_id""")
def hybrid(spark, sf_dir):
    """R1 to R10 over all documents: the flagship query."""
    found = R.hydrate_parents(fused(spark, sf_dir), parents(spark, sf_dir), documents(spark, sf_dir))
    return found.select("query_id", "position", "parent_id", "score", "document_id", "document_title", F.md5("text").alias("text_md5"), "prev_id", "next_id", "matched_by")


def _single_sql() -> str:
    """``BASE`` with every search in the query's own document, and the limits of a single one."""
    own, sql = "query_id + query_id % 2", BASE
    for old, new in (
        ("JOIN live c ON c.embedding IS NOT NULL)", "JOIN live c ON c.embedding IS NOT NULL AND c.document_id = q.item_id + q.item_id % 2)"),
        ("JOIN live c ON contains(lower(search_text), code)", f"JOIN live c ON contains(lower(search_text), code) AND c.document_id = {own}"),
        ("padded AS (SELECT id, ", "padded AS (SELECT id, document_id, "), ("ON contains(t, p))", f"ON contains(t, p) AND document_id = {own})"),
        ("FROM (SELECT id, parent_id, unnest(", "FROM (SELECT id, document_id, parent_id, unnest("), ("USING (term) GROUP BY ALL", f"USING (term) WHERE document_id = {own} GROUP BY ALL"),
        (f"rank <= {LIMITS.vector}", f"rank <= {FREE.vector}"), (f"position <= {LIMITS.parents}", f"position <= {FREE.parents}"),
    ):
        assert old in sql, old
        sql = sql.replace(old, new)
    return f"WITH {sql} SELECT * FROM fused"


@query("r10_search_single", _single_sql())
def single(spark, sf_dir):
    """Each item searches the document of its number and the one after it in turn."""
    q = asked(spark, sf_dir)
    wanted = q.select("query_id", (F.col("query_id") + F.col("query_id") % 2).alias("document_id"))
    return R.search_single(q, stored(live(spark, sf_dir), "children"), FREE, wanted)


@query("r11_rerank_top_n", f"""WITH {BASE}, scored AS (SELECT query_id, parent_id, position, score, CASE WHEN query_id % 3 > 0 AND parent_id % 4 > 0 THEN CAST(parent_id * 7 % 101 AS DOUBLE) END AS rerank_score FROM fused)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, position, parent_id) AS rerank_rank FROM scored QUALIFY rerank_rank <= {FREE.rerank}""")
def reranked(spark, sf_dir):
    p = F.col("parent_id")
    scored = fused(spark, sf_dir).select("query_id", "parent_id", "position", "score", F.when((F.col("query_id") % 3 > 0) & (p % 4 > 0), (p * 7 % 101).cast("double")).alias("rerank_score"))
    return R.rerank_top_n(scored, FREE.rerank)


@query("r12_collect_subqueries", f"""WITH {BASE}, rows AS (SELECT query_id // 4 AS question_id, query_id % 4 AS subquery, position, parent_id, score FROM fused)
SELECT question_id, parent_id, row_number() OVER (PARTITION BY question_id ORDER BY first, parent_id) AS position, score FROM (
    SELECT question_id, parent_id, min((subquery, position)) AS first, arg_max(score, (subquery, position)) AS score FROM rows GROUP BY 1, 2)""")
def subqueries(spark, sf_dir):
    q = F.col("query_id")
    return R.collect_subquery_results(fused(spark, sf_dir).select(F.floor(q / 4).alias("question_id"), (q % 4).alias("subquery"), "position", "parent_id", "score"))


@query("a9_list_parents", f"WITH {BASE} SELECT p.document_id, p.id, p.chunk_index, count(k.id) AS children FROM parents p LEFT JOIN kids k ON k.parent_id = p.id WHERE NOT removed GROUP BY ALL")
def listed_parents(spark, sf_dir):
    kids = children(spark, sf_dir).where("not is_toc")
    return A.list_parents(parents(spark, sf_dir), kids)


@query("a9_list_children", f"WITH {BASE} SELECT parent_id, id, abs(id) % 100000 AS child_index, len(embedding) AS dimension FROM kids")
def listed_children(spark, sf_dir):
    return A.list_children(children(spark, sf_dir).where("not is_toc").withColumn("child_index", F.abs("id") % 100_000))


@query("s5_export_parents", f"WITH {BASE} SELECT p.id, md5(p.text) AS text_md5, chunk_index, next_id FROM parents p JOIN docs d ON d.id = p.document_id WHERE contains(lower(filename), '/1')")
def exported(spark, sf_dir):
    found = files.export_parents(parents(spark, sf_dir), documents(spark, sf_dir), "/1")
    get = lambda k, kind: F.get_json_object("metadata", f"$.{k}").cast(kind)
    return found.select("id", F.md5("text").alias("text_md5"), get("chunk_index", "int").alias("chunk_index"), get("next_id", "long").alias("next_id"))


@query("s4_save_chunks", f"WITH {BASE} SELECT 'parents' AS name, document_id, count(*) AS n FROM parents GROUP BY 2 UNION ALL SELECT 'children', document_id, count(*) FROM kids GROUP BY 2 UNION ALL SELECT 'units', doc_id, count(*) FROM lines GROUP BY 2")
def saved(spark, sf_dir):
    """What is read back after even documents, odd ones with each row twice, and odd ones again as they are have been saved:
    documents replace themselves, in buckets that they share with others."""
    path = new_folder(spark, "saved")
    units = lines(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    whole = {"parents": parents(spark, sf_dir), "children": children(spark, sf_dir).where("removed_in is null and not is_toc"), "units": units}
    odd = F.pmod("document_id", F.lit(2)) == 1
    files.save_chunks(*(df.where(~odd) for df in whole.values()), path, 4)
    files.save_chunks(*(df.where(odd).unionByName(df.where(odd)) for df in whole.values()), path, 4)
    files.save_chunks(*(df.where(odd) for df in whole.values()), path, 4)
    back = [files.saved(spark, path, t).groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "document_id", "n") for t in whole]
    return reduce(DataFrame.unionByName, back)


@query("s1_read_corpus", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def corpus(spark, sf_dir):
    return files.read_corpus(spark, f"{sf_dir}/documents.parquet", "parquet").select("doc_id", F.md5("text").alias("text_md5"))


@query("r13_chunks_by_page", f"""WITH {BASE} SELECT document_id, page, id, chunk_index FROM (
    SELECT document_id, id, chunk_index, unnest(list_distinct([page_number, CAST(page_number + part % 2 AS INT)])) AS page FROM parents WHERE NOT removed) WHERE page = 2""")
def by_page(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("page"))
    return R.chunks_by_page(parents(spark, sf_dir), pages)


SIBLINGS = """siblings AS (SELECT question_id, seed, o AS "order", found FROM (SELECT question_id, seed, unnest([0, 1]) AS o, unnest([prev_id, next_id]) AS found FROM seeds s JOIN parents p ON p.id = s.parent_id)
    WHERE found IN (SELECT id FROM parents WHERE NOT removed))"""
LEAD = """lead_of AS (SELECT document_id, section_id, arg_min(id, chunk_index) AS found FROM parents WHERE NOT removed GROUP BY 1, 2),
leads AS (SELECT question_id, seed, 0 AS "order", found FROM seeds s JOIN parents p ON p.id = s.parent_id AND NOT removed JOIN lead_of USING (document_id, section_id) WHERE found <> s.parent_id)"""
CHAPTER = f"""chapter_rows AS (SELECT document_id, chapter, id AS found, row_number() OVER (PARTITION BY document_id, chapter ORDER BY chunk_index) - 1 AS o FROM parents WHERE NOT removed AND NOT is_toc QUALIFY o < {FREE.chapter}),
chapters AS (SELECT question_id, seed, o AS "order", found FROM seeds s JOIN parents p ON p.id = s.parent_id AND NOT removed AND NOT is_toc JOIN chapter_rows c USING (document_id, chapter)
    WHERE question_id IN (SELECT item_id FROM benchmark WHERE item_id % 2 = 0 OR regexp_matches(lower(text), 'process|step|flow|procedure|overview|policy|guide|sop')))"""
TABLES = f"""tabled AS (SELECT DISTINCT document_id, id, chunk_index, unnest(list_filter([table_id, linked_id], lambda x: x IS NOT NULL)) AS t FROM parents WHERE NOT removed),
parts_of AS (SELECT question_id, seed, row_number() OVER (PARTITION BY question_id, seed, o.t ORDER BY o.chunk_index) - 1 AS "order", o.id AS found FROM seeds s JOIN tabled m ON m.id = s.parent_id JOIN tabled o ON o.document_id = m.document_id AND o.t = m.t AND o.id <> s.parent_id
    QUALIFY "order" < {FREE.table_parts})"""


@query("r14_expand_siblings", f"WITH {BASE}, {SIBLINGS} SELECT * FROM siblings")
def siblings(spark, sf_dir):
    return R.expand_siblings(seeds(spark, sf_dir), parents(spark, sf_dir))


@query("r15_expand_section_lead", f"WITH {BASE}, {LEAD} SELECT * FROM leads")
def leads(spark, sf_dir):
    return R.expand_section_lead(seeds(spark, sf_dir), parents(spark, sf_dir))


@query("r16_expand_chapter", f"WITH {BASE}, {CHAPTER} SELECT * FROM chapters")
def chapters(spark, sf_dir):
    return R.expand_chapter(seeds(spark, sf_dir), parents(spark, sf_dir), process_questions(spark, sf_dir), FREE.chapter)


def process_questions(spark, sf_dir):
    text = F.concat("text", F.when(F.col("query_id") % 2 == 0, " policy").otherwise(""))
    return asked(spark, sf_dir).select(F.col("query_id").alias("question_id"), text.alias("text"))


@query("r17_expand_tables", f"WITH {BASE}, {TABLES} SELECT * FROM parts_of")
def table_parts(spark, sf_dir):
    return R.expand_table_continuation(seeds(spark, sf_dir), parents(spark, sf_dir), FREE.table_parts)


@query("r19_expand_context", f"""WITH {BASE}, {SIBLINGS}, {LEAD}, {TABLES}, every AS (
    SELECT question_id, 0 AS phase, seed, 0 AS o, parent_id AS found, 'search' AS origin FROM seeds UNION ALL SELECT question_id, 1, seed, "order", found, 'sibling' FROM siblings
    UNION ALL SELECT question_id, 2, seed, "order", found, 'section' FROM leads UNION ALL SELECT question_id, 3, seed, "order", found, 'table' FROM parts_of)
SELECT question_id, found AS parent_id, origin, row_number() OVER (PARTITION BY question_id ORDER BY spot, found) AS position FROM (
    SELECT question_id, found, min((phase, seed, o)) AS spot, arg_min(origin, (phase, seed, o)) AS origin FROM every GROUP BY 1, 2) QUALIFY position <= {FREE.round_chunks}""")
def expanded(spark, sf_dir):
    s, p = seeds(spark, sf_dir), parents(spark, sf_dir)
    phases = {"sibling": R.expand_siblings(s, p), "section": R.expand_section_lead(s, p), "table": R.expand_table_continuation(s, p, FREE.table_parts)}
    return R.expand_context(s, phases, FREE.round_chunks)


def referring(p, s):
    """Parents with references, and the questions that cite those of their seeds."""
    later = p.select((F.col("id") - 3).alias("id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ").alias("ref"))
    rows = p.join(later, "id", "left").withColumns({"search_text": F.col("text"), "heading": F.concat(F.lit("Chapter "), F.col("chapter").cast("string")), "refs": F.when(F.col("ref").isNull(), F.array(F.lit("Appendix A"))).otherwise(F.array("ref", F.lit("Appendix A")))})
    questions = s.join(later.withColumnRenamed("id", "parent_id"), "parent_id").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), " and ").alias("text"))
    return rows, questions


#: Every other question is the item's own text, so that a reference matters by its kind, by being cited, or by a guide's line.
@query("r18_follow_references", rf"""WITH {BASE}, later AS (SELECT id - 3 AS id, trim(array_to_string(string_split_regex(text, '\s+')[1:2], ' ')) AS ref FROM parents),
q AS (SELECT question_id, lower(CASE WHEN question_id % 2 = 0 THEN any_value(b.text) ELSE string_agg(DISTINCT l.ref, ' and ' ORDER BY l.ref) END) AS question FROM seeds s JOIN later l ON l.id = s.parent_id JOIN benchmark b ON b.item_id = question_id GROUP BY question_id),
own AS (SELECT question_id, question, seed, p.document_id, p.text, p.is_toc, l.ref FROM seeds s JOIN q USING (question_id) JOIN parents p ON p.id = s.parent_id LEFT JOIN later l ON l.id = s.parent_id),
named AS (SELECT *, 0 AS spot FROM own WHERE ref IS NOT NULL UNION ALL SELECT * REPLACE ('Appendix A' AS ref), CASE WHEN ref IS NULL THEN 0 ELSE 1 END FROM own),
lined AS (SELECT *, lower(coalesce(nullif(regexp_extract(ref, '{R.NUMBERED}', 1), ''), ref)) AS number, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), lower(ref)))[1] AS line FROM named),
refs AS (SELECT question_id, seed, document_id, spot, ref FROM lined WHERE regexp_matches(ref, '{R.OVERRIDES}') OR contains(question, lower(ref)) OR (length(number) >= 2 AND contains(question, number))
    OR ((is_toc OR regexp_matches(text, '{R.GUIDES}')) AND len(list_filter(string_split_regex(lower(line), '\W+'), lambda w: length(w) >= 4 AND contains(question, w))) > 0)),
wanted AS (SELECT question_id, document_id, pattern, min((seed, spot)) AS place FROM (SELECT *, lower(CASE WHEN starts_with(ref, '§') THEN trim(substr(ref, 2)) ELSE ref END) AS pattern FROM refs) WHERE length(pattern) >= 2 GROUP BY 1, 2, 3),
hit AS (SELECT w.*, p.id AS found, is_toc, CASE WHEN contains('chapter ' || chapter, pattern) THEN 3 ELSE 0 END + CASE WHEN starts_with(lower(ltrim(text)), pattern) THEN 2 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY question_id, w.document_id, pattern ORDER BY chunk_index, p.id) AS n FROM wanted w JOIN parents p ON p.document_id = w.document_id AND NOT removed AND contains(lower(text), pattern)),
best AS (SELECT question_id, min(place) AS place, arg_min(found, (-score, n)) AS found FROM hit WHERE n <= 5 AND NOT is_toc GROUP BY question_id, document_id, pattern),
once AS (SELECT question_id, found, min(place) AS place FROM best ANTI JOIN (SELECT question_id, parent_id AS found FROM seeds) k USING (question_id, found) GROUP BY 1, 2)
SELECT question_id, place[1] AS seed, row_number() OVER (PARTITION BY question_id ORDER BY place, found) - 1 AS "order", found FROM once QUALIFY "order" < {FREE.references}""")
def followed(spark, sf_dir):
    """Each parent refers to the first two words of the parent three places on, as an appendix or as cited text."""
    s = seeds(spark, sf_dir)
    rows, cited = referring(stored(parents(spark, sf_dir), "parents"), s)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("item"))
    questions = cited.join(items, "question_id").select("question_id", F.when(F.col("question_id") % 2 == 0, F.col("item")).otherwise(F.col("text")).alias("text"))
    return R.follow_references(s, rows, questions, FREE.references)


def visible(spark, sf_dir):
    """query_id, document_id: a query is asked by the customer of its number; a document belongs to the role of its number
    modulo 25."""
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    t = access.tables(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    links = docs.select((F.col("id") % 25).alias("role_id"), F.col("id").alias("document_id"))
    found = A.accessible_documents(t["users"].join(asks, "id", "left_semi"), t["user_roles"], links, docs)
    return found.withColumnRenamed("user_id", "query_id")


@query("r19_expand_context_whole")
def expanded_whole(spark, sf_dir):
    """R19 with its five phases, from the first ``FREE.seeds`` chunks, all within the documents that the user may see.
    ``r19_expand_context`` follows its SQL twin: three phases, from all chunks, without access."""
    may = stored(visible(spark, sf_dir), "visible")
    found = R.search(asked(spark, sf_dir), stored(live(spark, sf_dir), "children"), LIMITS, may).where("position <= 4")
    s = stored(found.select(F.col("query_id").alias("question_id"), F.col("position").alias("seed"), "parent_id"), "seeds")
    return expand(s, stored(parents(spark, sf_dir), "parents"), process_questions(spark, sf_dir), may.withColumnRenamed("query_id", "question_id"))


def expand(s, p, questions, may):
    first = s.where(F.col("seed") <= FREE.seeds)
    phases = {
        "sibling": R.expand_siblings(first, p),
        "section": R.expand_section_lead(first, p),
        "chapter": R.expand_chapter(first, p, questions, FREE.chapter),
        "table": R.expand_table_continuation(first, p, FREE.table_parts),
    }
    known = [df.select("question_id", "found") for df in phases.values()]
    known = reduce(DataFrame.unionByName, known, s.select("question_id", F.col("parent_id").alias("found"))).distinct()
    phases["reference"] = R.follow_references(first, *referring(p, first), FREE.references, known)
    return R.expand_context(s, phases, FREE.round_chunks, p, may)
