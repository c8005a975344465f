"""Queries: Markdown pages to chunks (D1, D8, D9, C1-C4). Five web pages make a document of five pages, and customers are
listed in tables that go on over pages of twenty rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chunking as K
from docloom.operators import documents
from docloom.operators import tables as mending
from docloom.registry import query

from .tables import stored, table

OUTLINE = "doc_id long, idx int, code string, title string, target_page int, page_count int"
ROWS = 20


def tables(spark, sf_dir):
    """doc_id, page, text: customers, twenty to a page, as Markdown tables of five more or less sound kinds."""
    s = table(spark, sf_dir, "customer")
    row = F.concat(F.lit("| R-"), (F.col("c_custkey") + 1).cast("string"), F.lit(" | "), "c_name", F.lit(" | "), F.col("c_acctbal").cast("string"), F.lit(" |"))
    place = F.floor(F.col("c_custkey") / F.lit(ROWS * 5))
    rows = s.select((F.lit(1_000_000_000) + place).alias("doc_id"), (F.pmod(F.floor(F.col("c_custkey") / F.lit(ROWS)), F.lit(5)) + 1).cast("int").alias("page"), F.struct("c_custkey", row.alias("row")).alias("r"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n").alias("rows"))
    labels, rule = F.lit("| Row | Customer | Balance |"), F.lit("|---|---|---|")
    kind = F.pmod(F.col("doc_id") + F.col("page"), F.lit(5))
    text = (
        F.when(kind == 0, F.concat_ws("\n", labels, rule, "rows"))
        .when(kind == 1, F.concat_ws("\n", F.lit("| | Partner | |"), labels, rule, "rows"))
        .when(kind == 2, F.concat_ws("\n", labels, F.lit("| --- | --- | --- | |"), "rows", F.lit("Glued line.")))
        .when(kind == 3, F.concat_ws("\n", F.lit("| CUSTOMERS | | |"), labels, "rows"))
        .otherwise(F.concat_ws("\n", labels, rule, F.regexp_replace("rows", r"Customer#", "Customer\n#"), F.lit("| Table 2 – Again | |"), labels, rule, "rows"))
    )
    head = F.when(F.col("page") == 1, F.lit("# Customers\n\n## 1 List\n\n")).when(F.col("page") % 2 == 0, F.lit("## 1 List (continued)\n\n")).otherwise(F.lit(""))
    return pages.select("doc_id", "page", F.concat(head, text).alias("text"))


def pages(spark, sf_dir):
    web = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).alias("doc_id"), (F.pmod("page_id", F.lit(5)) + 1).cast("int").alias("page"), documents.html_to_markdown(F.col("html")).alias("text"))
    mended = mending.repair_tables(web.unionByName(tables(spark, sf_dir))).select("doc_id", "page", "text")
    none = F.lit(None).cast("string")
    return mended.withColumns({"is_plain": F.lit(False), "refs": F.array(F.lit("Table 2"), F.lit("R-1")), "appendix": none, "boundary": none})


def titles(pages):
    return pages.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") >= 1_000_000_000, "Customers").otherwise(F.concat(F.lit("Web pages "), F.col("doc_id").cast("string"))).alias("title"))


def _steps(spark, sf_dir):
    p = stored(pages(spark, sf_dir), "markdown-pages")
    blocks = stored(K.page_blocks(p), "blocks")
    outline = spark.createDataFrame([], OUTLINE)
    return p, blocks, stored(K.split_sections(p, blocks, titles(p), outline), "sections")


def built(spark, sf_dir):
    p = stored(pages(spark, sf_dir), "markdown-pages")
    return K.build_chunks(p, titles(p), spark.createDataFrame([], OUTLINE), stored)


@query("d1_repair_tables")
def repaired(spark, sf_dir):
    return mending.repair_tables(tables(spark, sf_dir))


@query("d8_split_sections")
def sections(spark, sf_dir):
    return _steps(spark, sf_dir)[2].select("doc_id", "page", "n", "block", "run", "section_id", "section_path", "path", "table_id", "continued")


@query("d9_table_links")
def links(spark, sf_dir):
    return K.table_links(_steps(spark, sf_dir)[2])


@query("c1_split_oversize")
def pieces(spark, sf_dir):
    p, blocks, found = _steps(spark, sf_dir)
    return K.split_oversize(K.passages(blocks, found), titles(p), 64).select("doc_id", "run", "block", "part", "piece", "text", "glue", "fragment", "row_id", "n_text")


@query("c2_pack_chunks")
def packed(spark, sf_dir):
    """Parents: what each holds and what is beside it."""
    return built(spark, sf_dir)[0].select("doc_id", "chunk_index", "content_hash", "prev_index", "next_index", F.char_length("text").alias("n_chars"))


@query("c3_search_text")
def searched(spark, sf_dir):
    return built(spark, sf_dir)[1].select("doc_id", "chunk_index", "child_index", "search_text", "context_hash")


@query("c4_chunk_metadata")
def metadata(spark, sf_dir):
    return built(spark, sf_dir)[0].drop("text", "search_text")


@query("w1_ingest")
def ingested(spark, sf_dir):
    """Children of all pages within the token limit, with embeddings."""
    children = built(spark, sf_dir)[1]
    return documents.embed(documents.token_guard(children)[0]).select("doc_id", "chunk_index", "child_index", "content_hash", "tokens", "embedding")
