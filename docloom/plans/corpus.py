"""One corpus from ingestion to context: chunks of the Markdown pages (W1) are searched, and what is found is expanded along
the links and metadata that chunking gave them (R14-R19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import FREE
from docloom.functions.frames import stored
from docloom.operators import documents
from docloom.operators import retrieval as R
from docloom.registry import query

from . import chunking

LIMITS = FREE.across_documents()


def corpus(spark, sf_dir):
    """Parents and children as search and expansion take them."""
    parents, children = chunking.built(spark, sf_dir)
    key = lambda c: F.col("doc_id") * 100_000 + F.col(c)
    none = F.lit(None).cast("int")
    own = parents.select(
        key("chunk_index").alias("id"), F.col("doc_id").alias("document_id"), "text", "search_text", "chunk_index", "page_number", "source_pages", key("prev_index").alias("prev_id"), key("next_index").alias("next_id"),
        "section_id", F.get("heading_path", F.lit(0)).alias("chapter"), F.array_join("heading_path", " > ").alias("heading"), "table_ids", "linked_table_ids", F.col("references").alias("refs"), "is_toc", none.alias("removed_in"),
    )
    kids = documents.embed(documents.token_guard(children)[0])
    kids = kids.select((key("chunk_index") * 1_000 + F.col("child_index")).alias("id"), key("chunk_index").alias("parent_id"), F.col("doc_id").alias("document_id"), "search_text", "embedding", none.alias("removed_in"), "is_toc")
    return stored(own, "corpus-parents"), stored(kids, "corpus-children")


def asked(parents):
    """A question for each document: its second chunk's heading, last words and, if it has a table, the code of a row."""
    p = parents.where("chunk_index = 1")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    code = F.regexp_extract("text", r"\bR-\d+\b", 0)
    q = p.select(
        F.col("document_id").alias("query_id"), F.concat_ws(" ", F.lit("What is the policy on"), "heading").alias("text"), F.slice(words, -4, F.least(F.lit(4), F.size(words))).alias("keywords"),
        F.when(code != "", F.array(code)).otherwise(F.array().cast("array<string>")).alias("identifiers"), F.array(F.array_join(F.slice(words, 1, 3), " ")).alias("entities"), F.col("text").alias("search_text"),
    )
    return documents.embed(q)


def context(questions: DataFrame, parents: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seeds of each question, and its context: seeds and chunks of all five phases."""
    found = R.search(questions, children, LIMITS).where("position <= 4")
    seeds = stored(found.select(F.col("query_id").alias("question_id"), F.col("position").alias("seed"), "parent_id"), "corpus-seeds")
    first, text = seeds.where(F.col("seed") <= FREE.seeds), questions.select(F.col("query_id").alias("question_id"), "text")
    phases = {
        "sibling": R.expand_siblings(first, parents),
        "section": R.expand_section_lead(first, parents),
        "chapter": R.expand_chapter(first, parents, text, FREE.chapter),
        "table": R.expand_table_continuation(first, parents, FREE.table_parts),
    }
    known = reduce(DataFrame.unionByName, [df.select("question_id", "found") for df in phases.values()], seeds.select("question_id", F.col("parent_id").alias("found"))).distinct()
    phases["reference"] = R.follow_references(first, parents, text, FREE.references, known)
    return seeds, R.expand_context(seeds, phases, FREE.round_chunks)


@query("w2_built_corpus")
def built_corpus(spark, sf_dir):
    """Context for a question on each document, over the chunks that ingestion built."""
    parents, children = corpus(spark, sf_dir)
    return context(stored(asked(parents), "corpus-questions"), parents, children)[1]
