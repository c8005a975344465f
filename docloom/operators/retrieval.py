"""Hybrid retrieval for many queries at once: four ranked searches over child chunks, fused per parent.

queries: query_id, text, keywords, identifiers, entities (arrays), embedding. children: id, parent_id, document_id,
search_text, embedding, removed_in, is_toc. Ties in every ranking go to the smaller child id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import FUSION_K, STOP_WORDS, WEIGHTS, Limits
from docloom.functions.frames import spread_join, stored, united
from docloom.functions.text import words

from . import postings

#: Queries and children of one block of vector search, and the vectors that blocks lie around.
QUERY_BLOCK, CHILD_BLOCK, PIVOTS = 4_096, 16_384, 64
SOURCES = ("vector", "identifier", "phrase", "keyword")


def build_search_tiers(queries: DataFrame) -> DataFrame:
    """``queries`` with id_patterns (trimmed, lower case, 3 characters at least), phrases (words between single blanks)
    and terms (of the keywords, else of the text, without stop words). Missing lists count as empty."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    ids = F.filter(F.transform(listed("identifiers"), lambda x: F.lower(F.trim(x))), lambda x: F.char_length(x) >= 3)
    phrase = lambda x: F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, r"[^\w\s]", " ")), r"\s+", " "))
    phrases = F.array_distinct(F.filter(F.transform(listed("entities"), phrase), lambda x: x != ""))
    source = F.when(F.size(listed("keywords")) > 0, F.array_join(listed("keywords"), " ")).otherwise(F.coalesce("text", F.lit("")))
    terms = F.array_distinct(F.filter(words(source), lambda w: (F.char_length(w) > 1) & ~w.isin(*STOP_WORDS)))
    return queries.withColumns({"id_patterns": ids, "phrases": phrases, "terms": terms})


def active_chunks(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Chunks that are current and no contents list; with ``documents``, only those of completed ones."""
    live = chunks.where("removed_in is null and not (is_toc <=> true)")
    if documents is None:
        return live
    done = documents.where("status = 'COMPLETED'").select(F.col("id").alias("document_id"))
    return live.join(done, "document_id", "left_semi")


def _allowed(rows: DataFrame, children: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows (query_id, child_id) whose document the query may see; all without ``allowed`` (query_id, document_id)."""
    if allowed is None:
        return rows
    own = children.select(F.col("id").alias("child_id"), "document_id")
    return rows.join(own, "child_id").join(allowed, ["query_id", "document_id"], "left_semi").drop("document_id")


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """query_id, child_id, parent_id, rank of the best k rows of each query."""
    w = Window.partitionBy("query_id").orderBy(*order, "child_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "child_id", "parent_id", "rank")


def vector_topk(queries: DataFrame, children: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Exact search by cosine distance: blocks of queries meet blocks of children, and of a block only the k nearest of
    each query go on. With ``allowed`` (query_id, document_id), what a query may see goes to the blocks with it.

    Where there is more than one block, children lie with the nearest of a few pivots (children themselves). A query first
    searches the blocks of its own pivot. Its k-th distance there is a bound: a pivot's block can hold something nearer
    only if the angle to the pivot, less the largest one of the pivot's children, is within it; all others are skipped,
    and none of the k nearest with them."""
    double = F.col("embedding").cast("array<double>").alias("embedding")
    asked = queries.where("embedding is not null").select("query_id", double)
    rows = children.where("embedding is not null").select(F.col("id").alias("child_id"), "parent_id", "document_id", double)
    n_queries, n_rows = asked.count(), rows.count()
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    if n_rows <= CHILD_BLOCK:
        held = rows.withColumns({"pivot": F.lit(0), "block": F.lit(0)})
        wanted = asked.withColumns({"pivot": F.lit(0), "block": F.lit(0)})
        return _ranked(_block_search(wanted, held, parts, k, allowed), k, F.col("distance"))
    # a fixed number of vectors, whatever the data
    pivots = np.array([r[0] for r in rows.orderBy(F.xxhash64("child_id")).limit(PIVOTS).select("embedding").collect()])
    placed = stored(_to_pivots(rows, pivots, 1), "children-by-pivot")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(CHILD_BLOCK)).cast("int").alias("blocks"), F.max("angle").alias("radius"))  # one row a pivot
    held = placed.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("child_id"), F.col("blocks")).cast("int")).drop("angle", "blocks", "radius")
    near = stored(_to_pivots(asked, pivots, len(pivots)), "queries-by-pivot").join(F.broadcast(sizes), "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.col("place") == 0
    first = stored(_block_search(near.where(own), held, parts, k, allowed), "nearest-of-own-pivot")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "child_id")))
    bound = ranked.where(F.col("n") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), 1 - F.col("distance"))).alias("bound"))
    reach = F.col("angle") - F.col("radius") - 1e-6
    rest = near.where(~own).join(bound, "query_id", "left").where(F.col("bound").isNull() | (reach <= F.col("bound")))
    return _ranked(united([first, _block_search(rest, held, parts, k, allowed)]), k, F.col("distance"))


def _unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _to_pivots(rows: DataFrame, pivots: np.ndarray, most: int) -> DataFrame:
    """``rows`` for each of their ``most`` nearest pivots: pivot, angle to it and place (0: the nearest). Vectors of length
    zero have a right angle to everything and so an angle that rules nothing out: 0 as rows, pi as children."""
    unit, one = _unit(pivots), most == 1

    def work(batches):
        for b in batches:
            if len(b):
                x = _unit(b["embedding"])
                angle = np.arccos(np.clip(x @ unit.T, -1, 1))
                angle[~x.any(axis=1)] = np.pi if one else 0
                order = np.argsort(angle, axis=1, kind="stable")[:, :most]
                at = np.repeat(np.arange(len(b)), order.shape[1])
                found = b.iloc[at].reset_index(drop=True)
                yield found.assign(pivot=order.ravel().astype(np.int32), angle=np.take_along_axis(angle, order, 1).ravel(), place=np.tile(np.arange(order.shape[1], dtype=np.int32), len(b)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, f"{kinds}, pivot int, angle double, place int")


def _block_search(asked: DataFrame, held: DataFrame, parts: int, k: int, allowed: DataFrame | None) -> DataFrame:
    """query_id, child_id, parent_id, distance: the k nearest (with ties) of each query in each block that it asks. asked:
    query_id, embedding, part, pivot, block; held: child_id, parent_id, document_id, embedding, pivot, block."""
    keys = ["pivot", "block", "part"]
    left = asked.select(*keys, "query_id", "embedding", F.lit(None).cast("long").alias("document_id"))
    if allowed is not None:  # rights go to the blocks that hold something of their document, if the query asks these
        where = held.select("document_id", "pivot", "block").distinct()
        rights = allowed.join(where, "document_id").join(asked.select(*keys, "query_id"), ["query_id", "pivot", "block"])
        left = united([left, rights.select(*keys, "query_id", F.lit(None).cast("array<double>").alias("embedding"), "document_id")])
    right = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # a copy for each block of queries: one, nearly always
    columns, scoped = ["query_id", "child_id", "parent_id", "distance"], allowed is not None

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        own = q[q["embedding"].notna()]
        if not len(own) or not len(c):
            return pd.DataFrame({x: pd.Series(dtype=float if x == "distance" else np.int64) for x in columns})
        ids, unit = own["query_id"].to_numpy(np.int64), _unit(own["embedding"])
        seen = None
        if scoped:
            documents, of = np.unique(c["document_id"].to_numpy(), return_inverse=True)
            rights = q[q["embedding"].isna()]
            rights = rights[rights["document_id"].isin(documents)]
            seen = np.zeros((len(ids), len(documents)), bool)
            order = np.argsort(ids)
            seen[order[np.searchsorted(ids[order], rights["query_id"].to_numpy(np.int64))], np.searchsorted(documents, rights["document_id"].to_numpy())] = True
        child, parent, found = c["child_id"].to_numpy(np.int64), c["parent_id"].to_numpy(np.int64), []
        for at in range(0, len(c), 1_024):
            part = slice(at, at + 1_024)
            d = 1 - unit @ _unit(c["embedding"].iloc[part]).T
            if seen is not None:
                d = np.where(seen[:, of[part]], d, np.inf)
            most = min(k, d.shape[1])
            i, j = np.nonzero((d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most]) & np.isfinite(d))
            found.append(pd.DataFrame(dict(zip(columns, (ids[i], child[part][j], parent[part][j], np.round(d[i, j], 12))))))
        every = pd.concat(found).sort_values(["query_id", "distance", "child_id"])
        return every[every.groupby("query_id").cumcount() < k]

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, child_id long, parent_id long, distance double")


def _occurrences(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """child_id, parent_id, pattern, n: how often each pattern (of three characters at least) stands in each text without
    overlapping itself, by an inverted index. rows: child_id, parent_id, text; patterns: pattern."""
    everywhere = F.lit(0).alias("scope")
    texts = rows.select(F.col("child_id").alias("id"), "parent_id", "text", everywhere)
    found = postings.containing(texts, patterns.select(everywhere, "pattern"), (3, 5))
    return found.select(F.col("id").alias("child_id"), "parent_id", "pattern", postings.occurrences(F.col("text"), F.col("pattern")).alias("n"))


def identifier_match(tiers: DataFrame, children: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Children whose text contains a code of the query, whatever its case, by id. Wildcards in codes are literal."""
    codes = tiers.select("query_id", F.explode("id_patterns").alias("pattern")).distinct()
    rows = children.select(F.col("id").alias("child_id"), "parent_id", F.lower("search_text").alias("text"))
    found = _occurrences(rows, codes).join(codes, "pattern").select("query_id", "child_id", "parent_id").distinct()
    return _ranked(_allowed(found, children, allowed), k)


def phrase_match(tiers: DataFrame, children: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Children that hold a name of the query as consecutive words, most occurrences first (in place of cover density;
    no stemming). Words stand between two blanks each, in phrases as in texts."""
    padded = F.concat(F.lit(" "), F.replace(F.col("phrase"), F.lit(" "), F.lit("  ")), F.lit(" "))
    asked = tiers.select("query_id", F.explode("phrases").alias("phrase")).select("query_id", padded.alias("pattern"))
    text = F.array_join(F.transform(F.filter(F.split(F.lower(F.regexp_replace("search_text", r"[^\w\s]", " ")), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    rows = children.select(F.col("id").alias("child_id"), "parent_id", text.alias("text"))
    hits = _occurrences(rows, asked).join(asked, "pattern").groupBy("query_id", "child_id", "parent_id").agg(F.sum("n").alias("n"))
    return _ranked(_allowed(hits, children, allowed), k, F.desc("n"))


def keyword_hits(tiers: DataFrame, children: DataFrame) -> DataFrame:
    """query_id, child_id, parent_id, n: occurrences of the query's terms. Words are counted per child before they meet
    the terms, only words that some query asks for are kept, and a word that a great part of the children has is dealt
    over many tasks."""
    asked = tiers.select("query_id", F.explode("terms").alias("term"))
    rows = children.select(F.col("id").alias("child_id"), "parent_id", F.explode(words(F.col("search_text"))).alias("term"))
    counted = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("child_id", "parent_id", "term").agg(F.count("*").alias("tf"))
    return spread_join(stored(counted, "term-counts"), asked, "term", F.col("child_id")).groupBy("query_id", "child_id", "parent_id").agg(F.sum("tf").alias("n"))


def keyword_match(hits: DataFrame, k: int) -> DataFrame:
    return _ranked(hits, k, F.desc("n"))


def tier_counts(queries: DataFrame, hits: DataFrame, children: DataFrame) -> DataFrame:
    """query_id, keyword_count, vector_count before any limit."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("keyword_count"))
    every = children.where("embedding is not null").agg(F.count("*").alias("vector_count"))
    return queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["keyword_count"]).crossJoin(F.broadcast(every))  # one row


def weighted_rrf(tiers: dict[str, DataFrame], count: int) -> DataFrame:
    """query_id, parent_id, score and the best rank in each search: scores are summed over all child hits of a parent;
    the best ``count`` parents, ties to the smaller parent id."""
    union = united([df.select("query_id", "parent_id", "rank", F.lit(s).alias("source"), (F.lit(WEIGHTS[s]) / (F.lit(FUSION_K) + F.col("rank"))).alias("part")) for s, df in tiers.items()])
    best = [F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank") for s in SOURCES]
    fused = union.groupBy("query_id", "parent_id").agg(F.round(F.sum("part"), 10).alias("score"), *best)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "parent_id")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= count)


def matched_by() -> Column:
    return F.filter(F.array(*[F.when(F.col(f"{s}_rank").isNotNull(), F.lit(s)) for s in SOURCES]), lambda x: x.isNotNull())


def hydrate_parents(ranked: DataFrame, parents: DataFrame, documents: DataFrame) -> DataFrame:
    """The ranked parents with their text and links, their document's title, and the searches that found them."""
    p = parents.select(F.col("id").alias("parent_id"), "document_id", "text", "prev_id", "next_id")
    d = documents.select(F.col("id").alias("document_id"), F.col("filename").alias("document_title"))
    return ranked.join(p, "parent_id").join(d, "document_id").withColumn("matched_by", matched_by())


def search(queries: DataFrame, children: DataFrame, limits: Limits, allowed: DataFrame | None = None) -> DataFrame:
    """R1 to R8: the fused parents of each query over active children; with ``allowed`` (query_id, document_id), over
    those it may see: they are left out before any ranking."""
    tiers = build_search_tiers(queries)
    hits = _allowed(keyword_hits(tiers, children), children, allowed)
    found = {
        "vector": vector_topk(queries, children, limits.vector, allowed),
        "identifier": identifier_match(tiers, children, limits.keyword, allowed),
        "phrase": phrase_match(tiers, children, limits.keyword, allowed),
        "keyword": keyword_match(hits, limits.keyword),
    }
    return weighted_rrf(found, limits.parents)


def search_single(queries: DataFrame, children: DataFrame, limits: Limits, documents: DataFrame) -> DataFrame:
    """R10 in one document each: ``documents`` (query_id, document_id) names it, and the limits are those given."""
    return search(queries, children, limits, documents)


def search_all_documents(queries: DataFrame, children: DataFrame, limits: Limits, allowed: DataFrame | None = None) -> DataFrame:
    """R10 over all documents that a query may see: wider limits."""
    return search(queries, children, limits.across_documents(), allowed)


def rerank_top_n(candidates: DataFrame, n: int) -> DataFrame:
    """The best n of each query by rerank_score; a query without any score keeps its first n in retrieval order. Adds
    rerank_rank beside position."""
    w = Window.partitionBy("query_id")
    scored = candidates.withColumn("_any", F.max(F.col("rerank_score").isNotNull()).over(w))
    order = w.orderBy(F.when(F.col("_any"), F.col("rerank_score")).desc_nulls_last(), "position", "parent_id")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= n).drop("_any")


def collect_subquery_results(rows: DataFrame) -> DataFrame:
    """One row per question and chunk over its sub-queries: place of the first occurrence, values of the last.

    rows: question_id, subquery, position, parent_id, score."""
    at = F.struct("subquery", "position")
    merged = rows.groupBy("question_id", "parent_id").agg(F.min(at).alias("first"), F.max_by("score", at).alias("score"))
    w = Window.partitionBy("question_id").orderBy("first", "parent_id")
    return merged.select("question_id", "parent_id", F.row_number().over(w).alias("position"), "score")


def chunks_by_page(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Active chunks on each asked page (document_id, page), by chunk_index."""
    live = chunks.where("removed_in is null").withColumn("page", F.explode(F.array_distinct(F.concat(F.array("page_number"), F.coalesce("source_pages", F.array().cast("array<int>"))))))
    return live.join(pages, ["document_id", "page"]).select("document_id", "page", "id", "chunk_index")


def expand_siblings(seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """Previous and next parent of each seed that has a section. seeds: question_id, seed, parent_id."""
    own = parents.where("section_id is not null").select(F.col("id").alias("parent_id"), F.posexplode(F.array("prev_id", "next_id")).alias("order", "found"))
    hit = seeds.join(own.where("found is not null"), "parent_id")
    live = parents.where("removed_in is null").select(F.col("id").alias("found"))
    return hit.join(live, "found", "left_semi").select("question_id", "seed", "order", "found")


def expand_section_lead(seeds: DataFrame, parents: DataFrame) -> DataFrame:
    """First chunk of the section of each seed that isn't the first itself."""
    live = parents.where("removed_in is null and section_id is not null")
    lead = live.groupBy("document_id", "section_id").agg(F.min(F.struct("chunk_index", "id")).alias("lead"))
    own = live.select(F.col("id").alias("parent_id"), "document_id", "section_id")
    hit = seeds.join(own, "parent_id").join(lead, ["document_id", "section_id"]).where(F.col("lead.id") != F.col("parent_id"))
    return hit.select("question_id", "seed", F.lit(0).alias("order"), F.col("lead.id").alias("found"))


def expand_chapter(seeds: DataFrame, parents: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """Chunks under the same first heading, by chunk_index, for questions about a process or an overview."""
    asks = questions.where(F.lower("text").rlike(r"process|step|flow|procedure|overview|policy|guide|sop")).select("question_id")
    live = parents.where("removed_in is null and not (is_toc <=> true) and chapter is not null")
    own = live.select(F.col("id").alias("parent_id"), "document_id", "chapter")
    others = live.select("document_id", "chapter", F.col("id").alias("found"), "chunk_index")
    # the first of a chapter, before it meets the seeds: a long chapter is cut where it lies
    first = others.withColumn("order", F.row_number().over(Window.partitionBy("document_id", "chapter").orderBy("chunk_index", "found")) - 1).where(F.col("order") < limit)
    return seeds.join(asks, "question_id", "left_semi").join(own, "parent_id").join(first, ["document_id", "chapter"]).select("question_id", "seed", "order", "found")


def expand_table_continuation(seeds: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """Chunks that share a table with a seed, the first ``limit`` of each table by chunk_index."""
    live = parents.where("removed_in is null").select("document_id", "id", "chunk_index", F.explode(F.array_union("table_ids", "linked_table_ids")).alias("table_id"))
    first = live.withColumn("order", F.row_number().over(Window.partitionBy("document_id", "table_id").orderBy("chunk_index", "id")) - 1)
    own = live.select(F.col("id").alias("parent_id"), "document_id", "table_id").distinct()
    hit = seeds.join(own, "parent_id").join(first.where(F.col("order") < limit + 1), ["document_id", "table_id"]).where(F.col("id") != F.col("parent_id"))
    w = Window.partitionBy("question_id", "seed", "table_id").orderBy("order")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("question_id", "seed", (F.col("n") - 1).alias("order"), F.col("id").alias("found"))


def expand_context(seeds: DataFrame, phases: dict[str, DataFrame], cap: int, parents: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Seeds and expansions in phase order, each chunk once with where it came from, at most ``cap`` per question; with
    ``allowed`` (question_id, document_id), only chunks (of ``parents``) of documents that the question may see."""
    rows = [seeds.select("question_id", F.lit(0).alias("phase"), "seed", F.lit(0).alias("order"), F.col("parent_id").alias("found"), F.lit("search").alias("origin"))]
    rows += [df.select("question_id", F.lit(i + 1).alias("phase"), "seed", "order", "found", F.lit(name).alias("origin")) for i, (name, df) in enumerate(phases.items())]
    at = F.struct("phase", "seed", "order")
    union = united(rows)
    if allowed is not None:
        own = parents.select(F.col("id").alias("found"), "document_id")
        union = union.join(own, "found").join(allowed, ["question_id", "document_id"], "left_semi").drop("document_id")
    once = union.groupBy("question_id", "found").agg(F.min(at).alias("at"), F.min_by("origin", at).alias("origin"))
    w = Window.partitionBy("question_id").orderBy("at", "found")
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap).select("question_id", F.col("found").alias("parent_id"), "origin", "position")


#: References that are followed whatever the question, and texts that are guides to others.
OVERRIDES = r"(?i)(resolution|restatement|amendment|appendix|annex|addendum|tn-\d+)"
GUIDES = r"(?i)(reading guide|where to find what|table of contents|contents|document control)"
NUMBERED = r"(?i)(?:figure|table|note|tn|form|resolution|appendix|section|§)\s*([a-z0-9\.\-_]+)"


def follow_references(seeds: DataFrame, parents: DataFrame, questions: DataFrame, limit: int, known: DataFrame | None = None) -> DataFrame:
    """question_id, seed, order, found: for each reference of a seed that matters, the chunk of its document that best
    defines it, at most ``limit`` per question.

    A reference matters if it is of an overriding kind, if the question cites it, or if a line of a guide or contents
    chunk that has it shares a word of four letters with the question. Of the first five current chunks (by chunk_index)
    that hold it, contents lists go, and one with the reference in its heading (3) or at its start (2) comes first.
    Chunks of ``known`` (question_id, found; by default the seeds) don't count.
    parents: id, document_id, chunk_index, text, search_text, heading, refs (array), is_toc, removed_in.
    """
    own = parents.select(F.col("id").alias("parent_id"), "document_id", "text", "is_toc", F.posexplode("refs").alias("at", "ref"))
    asked = questions.select("question_id", F.lower("text").alias("question"))
    rows = seeds.join(own, "parent_id").join(asked, "question_id").withColumn("ref", F.trim("ref")).withColumn("low", F.lower("ref"))
    number = F.lower(F.coalesce(F.nullif(F.regexp_extract("ref", NUMBERED, 1), F.lit("")), "ref"))
    cited = F.contains("question", "low") | ((F.char_length(number) >= 2) & F.contains("question", number))
    line = F.get(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.col("low"))), F.lit(0))
    guide = F.coalesce("is_toc", F.lit(False)) | F.coalesce("text", F.lit("")).rlike(GUIDES)
    shared = F.exists(F.split(F.lower(line), r"\W+"), lambda w: (F.char_length(w) >= 4) & F.contains(F.col("question"), w))
    rows = rows.where(F.col("ref").rlike(OVERRIDES) | cited | F.coalesce(guide & shared, F.lit(False)))
    pattern = F.when(F.startswith("ref", F.lit("§")), F.trim(F.substr("ref", F.lit(2)))).otherwise(F.col("ref"))
    wanted = rows.withColumn("pattern", F.lower(pattern)).where("char_length(pattern) >= 2").groupBy("question_id", "document_id", "pattern").agg(F.min(F.struct("seed", "at")).alias("place"))
    wanted = stored(wanted, "references")
    live = parents.where("removed_in is null").select(F.col("document_id").alias("scope"), "id", "chunk_index", F.lower("search_text").alias("text"), F.lower(F.coalesce(F.col("heading"), F.lit(""))).alias("head"), F.lower(F.ltrim("text")).alias("start"), "is_toc")
    sought = wanted.withColumnRenamed("document_id", "scope")
    # only documents that are asked about are indexed, each chunk under its document
    held = postings.containing(live.join(sought.select("scope").distinct(), "scope", "left_semi"), sought, (2, 4))
    hit = sought.join(held.withColumnRenamed("id", "found"), ["scope", "pattern"]).withColumnRenamed("scope", "document_id")
    target = Window.partitionBy("question_id", "document_id", "pattern")
    first = hit.withColumn("n", F.row_number().over(target.orderBy("chunk_index", "found"))).where("n <= 5 and not (is_toc <=> true)")
    score = F.when(F.contains("head", "pattern"), 3).otherwise(0) + F.when(F.startswith("start", "pattern"), 2).otherwise(0)
    best = first.groupBy("question_id", "document_id", "pattern").agg(F.min("place").alias("place"), F.min_by("found", F.struct((-score).alias("s"), "n")).alias("found"))
    known = seeds.select("question_id", F.col("parent_id").alias("found")) if known is None else known
    once = best.join(known, ["question_id", "found"], "left_anti").groupBy("question_id", "found").agg(F.min("place").alias("place"))
    w = Window.partitionBy("question_id").orderBy("place", "found")
    return once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("question_id", F.col("place.seed").alias("seed"), (F.col("n") - 1).alias("order"), "found")
