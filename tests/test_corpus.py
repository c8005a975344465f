"""From pages to context: what chunking writes is what search and expansion read."""

import pytest

from docloom.config import FREE
from docloom.operators import chunking as K
from docloom.operators import retrieval as R
from docloom.plans import chunking
from docloom.plans import corpus as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    parents, children = C.corpus(spark, SF)
    questions = C.stored(C.asked(parents), "questions")
    seeds, context = C.context(questions, parents, children)
    return [df.collect() for df in (parents, questions, seeds, context)]


def test_questions_find_their_own_documents(made):
    parents, questions, seeds, _ = made
    document = {p.id: p.document_id for p in parents}
    found = {}
    for s in seeds:
        found.setdefault(s.question_id, set()).add(document[s.parent_id])
    assert len(found) == len(questions) > 10
    assert sum(q in own for q, own in found.items()) >= 0.9 * len(found)  # pages repeat each other's text


def test_context_follows_what_chunking_wrote(made):
    """Each phase against the parents' own links, in plain Python."""
    parents, questions, seeds, context = made
    by_id = {p.id: p for p in parents}
    tables = lambda p: {*p.table_ids, *p.linked_table_ids}
    first, taken, met = {}, {}, set()
    for s in seeds:
        taken.setdefault(s.question_id, set()).add(s.parent_id)
        if s.seed <= FREE.seeds:
            first.setdefault(s.question_id, []).append(by_id[s.parent_id])
    for r in context:
        p, own = by_id[r.parent_id], first[r.question_id]
        near = {
            "search": r.parent_id in taken[r.question_id],
            "sibling": any(p.id in (s.prev_id, s.next_id) for s in own),
            "section": any(p.document_id == s.document_id and p.section_id == s.section_id and p.chunk_index <= s.chunk_index for s in own),
            "chapter": any(p.document_id == s.document_id and p.chapter == s.chapter for s in own),
            "table": any(p.document_id == s.document_id and tables(p) & tables(s) for s in own),
            "reference": any(p.document_id == s.document_id and any(x.lower().lstrip("§") in p.search_text.lower() for x in s.refs) for s in own),
        }
        assert near[r.origin], r
        met.add(r.origin)
    assert {"search", "sibling"} <= met
    listed = {q: {r.parent_id for r in context if r.question_id == q} for q in first}
    for q, own in first.items():  # nothing that comes first is left out while there is room
        links = {i for s in own for i in (s.prev_id, s.next_id) if i is not None}
        assert taken[q] <= listed[q]
        assert links <= listed[q] or len(listed[q]) == FREE.round_chunks


def test_tables_that_go_on_over_chunks(spark):
    """Every chunk of the customers' tables, in small chunks, as a seed: the other chunks of its tables, against all pairs."""
    pages = C.stored(chunking.pages(spark, SF).where("doc_id >= 1000000000"), "pages")
    built = K.build_chunks(pages, chunking.titles(pages), spark.createDataFrame([], chunking.OUTLINE), C.stored, 200, 60)[0]
    frame = C.stored(built.selectExpr("doc_id * 100000 + chunk_index as id", "doc_id as document_id", "chunk_index", "table_ids", "linked_table_ids", "cast(null as int) as removed_in"), "parents")
    parents = frame.collect()
    seeds = frame.selectExpr("id as question_id", "1 as seed", "id as parent_id")
    found = {(r.question_id, r.order, r.found) for r in R.expand_table_continuation(seeds, frame, 2).collect()}
    want = set()
    for s in parents:
        for t in {*s.table_ids, *s.linked_table_ids}:
            others = sorted((p.chunk_index, p.id) for p in parents if p.document_id == s.document_id and p.id != s.id and t in {*p.table_ids, *p.linked_table_ids})
            want |= {(s.id, n, i) for n, (_, i) in enumerate(others[:2])}
    assert found == want and want
