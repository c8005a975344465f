"""Search and expansion within the documents that a user may see."""

from docloom.config import FREE
from docloom.operators import retrieval as R
from docloom.plans import retrieval as P

SF = "/root/testdata/sf0.001"


def test_search_ranks_only_what_may_be_seen(spark):
    kids = [(i, i, i % 2, f"alpha beta code-{i}", [1.0, i / 10], None, False) for i in range(10)]
    children = spark.createDataFrame(kids, "id long, parent_id long, document_id long, search_text string, embedding array<float>, removed_in int, is_toc boolean")
    asked = spark.createDataFrame([(1, "alpha", ["alpha"], ["code-"], ["alpha beta"], [1.0, 0.0]), (2, "alpha", ["alpha"], ["code-"], ["alpha beta"], [1.0, 0.0]), (3, "alpha", ["alpha"], ["code-"], ["alpha beta"], [1.0, 0.0])], "query_id long, text string, keywords array<string>, identifiers array<string>, entities array<string>, embedding array<float>")
    allowed = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "query_id long, document_id long")
    tiers = R.build_search_tiers(asked)
    want = {(1, 1), (1, 3), (1, 5), (2, 0), (2, 1), (2, 2)}
    for found in (R.vector_topk(asked, children, 3, allowed), R.identifier_match(tiers, children, 3, allowed), R.phrase_match(tiers, children, 3, allowed)):
        assert {(r.query_id, r.child_id) for r in found.collect()} == want
    fused = R.search(asked, children, FREE, allowed).collect()
    assert {(r.query_id, r.parent_id) for r in fused} == {(1, i) for i in range(1, 10, 2)} | {(2, i) for i in range(10)}


def test_five_phases_within_access(spark):
    p = P.parents(spark, SF).cache()
    long = p.groupBy("document_id").count().where("count >= 8").orderBy("document_id").limit(2).collect()
    a, b = (r.document_id for r in long)
    s = spark.createDataFrame([(2, 1, a * 10_000 + 2), (2, 2, b * 10_000 + 2), (4, 1, a * 10_000 + 3)], "question_id long, seed int, parent_id long")
    questions = spark.createDataFrame([(2, "the process"), (4, "nothing")], "question_id long, text string")
    may = spark.createDataFrame([(2, a), (4, a), (4, b)], "question_id long, document_id long")
    got = P.expand(s, p, questions, may).collect()
    assert {r.parent_id // 10_000 for r in got} == {a}
    own = {r.parent_id % 10_000: r.origin for r in sorted(got, key=lambda r: r.position) if r.question_id == 2}
    assert own[2] == "search" and own[1] == "sibling" and own[0] == "section" and own[3] == "chapter" and own[4] == "chapter"
    assert "chapter" not in {r.origin for r in got if r.question_id == 4} and "reference" in {r.origin for r in got}
    assert list(own.values()) == sorted(own.values(), key=["search", "sibling", "section", "chapter", "table", "reference"].index)
