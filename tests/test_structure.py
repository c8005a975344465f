import random

from pyspark.sql import functions as F

from docloom.operators import postings
from docloom.operators import structure as D

OUTLINE = "doc_id long, idx int, code string, title string, target_page int, page_count int"


def test_outline_first_mapping_wins_and_the_rest_are_warnings(spark):
    rows = [
        (1, 0, "1.2", "How to read", 3, None), (1, 1, "", "1.2 How to read", 3, 2), (1, 2, "", "1.2 - How to read", 4, None), (1, 3, "", "Appendix A - Glossary", 20, None), (1, 4, "A", "Appendix A", 21, None),
        (1, 5, "", "Too far", 99, None), (1, 6, "", "Too long", 29, 5), (1, 7, "", "No page", None, None),
    ]
    outline, warnings = D.merge_outline(spark.createDataFrame(rows, OUTLINE), spark.createDataFrame([(1, 30)], "doc_id long, total_pages int"))
    got = {r.idx: (r.target_page, r.page_count) for r in outline.collect()}
    assert got == {0: (3, 2), 3: (20, None)}
    assert sorted((r.idx, r.type) for r in warnings.collect()) == [(2, "conflict"), (4, "conflict"), (5, "invalid_page"), (6, "invalid_range")]


def test_appendix_ranges(spark):
    rows = [(1, 0, "", "Appendix A", 18, None), (1, 1, "", "Appendix B", 20, 5), (1, 2, "B.1", "Inside", 21, None), (1, 3, "", "Appendix C", 22, None), (1, 4, "", "Annexure E", 30, None), (1, 5, "", "Annexure F", 30, None)]
    ranges = D.appendix_ranges(spark.createDataFrame(rows, OUTLINE), spark.createDataFrame([(1, 40)], "doc_id long, total_pages int"))
    assert {r.idx: (r["first"], r["last"]) for r in ranges.collect()} == {0: (18, 19), 1: (20, 21), 3: (22, 29), 4: (30, 30), 5: (30, 40)}
    pages = spark.createDataFrame([(1, p) for p in (17, 21, 22, 30, 31)], "doc_id long, page int")
    assert {r.page: r.appendix for r in D.appendix_at_page(pages, ranges).collect()} == {17: None, 21: "Appendix B", 22: "Appendix C", 30: "Annexure E", 31: "Annexure F"}


def test_boundaries(spark):
    pages = [(1, 1, "# Cover\nOffice of the Chief Financial Officer", None, None), (1, 2, "Appendix C: Forms", None, None), (1, 3, "plain", True, " Letter "), (1, 4, "plain", None, None), (1, 5, "\n\n7 Governance rules\nx", None, None), (1, 6, "Form FAT 7", None, None)]
    frame = spark.createDataFrame(pages, "doc_id long, page int, text string, is_boundary boolean, boundary_title string")
    outline = spark.createDataFrame([(1, 0, "", "Appendix Z", 4, None), (1, 1, "7", "Governance", 9, None)], OUTLINE)
    got = {r.page: r.boundary for r in D.document_boundaries(frame, outline).collect()}
    assert got == {1: "CFO restatement letter", 2: "Appendix C: Forms", 3: "Letter", 4: "Appendix Z", 5: "7 - Governance", 6: "Factory acceptance test record"}


def test_titles_and_codes(spark):
    rows = [("E", "Appendix E - Notes"), ("", "A Appendix A - Glossary"), ("1.2", "How to read"), ("3", "3 Scope"), ("B", None), (None, "- **Annex 4** x")]
    frame = spark.createDataFrame(rows, "code string, title string").select(D.outline_title(F.col("code"), F.col("title")).alias("t"), D.entry_appendix(F.col("code"), F.col("title")).alias("a"))
    assert [tuple(r) for r in frame.collect()] == [("Appendix E - Notes", "Appendix E"), ("Appendix A - Glossary", "Appendix A"), ("1.2 - How to read", None), ("3 Scope", None), ("B - ", None), ("- **Annex 4** x", "Annex 4")]


def test_appendix_of_each_page_against_all_ranges(spark):
    """Nested, touching, equal and empty ranges, some of which go on behind others that they hold."""
    rng = random.Random(1)
    ranges = [(d, i, f"A{i}", f := rng.randrange(1, 60), f + rng.randrange(-1, rng.choice((3, 40)))) for d in range(12) for i in range(rng.randrange(1, 14))]
    pages = [(d, p) for d in range(13) for p in range(1, 90)] + [(0, 5), (0, 5)]
    found = D.appendix_at_page(spark.createDataFrame(pages, "doc_id long, page int"), spark.createDataFrame(ranges, "doc_id long, idx int, title string, first int, last int"))
    want = [(d, p, min(((f, i, t) for e, i, t, f, z in ranges if e == d and f <= p <= z), default=(0, 0, None))[2]) for d, p in pages]
    assert sorted((tuple(r) for r in found.select("doc_id", "page", "appendix").collect()), key=repr) == sorted(want, key=repr)
    rows = D.appendix_at_page(spark.createDataFrame(pages, "doc_id long, page int"), spark.createDataFrame([(0, i, "x", 1, 80) for i in range(500)], "doc_id long, idx int, title string, first int, last int"))
    assert "NestedLoop" not in rows._jdf.queryExecution().toString() and rows.where("doc_id = 0 and appendix = 'x'").count() == 82


def test_texts_that_contain_patterns_of_their_scope(spark):
    rng = random.Random(2)
    texts = [(i, i % 3, "".join(rng.choice("abc é") for _ in range(rng.randrange(30)))) for i in range(150)] + [(900, 0, None), (901, None, "abc"), (902, 1, "")]
    patterns = sorted({(s, t[k : k + n]) for _, s, t in texts[:60] for k in (0, 4) for n in (1, 2, 3, 6) if len(t) >= k + n} | {(0, "zz"), (1, "c" * 9), (2, "abcab")})
    found = postings.containing(spark.createDataFrame(texts, "id long, scope int, text string"), spark.createDataFrame(patterns * 2, "scope int, pattern string"))
    assert sorted((r.id, r.pattern) for r in found.collect()) == sorted((i, p) for i, s, t in texts if t for c, p in patterns if c == s and p in t)


def test_boundaries_against_all_entries(spark):
    rng = random.Random(3)
    outline = [(d, i, rng.choice(["", "1", "2.1", "A", "Annex 3"]), rng.choice(["", "Scope of work", "Appendix C - Maps", "Rules", "x", "Schedule of fees"]), rng.choice([None, *range(1, 12)]), None) for d in range(6) for i in range(8)]
    pages = [(d, p, "\n".join(rng.choice(["", "  Scope of work ", "see appendix c - maps", "Rules apply", "plain", "y"]) for _ in range(9)), False, None) for d in range(7) for p in range(1, 12)]
    found = D.document_boundaries(spark.createDataFrame(pages, "doc_id long, page int, text string, is_boundary boolean, boundary_title string"), spark.createDataFrame(outline, OUTLINE))

    def label(code, title):
        return f"{code} - {title}" if code and title and not title.lower().startswith(code.lower()) else title or code

    def listed(d, p, head):
        for e, i, code, title, target, _ in sorted(outline, key=lambda o: o[1]):
            attached = any(w in f"{code} {title}".lower() for w in ("appendix", "annex", "exhibit", "schedule", "attachment", "minutes", "restatement"))
            if e == d and ((attached and target == p) or (code != "2.1" and title and title.lower() in head)):
                return label(code, title)
        return None

    want = {(d, p): listed(d, p, " ".join([x.strip() for x in t.split("\n") if x.strip()][:6]).lower()) for d, p, t, _, _ in pages}
    assert {(r.doc_id, r.page): r.boundary for r in found.collect()} == want and len(set(want.values())) > 5
