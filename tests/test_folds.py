import random
import time

import pytest

from docloom.functions import folds
from docloom.functions.references import cross_references
from docloom.operators import documents as O
from docloom.operators import evidence as E
from docloom.operators import retrieval as R
from docloom.operators.units import strip_page_furniture
from docloom.plans import documents as plans
from docloom.plans import retrieval, tables


def test_sources_cut_at_blank_lines_past_the_half():
    text = "a" * 70 + "\n\n" + "b" * 60
    assert folds.text_sources(text, 100) == ["a" * 70 + "\n\n", "b" * 60]
    assert folds.text_sources("a" * 30 + "\n\n" + "b" * 100, 100)[0] == "a" * 30 + "\n\n" + "b" * 68
    assert folds.text_sources("") == [""] and "".join(folds.text_sources("xy\n\n" * 9_000)) == "xy\n\n" * 9_000


def units(spark, lines, wide):
    frame = spark.createDataFrame([(1, page, i, t) for i, (page, t) in enumerate(lines)], "doc_id long, page int, line_no int, text string")
    found = O.build_units(frame, spark.createDataFrame([(1, wide)], "doc_id long, wide int")).orderBy("position").collect()
    assert [r.position for r in found] == list(range(len(found)))
    return [(r.kind, r.text, r.page) for r in found]


def test_units(spark):
    lines = [(1, "1. Purpose of this very long line that goes on"), (1, "to the next line. A second sentence ends here."), (2, "VEN-1\tOpen\t5"), (2, "mini-"), (2, "short")]
    assert units(spark, lines, 40) == [("sentence", "1. Purpose of this very long line that goes on to the next line.", 1), ("sentence", "A second sentence ends here.", 1), ("row", "VEN-1 | Open | 5", 2), ("line", "mini-", 2), ("line", "short", 2)]
    assert units(spark, [(1, "well-"), (1, "known fact")], 5) == [("line", "well-known fact", 1)]
    assert units(spark, [], None) == [] and units(spark, [(1, "a b"), (1, "c d")], None) == [("line", "a b", 1), ("line", "c d", 1)]
    assert units(spark, [(3, "x y z"), (4, "goes on"), (4, "a\tb"), (5, "1.2. 3. Then (this). And")], 2) == [("line", "x y z goes on", 3), ("row", "a | b", 4), ("sentence", "1.2. 3.", 5), ("sentence", "Then (this).", 5), ("sentence", "And", 5)]


def test_furniture_counts_pages_without_text(spark):
    rows = [(1, p, n, t) for p in range(1, 9) for n, t in enumerate(["Footer", "body"] if p < 4 else [""])]
    lines = spark.createDataFrame([(d, p, n, t if t != "body" else f"body {p}") for d, p, n, t in rows], "doc_id long, page int, line_no int, text string")
    assert strip_page_furniture(lines).count() == 6
    full = lines.where("text <> ''")
    assert strip_page_furniture(full).count() == 0
    assert strip_page_furniture(full, spark.createDataFrame([(1, 8)], "doc_id long, pages int")).count() == 6


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_kept_in_order_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        assert folds.kept_in_order(a, b) == folds._kept_by_bits([x for x in a if x in b], b) == plain_lcs(a, b)
    for values in (1, 3, 40, 1_000):  # from all alike to hardly any pair
        a, b = ([rng.randrange(values) for _ in range(300)] for _ in "ab")
        assert folds.kept_in_order(a, b) == plain_lcs(a, b)


def test_long_documents_take_time_in_proportion():
    """Fully different, equal, shuffled and boilerplate documents, at two sizes."""
    rng = random.Random(2)

    def took(n):
        same = list(range(n))
        mixed = rng.sample(same, n)
        cases = [(same, [x + n for x in same]), (same, same), (same, mixed), ([x % 5 for x in same[: n // 5]], [x % 7 for x in same[: n // 5]])]
        began = time.perf_counter()
        kept = [folds.kept_in_order(a, b) for a, b in cases]
        assert kept[:2] == [0, n] and 0 < kept[2] < 10 * n**0.5 and kept[3] > n // 20
        return time.perf_counter() - began

    small, large = took(12_500), took(50_000)
    assert large < 3 and large < 16 * small + 0.5


def plain_links(units, chunks):
    """Chunk ids for (text, page) in reading order; chunks: (id, pages, text)."""
    cursor, out = 0, []
    for text, page in units:
        words = folds.match_words(text)

        def holds(chunk):
            own, at, found = folds.match_words(chunk), 0, 0
            for w in words:
                if w in own[at:]:
                    at, found = own.index(w, at) + 1, found + 1
            return found == len(words) if len(words) <= 3 else found / len(words) >= 0.9

        order = [*range(cursor, len(chunks)), *range(cursor)]
        hit = next((i for i in order if words and page in chunks[i][1] and holds(chunks[i][2])), None)
        out.append(None if hit is None else chunks[hit][0])
        cursor = cursor if hit is None else hit
    return out


def linked(spark, units, chunks):
    u = spark.createDataFrame([(1, i, p, t) for i, (t, p) in enumerate(units)], "doc_id long, position int, page int, text string")
    c = spark.createDataFrame([(1, i, n, list(p), t) for n, (i, p, t) in enumerate(chunks)], "doc_id long, chunk_id long, chunk_index int, source_pages array<int>, text string")
    return [r.chunk_id for r in O.link_units(u, c).orderBy("position").collect()]


def test_links_try_the_current_chunk_first(spark):
    chunks = [(11, {1}, "Internal use only"), (12, {1, 2}, "Internal Approval by the CFO (VEN-033) within ten days")]
    units = [("Approval by the CFO", 1), ("Internal", 1), ("(VEN- 033)", 2), ("not there at all here", 2), ("", 1), (None, 1), ("Internal", None)]
    assert linked(spark, units, chunks) == [12, 12, 12, None, None, None, None] == plain_links(units, chunks)


def test_links_against_trying_each_chunk(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    chunks = [(100 + i, {i // 3, i // 3 + rng.randrange(2)}, say(rng.randrange(1, 40))) for i in range(40)]
    units = [(say(rng.randrange(0, 14)), i // 12) for i in range(160)]
    assert linked(spark, units, chunks) == plain_links(units, chunks)


def test_links_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    found = {(r.doc_id, r.position): r.chunk_id for r in plans.linked(spark, sf).collect()}
    chunks, units = {}, {}
    for r in retrieval.parents(spark, sf).orderBy("document_id", "chunk_index").collect():
        chunks.setdefault(r.document_id, []).append((r.id, set(r.source_pages), r.text))
    for r in tables.lines(spark, sf).orderBy("doc_id", "line_no").collect():
        units.setdefault(r.doc_id, []).append((r.line_no, r.page, r.text))
    want = {(d, n): c for d, own in units.items() for (n, _, _), c in zip(own, plain_links([(t, p) for _, p, t in own], chunks.get(d, [])))}
    assert found == want and sum(c is not None for c in want.values()) > len(want) * 0.9


def test_batches_and_splits():
    paragraph = "word " * 30
    found = folds.summary_batches("\n\n".join([paragraph] * 5 + ["tiny"]), 70, lambda t: len(t.split()))
    assert [len(b.split()) for b in found] == [60, 60, 30]
    assert max(len(b.split()) for b in folds.summary_batches("A sentence here. " * 100, 20, lambda t: len(t.split()))) <= 20
    chunks = folds.recursive_split("some words " * 100, 120, 20)
    assert max(map(len, chunks)) <= 120 and all(c in "some words " * 100 for c in chunks) and sum(map(len, chunks)) > 1_000
    assert folds.recursive_split("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]


def test_html():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Title</h1><p>One <b>two</b> <a href='/x'>link</a></p><ul><li>a</li><li>b</li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td></tr></table><img src='q'><script>x()</script></body></html>"
    assert folds.html_to_markdown(html) == "# Title\n\nOne **two** [link](/x)\n\n- a\n- b\n\n| k | v |\n| --- | --- |\n| 1 |  |\n\n[Embedded image 1]"
    assert folds.html_to_markdown(None) == ""


@pytest.mark.parametrize(
    "quote,text,found",
    [
        ("the CFO approves 10,001", "All: The CFO  approves 10,001 units", True),
        ("first piece here ... last piece there", "first piece here and much more in between, last piece there", True),
        ("the board signs orders above ten", "| the board | older row | signs orders above ten |", True),
        ("the board signs orders above 20", "the board signs orders above 10", False),
        ("words that are nowhere to be seen", "something else", False),
    ],
)
def test_quotes(quote, text, found):
    assert E.quote_in_text(quote, text) is found


def test_chain_of_hops(spark):
    plans = spark.createDataFrame([(1, 0, "owner", "who", [], "document"), (1, 1, "boss", "whose", ["owner"], "document"), (1, 2, "committee", "which", ["boss"], "document")], "question_id long, pos int, id string, task string, depends_on array<string>, source string")
    ev = lambda q: [("c1", q)]
    progress = [(1, "owner", "resolved", "Asha", {}, ev("Asha owns it"), ""), (1, "boss", "resolved", "Ben", {"owner": "Someone"}, ev("Asha reports to Ben"), ""), (1, "committee", "resolved", "Audit", {"boss": "Ben"}, ev("Ben sits on Audit"), "")]
    schema = E.PROGRESS
    chunks = spark.createDataFrame([("c1", "Asha owns it. Asha reports to Ben. Ben sits on Audit.")], "id string, text string")

    def run(rows):
        frame = spark.createDataFrame(rows, schema)
        quotes = frame.selectExpr("question_id", "hop_id", "inline(evidence)")
        return {r.hop_id: (r.status, r.reason, r.bindings) for r in E.resolve_hops(plans, frame, E.verify_quotes(quotes, chunks)).collect()}

    bad = run(progress)
    assert [bad[h][1] for h in ("owner", "boss", "committee")] == ["", "invalid_binding", "unresolved_dependency"]
    good = run([progress[0], (*progress[1][:4], {"owner": "asha"}, *progress[1][5:]), progress[2]])
    assert [good[h][0] for h in ("owner", "boss", "committee")] == ["resolved"] * 3 and good["boss"][2] == {"owner": "Asha"}
    # an update overrides what was known, what was known stands otherwise, and quotes keep their order
    old = spark.createDataFrame([progress[0], (*progress[1][:2], "pending", "", None, None, "not_resolved")], schema)
    two = [("c1", "Ben sits on Audit"), ("c1", "Asha reports to Ben")]
    now = spark.createDataFrame([(1, "boss", "resolved", " Ben ", {"owner": "ASHA"}, two, "")], schema)
    quotes = old.unionByName(now).selectExpr("question_id", "hop_id", "inline(evidence)").distinct()
    found = {r.hop_id: r for r in E.resolve_hops(plans, now, E.verify_quotes(quotes, chunks), old).collect()}
    assert [found[h].status for h in ("owner", "boss", "committee")] == ["resolved", "resolved", "pending"]
    assert found["boss"].value == "Ben" and [tuple(e) for e in found["boss"].evidence] == two
    none = run([(1, "owner", "resolved", "Asha", {}, [("c9", "Asha owns it")], ""), (1, "boss", "resolved", "Ben", {}, [], "")])
    assert none["owner"][1] == "missing_chunk" and none["boss"][1] == "unresolved_dependency" and none["committee"][1] == "not_resolved"


@pytest.mark.parametrize(
    "text,found",
    [
        ("see Appendices B, C and D", ["Appendix B", "Appendix C", "Appendix D"]),
        ("Figures 3.1 to 3.4", ["Figure 3.1", "Figure 3.2", "Figure 3.3", "Figure 3.4"]),
        ("Section 7.1, clause 4.2 and Sections 1 and 3", ["§7.1", "§4.2", "§1", "§3"]),
        ("Tables 1 to 99", ["Table 1", "Table 99"]),
        ("the appendix prevails; APPENDIX AND NOTES; resolution within", []),
        ("PP-FT-01 and ST-PL-02, Table 7.1b", ["Table 7.1b", "PP-FT-01", "ST-PL-02"]),
        ("Resolution No. 7 and Resolution BR-12", ["Resolution 7", "Resolution BR-12", "BR-12"]),
        (None, []),
    ],
)
def test_cross_references(text, found):
    assert cross_references(text) == found


def test_follow_references(spark):
    schema = "id long, document_id long, chunk_index int, text string, search_text string, heading string, refs array<string>, is_toc boolean, removed_in int"
    rows = [
        (1, 1, 0, "See Appendix B and Figure 2", "See Appendix B and Figure 2", "Intro", ["Appendix B", "Figure 2"], False, None),
        (2, 1, 1, "A word on Appendix B", "A word on Appendix B", "Body", [], False, None),
        (3, 1, 2, "Appendix B: forms", "Appendix B: forms", "Appendix B", [], False, None),
        (4, 1, 3, "Figure 2 shows", "Figure 2 shows", "Body", [], False, None),
    ]
    seeds = spark.createDataFrame([(7, 1, 1), (8, 1, 1)], "question_id long, seed int, parent_id long")
    questions = spark.createDataFrame([(7, "who signs?"), (8, "what does figure 2 say?")], "question_id long, text string")
    got = sorted((r.question_id, r.order, r.found) for r in R.follow_references(seeds, spark.createDataFrame(rows, schema), questions, 2).collect())
    assert got == [(7, 0, 3), (8, 0, 3), (8, 1, 4)]
