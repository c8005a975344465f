"""Structure queries on a document longer than any prefix, against SQL twins and by hand."""

import duckdb
import pytest

from docloom import registry

WHOLE = ("d3_contents_lines", "d4_merge_outline", "d4_outline_warnings", "d5_missing_appendices", "d6_appendix_ranges", "d6_appendix_at_page", "d7_document_boundaries", "d11_toc_chunks", "d13_verified_references")


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    rows = [(i, "\n".join(f"word{i}x{k} and more" for k in range(n)), "en", "s", n) for i, n in enumerate((250, 40, 3))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", WHOLE)
def test_matches_sql(spark, long, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{long}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in registry.queries()[name](spark, long).collect())
    assert got == sorted(map(repr, want.fetchall())) and got


def test_no_line_is_left_out(spark, long):
    q = registry.queries()
    assert q["d7_document_boundaries"](spark, long).count() == 293
    lines = {(r.doc_id, r.line_no) for r in q["d3_contents_lines"](spark, long).collect()}
    assert lines == {(i, k) for i, n in enumerate((250, 40, 3)) for k in range(n) if k % 4 != 3}
    # lines 4k name appendix k modulo 26 on page 4k + 1; the first mapping of a letter wins
    outline = {r.idx: r.target_page for r in q["d4_merge_outline"](spark, long).where("doc_id = 0").collect()}
    assert outline[100] == 101 and 104 not in outline and outline[249] == 249
    assert q["d6_appendix_at_page"](spark, long).where("doc_id = 0").count() == 250


def test_references_of_lines_that_begin_otherwise(spark, tmp_path):
    """Only lines that begin with three letters are d13's; the whole twin has all others too. White space is what the SQL takes for it."""
    texts = ["Abc one\n1 two\nÉtude of it\nab\n\n  xyz Nowhere to be found\nab1 cdef\n§ 7", None, "", "é", "Part", "\u00a0abc\n\u3000\n\t\f xyz \r\n\x0babc\nabc \x85"]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    narrow = {(0, 0): ["ABC", "§1"], (0, 5): ["XYZ", "nowhere to be found", "§1"], (4, 0): ["PAR", "§1"], (5, 2): ["XYZ", "§1"], (5, 4): ["ABC", "§1"]}
    others = {(0, 1): ["TWO", "§1"], (0, 2): ["TUD", "§1"], (0, 3): ["§1"], (0, 6): ["CDE", "§1"], (0, 7): ["§1"], (3, 0): ["§1"], (5, 0): ["ABC", "§1"], (5, 1): ["§1"], (5, 3): ["ABC", "§1"]}
    for name, want in (("d13_verified_references", narrow), ("d13_verified_references_whole", narrow | others)):
        rows = registry.queries()[name](spark, str(tmp_path)).select("doc_id", "line_no", "refs").collect()
        assert {(r.doc_id, r.line_no): r.refs for r in rows} == want and len(rows) == len(want)
        assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT doc_id, line_no, refs FROM ({registry.oracle_sql()[name]})").fetchall())
