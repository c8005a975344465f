"""Folds that get a document or a page as one row, many rows at a time."""

from docloom.functions import folds
from docloom.operators import documents as O
from docloom.operators import units

UNIT = "doc_id long, position int, hash string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_units_need_no_group_of_their_own(spark):
    """Documents with moved, repeated, added and removed units, one that one side lacks, and one that is as it was."""
    old = {1: "abcabc", 2: "aaa", 3: "xyz", 4: "abc", 6: "q"}
    new = {1: "cabcba", 2: "aba", 3: "xyz", 5: "abc", 6: "r"}
    a, b = (spark.createDataFrame([(d, i, h) for d, t in x.items() for i, h in enumerate(t)], UNIT) for x in (old, new))
    found = O.diff_moved(a, b, units.diff_counts(a, b))
    assert "FlatMap" not in plan(found) and plan(found).count("LocalRelation") + plan(found).count("LogicalRDD") == 4
    want = {d: folds.kept_in_order(list(old.get(d, "")), list(new.get(d, ""))) for d in {*old, *new}}
    assert {r.doc_id: r.kept for r in found.collect()} == want


def test_a_text_goes_to_python_once_a_page(spark):
    rows = [(1, i, i // 4, f"unit number{i} of it") for i in range(12)] + [(1, 12, 9, "unit number1 of it"), (2, 0, 0, None)]
    u = spark.createDataFrame(rows, "doc_id long, position int, page int, text string")
    c = spark.createDataFrame([(1, 100 + k, k, [k // 2, k // 2], " ".join(t for _, i, _, t in rows[:12] if i // 2 == k)) for k in range(6)], "doc_id long, chunk_id long, chunk_index int, source_pages array<int>, text string")
    found = O.link_units(u, c)
    assert "FlatMap" not in plan(found) and "collect_list" in plan(found).split("PythonUDF" if "PythonUDF" in plan(found) else "ArrowEval")[-1]
    assert {(r.doc_id, r.position): r.chunk_id for r in found.collect()} == {(1, i): 100 + i // 2 for i in range(12)} | {(1, 12): None, (2, 0): None}
