import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import files


def test_corpus_kinds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.MD").write_text("# x")
    (tmp_path / "c.png").write_bytes(b"\x00\x01")
    text = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_corpus(spark, str(tmp_path)).collect()}
    assert text == {"a.txt": "one\ntwo", "b.MD": "# x"}
    raw = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.read_corpus(spark, str(tmp_path), "binary").collect()}
    assert raw["c.png"] == b"\x00\x01" and len(raw) == 3


def test_golden_targets(spark, tmp_path):
    rows = [
        {"id": 1, "question": "q1", "target_parent_chunk_id": "a", "expected_answer": "x", "category": "c"},
        {"id": 2, "question": "q2", "target_parent_chunk_id": ["a", "b"], "category": "c"},
        {"id": 3, "question": "q3", "target_parent_chunk_id": None, "category": "d"},
        {"id": 4, "question": "q4", "target_parent_chunk_id": "PENDING"},
    ]
    (tmp_path / "golden.json").write_text(json.dumps(rows))
    got = {r.question_id: (r.question, list(r.targets), r.category) for r in files.read_golden(spark, str(tmp_path / "golden.json")).collect()}
    assert got == {1: ("q1", ["a"], "c"), 2: ("q2", ["a", "b"], "c"), 3: ("q3", [], "d")}


def rows_of(spark, path, name):
    found = files.saved(spark, path, name)
    return {} if found is None else {r.document_id: r.text for r in found.collect()}


def test_a_document_replaces_itself_alone(spark, tmp_path):
    path = f"file://{tmp_path}"
    make = lambda rows: spark.createDataFrame(rows, "document_id long, text string")
    none = make([])
    assert rows_of(spark, path, "units") == {}
    files.save_chunks(make([(1, "p")]), none, make([(i, "old") for i in range(20)]), path, 4)
    files.save_chunks(none, none, make([(7, "new")]), path, 4)
    assert rows_of(spark, path, "units") == {i: "new" if i == 7 else "old" for i in range(20)}
    assert rows_of(spark, path, "parents") == {1: "p"} and rows_of(spark, path, "children") == {}
    # documents that go, down to the last row of a bucket
    files.save_chunks(none, none, none, path, 4, make([(i, "") for i in range(1, 20)]))
    assert rows_of(spark, path, "units") == {0: "old"} and rows_of(spark, path, "parents") == {}
    files.save_chunks(none, none, none, path, 4)
    assert rows_of(spark, path, "units") == {0: "old"}


def test_a_change_that_fails_midway_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}"
    make = lambda rows: spark.createDataFrame(rows, "document_id long, text string")
    old = make([(i, "old") for i in range(9)])
    files.save_chunks(old, old, old, path, 2)
    new = make([(3, "new"), (4, "new")])

    @F.udf("string")
    def broken(x):
        raise ValueError("no disk")

    with pytest.raises(Exception, match="no disk"):  # parents are written by then, children fail
        files.save_chunks(new, new.withColumn("text", broken("text")), new, path, 2)
    for name in ("parents", "children", "units"):
        assert rows_of(spark, path, name) == {i: "old" for i in range(9)}
    held = files.saved(spark, path, "parents")  # a reader that has begun
    files.save_chunks(new, new, new, path, 2)
    assert {r.text for r in held.collect()} == {"old"}
    for name in ("parents", "children", "units"):
        assert rows_of(spark, path, name) == {i: "new" if i in (3, 4) else "old" for i in range(9)}
