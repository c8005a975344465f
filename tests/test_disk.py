"""What replacements write and how often they read what they are made of."""

from pathlib import Path

from pyspark.sql import functions as F

from docloom.operators import versioning as V
from docloom.sources import snapshots


def test_a_plan_of_children_is_made_once(spark):
    """Five children: two stay, one of them with a new text, one goes, two come."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = [(1, 11, 5, "kept", False), (2, 12, 5, "kept", True), (3, None, 5, "removed", False), (None, 14, 6, "added", True), (None, 15, 6, "added", None)]
    plan = spark.createDataFrame(rows, "old_id long, new_id long, parent_id long, action string, reembed boolean").withColumn("action", counted("action"))
    current = spark.createDataFrame([(7, i, 5, f"old {i}", i, [0.5], 1, None) for i in (1, 2, 3)], "document_id long, id long, parent_id long, search_text string, chunk_index int, embedding array<float>, added_in int, removed_in int")
    new = spark.createDataFrame([(7, i, f"new {i}", i) for i in (11, 12, 14, 15)], "document_id long, id long, search_text string, chunk_index int")
    told = []
    encode = lambda df: told.append(df) or df.withColumn("embedding", F.array(F.char_length("search_text").cast("float")))
    found = V.apply_children(current, new, plan, spark.createDataFrame([(7, 2, 1)], "document_id long, version int, current_version int"), encode)
    got = {r.id: (r.parent_id, r.search_text, r.chunk_index, r.embedding, r.added_in, r.removed_in) for r in found.collect()}
    assert got == {1: (5, "old 1", 11, [0.5], 1, None), 2: (5, "new 12", 12, [6.0], 1, None), 3: (5, "old 3", 3, [0.5], 1, 2), 14: (6, "new 14", 14, [6.0], 2, None), 15: (6, "new 15", 15, None, 2, None)}
    assert sorted(r.search_text for df in told for r in df.collect()) == ["new 12", "new 14"]
    assert seen.value == 5


def test_saved_folders_are_packed_and_read_their_source_once(spark, tmp_path):
    """A document's rows are replaced beside those of another, and the folders hold no Snappy files."""
    table = lambda *rows: {"t": spark.createDataFrame(rows, "document_id long, text string")}
    path = f"file://{tmp_path}/saved"
    snapshots.replace_documents(spark, path, table((1, "a"), (2, "b")), 1)
    snapshots.replace_documents(spark, path, table((1, "c"), (1, "d")), 1)
    assert sorted((r.document_id, r.text) for r in snapshots.current(spark, path, "t").collect()) == [(1, "c"), (1, "d"), (2, "b")]
    files = [f.name for f in Path(tmp_path, "saved", "data").rglob("*.parquet")]
    assert files and all("zstd" in f for f in files)
