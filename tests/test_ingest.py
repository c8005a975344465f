import pytest
from pyspark.sql import functions as F

from docloom.plans.tables import stored
from docloom.sources import snapshots
from docloom.streaming import events as X


def run(spark, rows, ingest, path):
    """The stream's batch function over ``rows``, as often as called."""
    docs = spark.createDataFrame(rows, "document_id long, text string")
    docs.write.mode("append").parquet(f"{path}/in")
    arriving = spark.readStream.schema(docs.schema).parquet(f"{path}/in")
    X.ingest_stream(arriving, ingest, f"{path}/out", f"{path}/checkpoint", stored).awaitTermination()


def found(spark, path, name):
    rows = snapshots.current(spark, f"{path}/out", name)
    return [] if rows is None else sorted((tuple(r) for r in rows.collect()), key=repr)


def words(docs):
    @F.udf("array<string>")
    def split(t):
        if "bad" in t:
            raise ValueError(f"cannot read {t}")
        return t.split()

    return {"words": docs.select("document_id", F.explode(split("text")).alias("word"))}, docs.where("text like 'told%'").select("document_id", F.lit("told").alias("reason"))


def test_a_document_that_raises_fails_alone(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [(i, "bad one" if i in (3, 17) else f"w{i} x") for i in range(20)] + [(20, None), (21, "  "), (22, "told so")]
    run(spark, rows, words, path)
    status = {r[0]: r[1:] for r in found(spark, path, "status")}
    assert {i: s[0] for i, s in status.items() if s[0] == "FAILED"} == dict.fromkeys((3, 17, 20, 21, 22), "FAILED") and len(status) == 23
    assert status[3][1] == "ValueError: cannot read bad one" and status[20][1] == status[21][1] == "no text" and status[22][1] == "told"
    assert {r[0] for r in found(spark, path, "words")} == set(range(23)) - {3, 17, 20, 21}


def test_a_batch_that_runs_twice_leaves_one_copy(spark, tmp_path):
    path = f"file://{tmp_path}"
    run(spark, [(1, "a b"), (2, "c")], words, path)
    once = found(spark, path, "words")
    # the same batch again: its commit is lost, as when the driver stops between the write and the log
    (tmp_path / "checkpoint" / "commits" / "0").unlink()
    for f in (tmp_path / "checkpoint" / "commits").glob(".0.crc"):
        f.unlink()
    run(spark, [(3, "d e")], words, path)
    assert found(spark, path, "words") == sorted([*once, (3, "d"), (3, "e")], key=repr)
    assert len(found(spark, path, "status")) == 3


def test_a_batch_shows_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}"
    run(spark, [(1, "a b")], words, path)
    monkeypatch.setattr(snapshots, "switch", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        run(spark, [(2, "c")], words, path)
    assert [r[0] for r in found(spark, path, "words")] == [1, 1] and len(found(spark, path, "status")) == 1
    monkeypatch.undo()
    run(spark, [(4, "d")], words, path)
    assert {r[0] for r in found(spark, path, "words")} == {1, 2, 4}
