import zlib

from docloom.llm import language
from docloom.llm.common import table

from .helpers import ODD, documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = language.query(spark, SF).toPandas().merge(table(spark, SF, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]).all()
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert abs(held["score"].mean() - (held["lang_pred"] == held["lang"]).mean()) < 0.05
    assert found["score"].between(0, 1).all() and set(found["lang_pred"]) <= {"en", "de", "fr", "es", "und"}


def test_odd_rows(spark):
    docs = documents(spark, ODD + ["12 34 !!", "Ω"] + ["plain english words here"] * 10)
    found = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    n = len(ODD)
    assert [found[i].lang_pred for i in (1, 2, 3, n, n + 1)] == ["und", "und", "und", "und", "en"]
    assert all(found[i].score == 0 for i in (1, 2, 3, n)) and found[n + 5].score > 0
    none = language.fit(docs.limit(0))
    assert language.predict(docs.limit(0), none).count() == 0
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(i, f"plain english words here {i}" if i % 2 else f"und deutsche wörter hier {i}", "en" if i % 2 else "de", "k", 1) for i in range(40)]
    rows += [(7, "plain english words here 7", "en", "k", 1)] * 500 + [(None, "plain english", None, "k", 1), (None, None, "en", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `at` string, share int")
    found = language.predict(docs, language.fit(docs, rows=30)).collect()
    assert len(found) == len(rows) and {r.lang_pred for r in found} == {"en", "de", "und"}
    assert {r.lang_pred for r in found if r.doc_id == 7} == {"en"}
