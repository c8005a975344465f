import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import toxicity
from docloom.llm.common import table

from .helpers import ODD, documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = toxicity.query(spark, SF).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    held = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, clean = (held[held["toxic"] == y] for y in (1, 0))
    assert toxic["predicted"].mean() > 0.5 and clean["predicted"].mean() < 0.05


def test_odd_rows(spark):
    docs = documents(spark, ["you stupid moron, you are a worthless idiot!"] * 20 + ["the tree is green and the sky is blue"] * 60 + ODD)
    labels = spark.createDataFrame([(i, 0, int(i < 20)) for i in range(80)] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(found) == 80 + len(ODD)
    assert found[0].predicted == 1 and found[30].predicted == 0
    empty = {found[80 + i].score for i in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).agg({"score": "max"}).first()[0] == 0


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=200), (rng.random(200) < 0.4).astype(float)
    x, v = toxicity.isotonic(s, y)
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(s, x, v).mean() - y.mean()) < 0.1


def test_features_see_masked_words():
    plain, masked = toxicity.features("you stup1d m0ron", {}), toxicity.features("you sane person", {})
    assert plain[17] > 0 and masked[17] == 0


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (60, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(60) < 0.1)).astype(float)
    trees = toxicity.Trees(rounds=1, depth=1, rate=1.0, least=0.0).fit(x, y)
    g, h, best = y.mean() - y, np.full(60, y.mean() * (1 - y.mean())), []
    for f in range(4):
        for c in np.unique(x[:, f])[:-1]:
            sides = [x[:, f] <= c, x[:, f] > c]
            gain = sum(g[i].sum() ** 2 / (h[i].sum() + trees.ridge) for i in sides)
            best.append((gain, f, c, [-g[i].sum() / (h[i].sum() + trees.ridge) for i in sides]))
    _, f, c, values = max(best, key=lambda b: b[0])
    want = np.log(y.mean() / (1 - y.mean())) + np.where(x[:, f] <= c, *values)
    assert np.allclose(trees.margin(x), want)


def test_nothing_to_learn_from_marks_nothing(spark):
    docs = documents(spark, ["you stupid moron"] * 5 + ["a tree"] * 5)
    for toxic in ([1] * 10, [0] * 10, [1] + [0] * 9):
        labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
        found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(found) == 10 and not any(r.predicted for r in found) and len({r.score for r in found}) == 1


def test_repeated_and_null_ids_and_clashing_columns(spark):
    texts = ["you stupid moron, you are a worthless idiot!"] * 20 + ["the tree is green and the sky is blue"] * 60
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(5, texts[5], 0, "k")] * 300 + [(None, texts[0], 0, "k"), (None, None, 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, fold string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(80)] + [(5, 1)] * 50 + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows=70)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) and all(r.predicted == ("stupid" in (t or "")) for r, (_, t, *_) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0))[:5], rows))
    kept = docs.where(~toxicity.is_toxic(F.col("text"), model)).collect()
    assert len(kept) == 61 and {r.fold for r in kept} == {"k"}
