import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ann
from docloom.llm.common import table


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, q in queries:
        s = (x * np.array(q, float)).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) <= set(want)
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    return np.mean([len({v for _, v, _ in rows} & {v for _, v, _ in want[q]}) / len(want[q]) for q, rows in got.items()])


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = ann.query(spark, sf).collect()
    assert len(found) == sum(map(len, want.values())) and recall(found, want) >= 0.9


def test_copies_odd_vectors_and_few_rows(spark):
    rng = np.random.default_rng(1)
    base = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    same = [(100 + i, [1.0, 0.0, 0.0, 0.5]) for i in range(80)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [1.0]), (206, []), (None, [1.0] * 4), (20, base[20][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in base + same + odd], "vec_id long, embedding array<double>, score string")
    want = brute(base + same, [r for r in base + same if r[0] % 20 == 0], 20)
    for i in (205, 260, 280):  # of another length
        odd.append((i, [1.0, float(i % 7)]))
    frame = frame.unionByName(spark.createDataFrame([(i, v, "x") for i, v in odd[-3:]], frame.schema))
    want |= brute(odd[-3:], [r for r in odd[-3:] if r[0] % 20 == 0], 20)
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(frame.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert recall(ann.search(frame, F.col("vec_id") % 20 == 0).collect(), want) >= 0.9


def test_ties_at_the_cut_go_to_the_smaller_ids(spark):
    rows = [(i, [float(j == i) for j in range(64)]) for i in range(64)]
    frame = spark.createDataFrame([(i, v, i, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, rank int, leaf int, `group` string")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert [v for _, v, _ in sorted(got[40])] == list(range(20))
