"""Search against plain Python, with several blocks, and the spread of hot keys."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.frames import spread_join
from docloom.operators import postings
from docloom.operators import retrieval as R

CHILD = "id long, parent_id long, document_id long, search_text string, embedding array<float>"
QUERY = "query_id long, embedding array<float>"


def nearest(queries, children, k, allowed=None):
    out = set()
    for q, v in queries:
        found = []
        for c in children:
            if c[4] is not None and (allowed is None or (q, c[2]) in allowed):
                a, b = np.array(v, np.float32).astype(float), np.array(c[4], np.float32).astype(float)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                found.append((round(1 - (a @ b / norm if norm else 0), 12), c[0]))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("block,queries", [(16_384, 4_096), (40, 7)])
def test_nearest_children_whatever_the_blocks(spark, monkeypatch, block, queries, scoped):
    monkeypatch.setattr(R, "CHILD_BLOCK", block)
    monkeypatch.setattr(R, "QUERY_BLOCK", queries)
    monkeypatch.setattr(R, "PIVOTS", 8)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8)) * 4
    vectors = [(centres[i % 6] + rng.standard_normal(8) * (0.3 if i % 5 else 3)).astype(np.float32).tolist() for i in range(400)]
    vectors[5] = vectors[17] = [0.0] * 8
    vectors[30:34] = [vectors[29]] * 4  # ties
    children = [(i, i // 3, i % 11, "", None if i % 50 == 7 else v) for i, v in enumerate(vectors)]
    asked = [(q, vectors[q * 3]) for q in range(20)] + [(99, [0.0] * 8)]
    allowed = {(q, d) for q, _ in asked for d in range(11) if (q + d) % 3 == 0} if scoped else None
    may = spark.createDataFrame(sorted(allowed), "query_id long, document_id long") if scoped else None
    found = R.vector_topk(spark.createDataFrame(asked, QUERY), spark.createDataFrame(children, CHILD).repartition(3), 9, may)
    assert {(r.query_id, r.child_id, r["rank"]) for r in found.collect()} == nearest(asked, children, 9, allowed)


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Of separate groups of vectors, a query meets its own alone."""
    monkeypatch.setattr(R, "CHILD_BLOCK", 50)
    monkeypatch.setattr(R, "PIVOTS", 40)
    rng = np.random.default_rng(4)
    centres = np.eye(6) * 10
    children = [(i, i, 0, "", (centres[i % 6] + rng.standard_normal(6) * 0.01).tolist()) for i in range(600)]
    asked = [(q, (centres[q] + 0.01).tolist()) for q in range(6)]
    met = []
    whole = R._block_search
    monkeypatch.setattr(R, "_block_search", lambda a, *rest: met.append(a) or whole(a, *rest))
    found = R.vector_topk(spark.createDataFrame(asked, QUERY), spark.createDataFrame(children, CHILD), 5)
    assert {(r.query_id, r.child_id, r["rank"]) for r in found.collect()} == nearest(asked, children, 5)
    assert len(met) == 2 and met[1].select("query_id", "pivot").distinct().count() < 6 * 40 / 3


def test_patterns_against_plain_python(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc -")) for _ in range(int(n))) for n in rng.integers(0, 60, 200)] + ["", "ab", "aaaaaaa", "é€abc-é€abc", None]
    patterns = sorted({t[i : i + n] for t in texts[:40] for i in (0, 3) for n in (3, 4, 5, 9) if len(t) >= i + n} | {"aaa", "é€a", "not in any of them", "abcd_", "a%c"})
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "child_id long, parent_id long, text string")
    found = R._occurrences(rows, spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")).collect()
    assert sorted((r.child_id, r.pattern, r.n) for r in found) == sorted((i, p, t.count(p)) for i, t in enumerate(texts) if t for p in patterns if p in t)


def test_a_long_text_is_searched_in_linear_time(spark):
    """A text of 600,000 characters, cut for hashing between them, and one of its own pieces at each cut."""
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefgh é"), 600_000))
    patterns = [text[i : i + 12] for i in (0, 299_990, 599_988)] + ["not in it at all"]
    rows = spark.createDataFrame([(1, 1, text), (2, 2, text[:100] * 2)], "child_id long, parent_id long, text string")
    began = time.time()
    found = R._occurrences(rows, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert time.time() - began < 40
    assert sorted((r.child_id, r.pattern, r.n) for r in found) == sorted((i, p, t.count(p)) for i, t in ((1, text), (2, text[:100] * 2)) for p in patterns if p in t)


def test_texts_are_cut_between_runs(spark, monkeypatch):
    """The same with cuts every few bytes: no run is lost at one."""
    texts = spark.createDataFrame([(i, "ab" * i + "cé" + "xyz" * (9 - i)) for i in range(10)] + [(10, "")], "id long, text string")
    rows = texts.select("id", F.lit(7).cast("long").alias("scope"), F.col("text").cast("binary").alias("text"))
    every, bits = [], b"\xff" * 128
    for chunk in (1 << 20, 4):
        monkeypatch.setattr(postings, "CHUNK", chunk)
        every.append(sorted(map(tuple, postings._runs(rows, (1, 3, 5), bits).collect())))
    want = {(r.id, n, r.text.encode()[i : i + n]) for r in texts.collect() for n in (1, 3, 5) for i in range(len(r.text.encode()) - n + 1)}
    assert every[0] == every[1] == sorted(set(every[0])) and len(every[0]) == len(want)


def test_a_hot_term_is_dealt_over_many_tasks(spark):
    """One word in nine of ten children: no task of the join gets many times the rows of the others."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("child_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 500).cast("string"))).alias("term"))
    asked = spark.createDataFrame([(q, t) for q in range(3) for t in ("hot", "w9", f"w{q}9")], "query_id long, term string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("false", "-1", "8")):
            spark.conf.set(c, v)
        joined = spread_join(rows, asked, "term", F.col("child_id"), heavy=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        got = {(r.query_id, r.child_id) for r in joined.collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    terms = {q: {"hot", "w9", f"w{q}9"} for q in range(3)}
    assert got == {(q, r.child_id) for r in rows.collect() for q in terms if r.term in terms[q]}
    assert len(sizes) == 8 and max(sizes) < 3 * sorted(sizes)[4]
