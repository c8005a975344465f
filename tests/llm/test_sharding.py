import zlib

import numpy as np
import pandas as pd

from docloom.llm import sharding
from docloom.llm.common import table

from .helpers import ODD, documents


def check(rows, texts, shards=8):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        by.setdefault(r["shard"], []).append(r)
    for s, got in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in got) == list(range(len(got)))
    return {s: sum(r["size"] for r in got) for s, got in by.items()}


def test_odd_rows(spark):
    check(sharding.shard(documents(spark, ODD)).collect(), ODD)
    assert sharding.shard(documents(spark, ODD).limit(0)).count() == 0


def test_near_equal_with_a_hot_text(spark):
    texts = ["the same text again"] * 3_000 + [f"text {i} " * (i % 40 + 1) for i in range(6_000)]
    sizes = check(sharding.shard(documents(spark, texts)).collect(), texts)
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())


def test_equal_texts_share_a_shard_while_they_fit(spark):
    texts = [f"text {i % 2_000}" for i in range(6_000)]
    rows = sharding.shard(documents(spark, texts)).collect()
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, where.values())) == 1


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """No task sorts more than a few times the rows of a range."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    texts = [f"text {i} " * (i % 7 + 1) for i in range(4_000)]
    met = []
    whole = sharding._ranged
    monkeypatch.setattr(sharding, "_ranged", lambda rows, cuts: met.append(out := whole(rows, cuts)) or out)
    sizes = check(sharding.shard(documents(spark, texts), 8, 4).collect(), texts)
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert len(met[-1][1]) >= 40 and met[-1][1]["n"].max() < 400


def test_rows_that_are_all_alike(spark):
    rows = [(5, "the same text in every row " * 3, "k")] * 4_000
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, `range` string")).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(found) == 4_000 and len(sizes) == 8 and sizes.max() < 1.03 * sizes.min()
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard")["slot"])


def test_null_ids_and_empty_texts(spark):
    rows = [(None, t) for t in ("a b c", None, "d" * 50) for _ in range(1_400)] + [(i, "") for i in range(1_000)]
    found = sharding.shard(spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, weight double, `row` int")).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(found) == len(rows) and len(sizes) == 8 and sizes.max() < 1.05 * sizes.min()
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard")["slot"])


def test_cuts_against_comparing_each_key():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2, 3, (500, 3))
    keys[:5, 1] = sharding.LOWEST
    frame = pd.DataFrame(keys, columns=list(sharding.KEY)).assign(weight=rng.random(500))
    for n in (1, 2, 7, 40):
        cuts = sharding.splitters(frame, n)
        assert cuts == sorted(set(cuts)) and len(cuts) < n + 5
        assert sharding._between(cuts, *keys.T).tolist() == [sum(c <= tuple(k) for c in cuts) for k in keys.tolist()]


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = sharding.query(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len(docs)
    sizes = check(rows, docs)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 2 * max(len((t or "").encode()) + 1 for t in docs.values())
    where = {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, where.values())) == 1
