import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.common import table

from .helpers import ODD, documents


def best_fit(counts, capacity):
    """Plain best-fit decreasing, one piece at a time: the number of sequences."""
    rooms = []
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def checked(plan):
    """The number of sequences, after each rank has been placed once and nothing overlaps or leaves a gap."""
    n = int(plan.first[-1])
    rank = np.arange(n)
    sequence, offset = packing.place(plan.arrays(), rank)
    length = np.searchsorted(plan.first, rank, side="right") - 1
    order = np.lexsort((offset, sequence))
    end, at = 0, -1
    for k in order:
        if sequence[k] != at:
            assert sequence[k] == at + 1 and offset[k] == 0
            at, end = sequence[k], 0
        assert offset[k] == end
        end += length[k]
        assert end <= plan.capacity
    assert at + 1 == plan.n
    return plan.n


@pytest.mark.parametrize("seed", range(12))
def test_plans_against_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 600)))
    if seed % 3 == 0:  # a hot length, and few small ones
        lengths = np.concatenate([lengths[lengths > capacity // 3], np.full(400, capacity // 2 + 1), np.full(400, capacity // 2 - 1)])
    counts = np.bincount(lengths, minlength=capacity + 1)
    for groups in (1, 3, *packing.GROUPS):
        checked(packing.Plan(counts, capacity, groups))
    assert checked(packing.best_plan(counts, capacity)) <= best_fit(counts, capacity) * 1.03 + 1


def test_configurations_reach_the_optimum():
    columns, used = packing.configurations([6, 5, 4], np.array([10.0, 10.0, 20.0]), 10)
    assert abs(used.sum() - 20) < 1e-9 and (columns.T @ [6, 5, 4] <= 10).all()  # ten of 6 + 4, five of 5 + 5, five of 4 + 4
    assert np.allclose(columns @ used, [10, 10, 20])


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes, worth = sorted({int(x) for x in rng.integers(3, 30, 4)}), rng.random(4)
        worth = worth[: len(sizes)]
        best = {0: 0.0}
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - s] + w for s, w in zip(sizes, worth) if s <= room)])
        places, value = packing._knapsack(sizes, worth, 40)
        assert abs(value - best[40]) < 1e-9 and places @ sizes <= 40


def ids_of(texts):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check(rows, texts, capacity=4_096):
    """Pieces are those of the library's ids, and lie in their sequences without gaps."""
    by, held = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (i, ids), own in zip(enumerate(ids_of(texts)), (sorted(by[i], key=lambda r: r["piece"]) for i in range(len(texts)))):
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r["piece"] * capacity : (r["piece"] + 1) * capacity]
            assert (r["start"], r["length"]) == (r["piece"] * capacity, len(part))
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part)), texts[i]
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    assert len(by) == len(texts)
    return len(held)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "table", lambda *_: documents(spark, ODD).repartition(3))
    check(packing.query(spark, "").collect(), ODD)
    monkeypatch.setattr(packing, "table", lambda *_: documents(spark, ODD).limit(0))
    assert packing.query(spark, "").count() == 0


@pytest.mark.parametrize("broadcast", [0, packing.BROADCAST])
def test_small_sequences_with_repeats_and_null_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST", broadcast)
    texts = [f"word {i % 7} " * (i % 23) for i in range(300)] + ["the same text"] * 150
    rows = spark.createDataFrame([(None if i % 3 else 5, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, `length` int, ids string").repartition(5)
    packed = packing.pack(rows, 16)
    whole = packing.sequences(packed).collect()
    ids = sorted(ids_of(texts))
    total = sum(map(len, ids))
    assert sum(r["n_tokens"] for r in whole) == total and max(r["n_tokens"] for r in whole) <= 16
    assert len(whole) <= 1.1 * -(-total // 16)
    found = []
    for r in packed.where("piece = 0").collect():
        found.append(r["ids"])
    assert sorted(found) == sorted(struct.pack(f"<{min(16, len(x))}I", *x[:16]) for x in ids)
    for r in whole:
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["offsets"][0] == 0
    by = {}
    for r in packed.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["ids"]))
    assert {r["sequence_id"]: bytes(r["ids"]) for r in whole} == {k: b"".join(bytes(x) for _, x in sorted(v)) for k, v in by.items()}


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").collect())
    order = sorted(texts)
    rows = [r.asDict() | {"doc_id": order.index(r.doc_id)} for r in packing.query(spark, sf).collect()]
    n = check(rows, [texts[i] for i in order])
    assert n <= -(-sum(r["length"] for r in rows) // 4_096) + 1
