import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import substrings
from docloom.llm.common import table

from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(i, first.get(x, i))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


def texts():
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    base = [say(rng.randrange(1, 120)) for _ in range(40)]
    passage = say(20)
    out = [*ODD, *base, *base[:10]]
    for t in base * 5:
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(["new", "w1\tw2", ""])
        out.append(" ".join(w) if rng.random() < 0.7 else say(rng.randrange(30)) + "\n" + passage + "  " + say(rng.randrange(30)))
    out += ["same " * n for n in (12, 13, 40, 40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard", [40, 20_000])
def test_against_brute_force(spark, monkeypatch, shard):
    all_texts = texts()
    monkeypatch.setattr(substrings.repeated, "__defaults__", (shard,))
    got = sorted(map(tuple, substrings.digests(documents(spark, all_texts)).collect()))
    want = brute(enumerate(all_texts))
    assert got == want and sum(r[2] > 0 for r in want) > 60


def test_repeated_ids_and_empty_table(spark):
    t = " ".join(f"a{i}" for i in range(30))
    rows = [(1, t), (1, t + " b"), (2, t), (2, "x " * 20), (None, t)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.digests(frame).collect())
    assert got == [(0, 30, 0), (1, 30, 0), (1, 31, 0), (2, 20, 0), (2, 30, 30)]
    assert substrings.digests(frame.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    got = sorted(map(tuple, substrings.query(spark, SF).collect()))
    assert got == brute((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())


def test_blocks_and_long_words_leave_anchors_alone(monkeypatch):
    rng = random.Random(2)
    raw = " ".join(rng.choice(["a", "bb", "é" * 9, "x" * 300, "y" * 5_000, "c"]) + " " * rng.randrange(3) for _ in range(400)).encode()
    data = np.frombuffer(raw + b" " * 90_000 + raw[:200], np.uint8)
    starts, ends = substrings.word_spans(data)
    words = substrings._word_hashes(data, starts, ends)
    assert len(set(words.tolist())) == len({data[a:b].tobytes() for a, b in zip(starts, ends)})
    whole = substrings.anchors(data, starts, ends)
    monkeypatch.setattr(substrings, "_BLOCK", 7)
    substrings._powers.cache_clear()
    parts = substrings.anchors(data, starts, ends)
    substrings._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_equal_hashes_of_different_windows(monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = pa.table({"doc_id": [1, 2, 3], "key": [b"a", b"b", b"c"], "at": [0, 0, 0], "passage": [" ".join(w).encode() for w in (words, words[5:30], words[::-1])]})
    monkeypatch.setattr(substrings, "_hashed", lambda lane, at, n: np.zeros(len(at), np.uint64))
    s = substrings.Shard(rows)
    at, low, high = s.windows()
    assert len(at) == 28 + 28 and (low < high).sum() == 13


def test_cleaned_keeps_columns_of_any_name(spark):
    t = " ".join(f"a{i}" for i in range(30))
    rows = [(i, x, len(x or ""), "k", 7, "e") for i, x in enumerate([t, "b " + t, None, "x"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, `a.b` string, docloom_end int, spans string")
    got = substrings.cleaned(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == sorted([rows[0], (1, "b", 1, "k", 7, "e"), *rows[2:]])


def test_what_the_automaton_lacks_is_not_removed(spark, monkeypatch):
    """Windows lie where the automaton's hits say: without a piece, what only that piece covers stays."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    passage = say(40)
    rows = [(i, f"{say(20)} {passage} {say(20)}") for i in range(4)]
    whole = substrings.Shard.pieces
    seen = []

    def fewer(self, window, first):
        begin, n, earliest, base = whole(self, window, first)
        seen.append(len(begin))
        return begin[1:], n[1:], earliest, base[1:]

    table_of = lambda: pa.table({"shard": [0] * 4, "slot": pa.array([-1] * 4, pa.int32()), "doc_id": [i for i, _ in rows], "key": [b"k"] * 4, "at": [0] * 4, "passage": [t.encode() for _, t in rows]})
    spans = lambda: sorted((r["doc_id"], r["start"], r["stop"]) for r in substrings._locate_cold(table_of()).to_pylist())
    assert spans() == [(i, 20, 60) for i in (1, 2, 3)]
    monkeypatch.setattr(substrings.Shard, "pieces", fewer)
    fewer_words = sum(b - a for _, a, b in spans())
    assert seen[0] > 2 and 0 < fewer_words < 120
