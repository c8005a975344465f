import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle

from .helpers import ODD

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, `count` int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climbed(nodes):
    """The top of a tree and the siblings of each node, level by level as (left, right)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at = [k // 16 for k in at]
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    order = lambda x: (x is not None, x if x is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r, leaf(r[:5])) for r in rows if r[1] == s), key=lambda x: (order(x[0][0]), x[1]))
        trees.append((own, *climbed([h for _, h in own])))
    root, above = climbed([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for (r, h), path in zip(own, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = leaf([*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])]) if hit and r[4] is not None else h
            for left, right in path + up:
                at = sha(left, at, right)
            out.append((r[0], h, subroot, root, sha(*(a + b for a, b in path + up)), at, at == root))
    return sorted(out, key=repr)


def found(spark, rows, monkeypatch=None):
    docs = spark.createDataFrame([(*r[:5], "clash", 1) for r in rows], SCHEMA)
    if monkeypatch:
        monkeypatch.setattr(merkle, "table", lambda *_: docs)
    return sorted((tuple(r) for r in merkle.query(spark, "").collect()), key=repr)


def row(i, source, text="Some Text"):
    return (i, source, "en", len(text or ""), text)


CASES = {
    "a lone leaf": [row(1, "a")],
    "one source, one run": [row(i, None) for i in range(5)],
    "one source, two levels": [row(i, "a") for i in range(17)],
    "one source, three levels": [row(i, "a") for i in range(300)],
    "lone leaves in two sources": [row(1, "b"), row(2, "a")],
    "many sources": [row(i, f"s{i % 37}" if i % 41 else None) for i in range(400)] + [row(1_000 + i, "hot") for i in range(260)],
    "odd rows": [row(i // 2, ["", None, "-", "é", "z"][i % 5], t) for i, t in enumerate(ODD)] + [(None, None, None, None, None)] * 3 + [(None, "z", None, 7, "A"), (3, "z", None, 7, "A"), (3, "z", None, 7, "B")] + [row(9, "z")] * 20,
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_python(spark, case, monkeypatch):
    assert found(spark, CASES[case], monkeypatch) == brute(CASES[case])


def test_copies_of_nodes_in_self_joins(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPREAD", 7)
    rows = [row(i, f"s{i % 3}" if i % 2 else "hot") for i in range(700)]
    assert found(spark, rows, monkeypatch) == brute(rows)


def test_empty_table(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []


def test_paths_prove_leaves_and_nothing_else(spark):
    docs = spark.createDataFrame([(*row(i, f"s{i % 2}"), "clash", 1) for i in range(60)], SCHEMA)
    proofs = merkle.prove(docs)
    wrong = F.unhex(F.sha2(F.concat("leaf", F.lit("x").cast("binary")), 256))
    got = proofs.select((merkle.folded(F.col("leaf"), F.col("path")) == merkle.hexed(F.col("root"))).alias("right"), (merkle.folded(wrong, F.col("path")) == merkle.hexed(F.col("root"))).alias("wrong")).distinct().collect()
    assert [tuple(r) for r in got] == [(True, False)]
