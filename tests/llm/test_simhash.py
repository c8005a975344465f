import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash

from .helpers import ODD, documents


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in low.encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    out = [*ODD, *base]
    for t in base * 4:
        w = t.split()
        w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out


def test_against_brute_force(spark):
    all_texts = texts()
    fps = [(i, plain(t)) for i, t in enumerate(all_texts)]
    want = brute(fps)
    got = simhash.cluster(documents(spark, all_texts)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [(i, f"{f:016x}", want[i]) for i, f in fps]
    assert len(set(want.values())) < len(want)
    assert simhash.cluster(documents(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 8_192])
def test_all_links_near_one_point(spark, block):
    rng = random.Random(2)
    fps = set()
    for _ in range(400):
        x = 0x1234567890ABCDEF
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(int(np.array(x, np.uint64).view(np.int64)),) for x in fps], "fp long")
    edges = simhash.links(rows, block)
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    want = brute(list(zip(signed, fps)))
    groups = {}
    for s in signed:
        groups.setdefault(want[s], []).append(s)
    for g in groups.values():
        assert len({labels.get(s, s) for s in g}) == 1
    assert len({labels.get(s, s) for s in signed}) == len(groups)


def test_query_keeps_every_document(spark):
    found = simhash.query(spark, "/root/testdata/sf0.001").toPandas()
    assert found["doc_id"].is_unique and (found["component_id"] <= found["doc_id"]).all()


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_near_copies_by_five_word_shingles(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    base = [say(rng.randrange(60, 500)) for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base * 4:  # copies with words changed at random places
        x = list(w)
        for _ in range(max(1, round(len(x) * rng.uniform(0, 0.022)))):
            x[rng.randrange(len(x))] = "new" + str(rng.randrange(9))
        texts.append(rng.choice([" ", "  ", "\n"]).join(x).replace("w1", "W1"))
    texts += texts[:20] + [" ".join(say(80)) for _ in range(60)] + [None, "", " ", "one", "One", "two words"]
    sets = [shingles(t) for t in texts]
    found = {r.doc_id: r.component for r in simhash.near_classes(documents(spark, texts)).collect()}
    assert len(found) == len(texts)
    near = far = met = 0
    for i in range(len(texts)):
        for j in range(i):
            alike, same = jaccard(sets[i], sets[j]) if sets[i] or sets[j] else 1.0, found[i] == found[j]
            if alike >= 0.8:
                near, met = near + 1, met + same
            elif i >= 300 and not same:
                far += 1
            assert alike < 1 or same
            assert not (same and alike == 0 and (i >= 320 or j >= 320)), (i, j)
    assert near > 300 and met / near > 0.9 and far > 3_000


def joined(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return root


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed", range(6))
def test_forests_lose_no_class(seed):
    """True copies among decoys that look alike in the first 64 bits only; some members share a label beforehand."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 384)
    members = []
    for k in range(60):
        x = base.copy()
        if k % 2:
            x[64:] = rng.integers(0, 2, 320) if k % 3 else x[64:]
        x[rng.choice(384, int(rng.integers(0, 40)), replace=False)] ^= 1
        members.append(x)
    bits = np.packbits(members, axis=1, bitorder="little").view("<u8")
    label = rng.permutation(60) if seed % 2 else rng.integers(0, 25, 60)
    alike = [(i, j) for i in range(60) for j in range(i) if (members[i] != members[j]).sum() <= simhash._NEAR_MOST or label[i] == label[j]]
    first = {int(x): int(np.flatnonzero(label == x)[0]) for x in label}
    linked = [(first[a], first[b]) for a, b in simhash.near_links(label, bits)]
    assert same_partition(joined(60, alike), joined(60, linked + [(i, first[int(x)]) for i, x in enumerate(label)]))
    assert len(linked) < len(set(label.tolist()))


@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_classes_against_all_pairs_that_share_a_variant(spark, block):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 25)):
            x = list(base)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(len(x))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(x))
    prints = np.stack([simhash.long_fingerprint(t, simhash.NEAR_SHINGLE, simhash.PARTS) for t in texts])
    each = np.unpackbits(prints.astype("<u8").view(np.uint8), axis=1, bitorder="little").reshape(len(texts), -1, simhash.SEGMENT)
    pairs = []
    for i in range(len(texts)):
        differ = (each[:i] != each[i]).sum(axis=2)
        pairs += [(i, j) for j in np.flatnonzero((differ.min(axis=1) <= 1) & (differ.sum(axis=1) <= simhash._NEAR_MOST))] if i else []
    found = {r.doc_id: r.component for r in simhash.near_classes(documents(spark, texts), block).collect()}
    assert same_partition(joined(len(texts), pairs), [found[i] for i in range(len(texts))]) and pairs


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, 1, "a"), (2, text + " more", 2, "b"), (None, text, 3, "c"), (2, text + " more", 4, "d"), (7, "other words", 5, "e"), (None, "null id alone", 6, "f"), (None, None, 7, "g"), (9, "", 8, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head int, `id.x` string")
    left = simhash.without_near_copies(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    got = sorted((str(r.doc_id), r.text) for r in left.collect())
    assert got == sorted([("2", text + " more"), ("7", "other words"), ("None", "null id alone"), ("9", "")])
    assert simhash.without_near_copies(docs.limit(0)).count() == 0
    clash = docs.toDF("doc_id", "text", "id", "hash")
    assert sorted(map(str, simhash.without_near_copies(clash).columns)) == ["doc_id", "hash", "id", "text"]
