"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is 64 bits of majority votes over the XXH64 hashes of a text's word shingles. Two fingerprints that
differ in at most 3 bits, cut into two segments of 32 bits, differ by at most one bit in one of them. So each distinct
fingerprint is indexed under 64 variants - either segment with one of its bits made a wildcard - and two that link
agree in at least one variant, whatever the bit; equal variants meet by hash partitioning and are verified on all 64
bits. Fewer, longer segments keep random meetings rare (31 bits have to agree).

Equal fingerprints are one node, so groups of copies of any size cost one row. Members of a variant are compared in
memory by vector operations and only a spanning forest of their links is emitted, never all pairs; a variant with more
than ``BLOCK`` members is split into blocks and each pair of blocks is its own small group. Components come from
min-label rounds over those forests.

Null and wordless texts have fingerprint zero; under three words, the whole sequence is the one shingle. Repeated
doc_ids: each row has its own fingerprint. Empty table: no rows.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, rows_of, sliced, table
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Most members of a variant that are compared in one group.
BLOCK = 8_192
_STIR = 0x9E3779B97F4A7C15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends, votes, n = ends[shingle - 1 :].tolist(), np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        h = np.array([hashed(joined[a:b], seed) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""

    def work(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def long_fingerprint(text: str | None, shingle: int, n: int, seed: int = SEED) -> np.ndarray:
    """n times 64 bits of majority votes over the word shingles, each 64 over hashes of their own."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(n, np.uint64)
    shingles = (b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    votes, total = np.zeros(64 * n, np.int64), 0
    while len(h := np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in islice(shingles, 1 << 14)), np.uint64)):
        total += len(h)
        for k in range(n):
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64((_STIR * (2 * k + 1)) % (1 << 64) | 1)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_STIR)
            mixed ^= mixed >> np.uint64(32)
            votes[64 * k : 64 * k + 64] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > total, bitorder="little").view("<u8").astype(np.uint64)


def forest(members: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest over the members (distinct, unsigned) that differ in at most ``distance`` bits."""
    found, left = [], members
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            v = stack.pop()
            near = np.bitwise_count(left ^ v) <= distance
            if near.any():
                new = left[near]
                found += [(int(v), int(x)) for x in new]
                stack += list(new)
                left = left[~near]
    return found


def _edges(pairs) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64())], ["a", "b", "variant"])


def _runs(block: int, distance: int):
    """Edges inside each run of equal variants (rows come sorted); members of runs over ``block`` go out unlinked, as
    (a, null, variant)."""

    def pending(keys, fps):
        return pa.record_batch([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(keys)], ["a", "b", "variant"])

    def linked(keys, fps):
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(starts, len(keys)))
        pairs = [np.zeros((0, 2), np.uint64)]
        for size in range(2, min(8, block) + 1):  # short runs, all at once
            at = starts[n == size]
            for i in range(size):
                for j in range(i + 1, size):
                    near = np.bitwise_count(fps[at + i] ^ fps[at + j]) <= distance
                    pairs.append(np.stack([fps[at + i][near], fps[at + j][near]], 1))
        for a, m in zip(starts[n > 8], n[n > 8]):
            if m > block:
                yield pending(keys[a : a + m], fps[a : a + m])
            else:
                pairs.append(np.array(forest(fps[a : a + m], distance), np.uint64).reshape(-1, 2))
        yield _edges(np.concatenate(pairs))

    def work(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) < max(50_000, 2 * block):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
            if cut:
                yield from linked(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > 2 * block:  # a very long run streams through; what is kept of it stays over the limit
                yield pending(keys[: -block - 1], fps[: -block - 1])
                keys, fps = keys[-block - 1 :], fps[-block - 1 :]
        if len(keys):
            yield from linked(keys, fps)

    return work


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): a forest for each variant, in which every link of the
    variant's members is a path."""
    # variant number in the high bits, the segment without its wildcard bit in the low 32
    variants = distinct.select(F.expr("""explode(transform(sequence(0, 63), v ->
        (cast(v as long) * 4294967296L) + ((shiftrightunsigned(fp, if(v < 32, 0, 32)) & 4294967295L) & ~shiftleft(1L, v % 32))))""").alias("variant"), "fp")
    return met(variants, DISTANCE, block)


def met(variants: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the fingerprints fp that share a variant and differ in at most ``distance`` bits, as forests."""
    n = partitions(variants)
    # a group's forests start from its smallest fingerprint whatever the variant, so that they share most of their links
    found = variants.repartition(n, "variant").sortWithinPartitions("variant", "fp").mapInArrow(_runs(block, distance), "a long, b long, variant long")
    found = materialise(found, "variant-links")
    hot = found.where("variant is not null").select("variant", F.col("a").alias("fp"))
    blocks = hot.groupBy("variant").agg(F.ceil(F.count("*") / F.lit(block / 2)).cast("int").alias("n"))
    own = hot.join(blocks, "variant").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = own.select("variant", "fp", F.expr("explode(sequence(0, n - 1))").alias("other"), "own").select("variant", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf):
        return _edges(forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), distance)).to_pandas()[["a", "b"]]

    split = dealt.groupBy("variant", "i", "j").applyInPandas(compare, "a long, b long")
    return found.where("variant is null").select("a", "b").distinct().unionByName(split)


#: For near copies by five-word shingles: parts of 64 bits in a long fingerprint, bits of a segment, and the share of all
#: bits in which two texts of similarity 0.8 may differ.
NEAR_SHINGLE, PARTS, SEGMENT, NEAR_SHARE = 5, 6, 24, 0.155
_NEAR_MOST = int(NEAR_SHARE * 64 * PARTS)
#: A node's id begins with so many bits of its fingerprint. Of two nodes that differ in at most ``_NEAR_MOST`` of all bits,
#: these differ in 8 on average, and in more than ``HEAD_MOST`` once in two million; of unlike ones, in 24 on average.
HEAD, HEAD_MOST = 48, 19
_RUNS = "a long, b long, key long, bits binary"


def _wide(column) -> np.ndarray:
    """Long fingerprints as rows of unsigned 64-bit parts."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, PARTS)


def _segment_values(bits: np.ndarray) -> np.ndarray:
    """Segments of long fingerprints as numbers, one row each."""
    each = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").reshape(len(bits), -1, SEGMENT)
    return each @ (np.int64(1) << np.arange(SEGMENT, dtype=np.int64))


def _segments(batches):
    """Each segment of a node's fingerprint as a key, which equal segments share."""
    for b in sliced(batches):
        value = _segment_values(_wide(b.column(1)))
        n = value.shape[1]
        at = pa.array(np.repeat(np.arange(len(value)), n))
        yield pa.record_batch([pa.array((value + (np.arange(n, dtype=np.int64) << 32)).ravel()), b.column(0).take(at), b.column(1).take(at)], ["key", "label", "bits"])


def _near_variants(batches):
    """Each segment of a node's fingerprint with each of its bits as a wildcard; that bit is the variant's lowest."""
    one = np.int64(1) << np.arange(SEGMENT, dtype=np.int64)
    for b in sliced(batches, 256):
        value = _segment_values(_wide(b.column(2)))
        n = value.shape[1] * SEGMENT
        number = np.arange(n, dtype=np.int64).reshape(1, -1, SEGMENT) << 32
        wild = ((value[:, :, None] & ~one) + number) << 1 | (value[:, :, None] & one != 0)
        at = pa.array(np.repeat(np.arange(len(value)), n))
        yield pa.record_batch([pa.array(wild.ravel()), b.column(0).take(at), b.column(1).take(at)], ["variant", "node", "label"])


#: Runs of so many members are compared all at once, longer ones one by one.
_SHORT = 8


def _apart(block: int):
    """Keys and nodes of the runs (rows come sorted) whose members have different labels and both values of the wildcard bit:
    members with one value have equal segments and have met before. Of those, members stay that have another with the other
    value, another label and a like head beside them. The key is the segment that the more of them have: those are found by it, so
    only the others, who visit it, go on. Runs over ``block`` pass as they are, under keys of their own."""

    def told(v, node, label):
        start = np.flatnonzero(np.append(True, (v[1:] ^ v[:-1]) > 1))
        both = [np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start) for x in (v & 1, label)]
        size, both = np.diff(np.append(start, len(v))), both[0] & both[1]
        kept = np.repeat(size > block, size)
        head = node.view(np.uint64) >> np.uint64(64 - HEAD)
        for m in range(2, _SHORT + 1):
            at = start[both & (size == m)]
            for i in range(m):
                for j in range(i + 1, m):
                    a, b = at + i, at + j
                    like = ((v[a] ^ v[b]) & 1 == 1) & (label[a] != label[b]) & (np.bitwise_count(head[a] ^ head[b]) <= HEAD_MOST)
                    kept[a] |= like
                    kept[b] |= like
        longer = both & (size > _SHORT) & (size <= block)
        for a, m in zip(start[longer], size[longer]):
            own = slice(a, a + m)
            _, group, n = np.unique(label[own], return_inverse=True, return_counts=True)
            for x in np.flatnonzero(group != n.argmax()):  # the largest class meets the others as theirs
                like = (group != group[x]) & ((v[own] ^ v[a + x]) & 1 == 1) & (np.bitwise_count(head[own] ^ head[a + x]) <= HEAD_MOST)
                if like.any():
                    kept[own] |= like
                    kept[a + x] = True
        ones, every = (np.add.reduceat(x.astype(np.int64), start) for x in (kept & (v & 1 == 1), kept))
        host = np.repeat(2 * ones > every, size).astype(np.int64)
        number = v >> 33
        key = (number // SEGMENT << 32) | (v >> 1 & 0xFFFFFFFF) | host << number % SEGMENT
        long = np.repeat(size > block, size)
        key, kept = np.where(long, ~(v >> 1), key), kept & ((v & 1) != host) | long
        return pa.record_batch([pa.array(key[kept]), pa.array(node[kept])], ["key", "node"])

    def work(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, b.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            if len(held[0]) < max(50_000, 2 * block):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1] & ~np.int64(1)))  # the last run may go on
            if cut:
                yield told(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
            if len(held[0]) > 2 * block:  # a very long run streams through; what is kept of it stays over the limit
                yield pa.record_batch([pa.array(~(held[0][: -block - 1] >> 1)), pa.array(held[1][: -block - 1])], ["key", "node"])
                held = [h[-block - 1 :] for h in held]
        if len(held[0]):
            yield told(*held)

    return work


def near_links(label: np.ndarray, bits: np.ndarray, most: int = _NEAR_MOST) -> list[tuple[int, int]]:
    """A forest over labels: those of members that differ in at most ``most`` bits are linked by a path, none else.
    Members of one label count as linked already."""
    names, group = np.unique(label, return_inverse=True)
    root, found = np.arange(len(names)), []
    largest = np.bincount(group).argmax()  # its members meet all others as the others' neighbours
    for v in np.flatnonzero(group != largest) if len(names) > 1 else []:
        side = root[group]
        other = np.flatnonzero(side != side[v])
        if not len(other):
            break
        near = other[np.bitwise_count(bits[other] ^ bits[v]).sum(axis=1) <= most]
        for c, first in zip(*np.unique(side[near], return_index=True)):
            found.append((int(label[v]), int(label[near[first]])))
            root[root == c] = side[v]
    return found


def _near_edges(pairs) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary())], ["a", "b", "key", "bits"])


def _near_runs(block: int):
    """Edges between labels inside each run of equal keys (rows key, label, bits come sorted); members of runs over ``block``
    go out unlinked, as (label, null, key, bits)."""

    def pending(t):
        return pa.record_batch([t.column("label").combine_chunks(), pa.nulls(len(t), pa.int64()), t.column("key").combine_chunks(), t.column("bits").combine_chunks()], ["a", "b", "key", "bits"])

    def linked(t):
        key, label = t.column("key").to_numpy(), t.column("label").to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size, bits = np.diff(np.append(start, len(key))), _wide(t.column("bits"))
        two = start[size == 2]
        two = two[(np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= _NEAR_MOST) & (label[two] != label[two + 1])]
        pairs = np.stack([label[two], label[two + 1]], 1).tolist()
        for a, n in zip(start[size > 2], size[size > 2]):
            if n > block:
                yield pending(t.slice(a, n))
            else:
                pairs += near_links(label[a : a + n], bits[a : a + n])
        yield _near_edges(pairs)

    def work(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < max(10_000, 2 * block):
                continue
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from linked(held.slice(0, cut))
                held = held.slice(cut)
            if len(held) > 2 * block:
                yield pending(held.slice(0, len(held) - block - 1))
                held = held.slice(len(held) - block - 1)
        if held is not None and len(held):
            yield from linked(held)

    return work


def _near_met(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Edges (a, b) between the labels of ``rows`` (key, label, bits) that share a key and lie near each other, as forests;
    the members of a key with more than ``block`` are split, and each pair of parts is a group of its own."""
    n = partitions(rows)
    dealt = rows.repartition(n, "key").sortWithinPartitions("key", "label", "bits")
    found = materialise(dealt.mapInArrow(_near_runs(block), _RUNS), name)
    hot = found.where("key is not null").select("key", F.col("a").alias("label"), "bits")
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block / 2)).cast("int").alias("n"))
    own = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("bits"), F.col("n")).cast("int"))
    pairs = own.select("key", "label", "bits", F.expr("explode(sequence(0, n - 1))").alias("other"), "own").select("key", "label", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_near_edges(near_links(t.column("label").to_numpy(), _wide(t.column("bits"))))]).select(["a", "b"])

    split = pairs.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return found.where("key is null").select("a", "b").distinct().unionByName(split)


def near_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text_hash, component of each row of ``docs`` (doc_id, text): near copies by five-word shingles share one.

    Fingerprints of ``PARTS`` times 64 bits estimate the similarity: texts of Jaccard similarity 0.8 differ in about 15 %
    of the bits. In sixteen segments of 24 bits, such texts mostly differ by at most one bit in some segment, so that
    they share a one-wildcard variant. Distances are taken on all bits, and inside a group whose members share a variant
    each link is a path of its forest, so no link between such texts is lost to neighbours that only look alike in part.

    Fingerprints go along with equal segments first, which joins nearly all of a large group. After that only the groups
    of a variant that still hold different classes are of interest; their members' fingerprints follow them. So most
    variants travel without any, and a large group does not give links for each of its pairs. Rows with equal fingerprints
    are one node, and so are those with equal heads and an equal 16-bit hash of the rest."""

    def work(batches):
        import xxhash

        for ids, texts, hashes in rows_of(sliced(batches), "doc_id", "text", "text_hash"):
            bits = [long_fingerprint(t, NEAR_SHINGLE, PARTS).astype("<u8").tobytes() for t in texts]
            rest = np.array([xxhash.xxh64_intdigest(x) & ((1 << (64 - HEAD)) - 1) for x in bits], np.uint64)
            head = np.array([int.from_bytes(x[:8], "little") >> (64 - HEAD) << (64 - HEAD) for x in bits], np.uint64)
            node = (head | rest).view(np.int64)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(node), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "node", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = materialise(rows.mapInArrow(work, "doc_id long, text_hash long, node long, bits binary"), "long-fingerprints")
    nodes = materialise(own.groupBy("node").agg(F.min("bits").alias("bits")), "fingerprint-nodes")
    equal = components(_near_met(nodes.select("node", "bits").mapInArrow(_segments, "key long, label long, bits binary"), block, "segment-links"))
    joined = nodes.join(equal.withColumnRenamed("node", "own"), nodes["node"] == F.col("own"), "left")
    nodes = materialise(joined.select("node", F.coalesce("label", "node").alias("label"), "bits"), "fingerprint-nodes")
    variants = nodes.select("node", "label", "bits").mapInArrow(_near_variants, "variant long, node long, label long")
    dealt = variants.repartition(partitions(variants), F.shiftright("variant", 1)).sortWithinPartitions("variant")
    visits = materialise(dealt.mapInArrow(_apart(block), "key long, node long"), "variants-apart").distinct()
    hosts = nodes.select("label", "bits").mapInArrow(_segments, "key long, label long, bits binary").join(visits.select("key").distinct(), "key", "left_semi")
    met = visits.join(nodes, "node").select("key", "label", "bits").unionByName(hosts)
    labels = components(_near_met(met, block, "variant-links")).toDF("was", "now")
    classes = nodes.join(labels, nodes["label"] == labels["was"], "left").select("node", F.coalesce("now", "label").alias("component"))
    return own.select("doc_id", "text_hash", "node").join(classes, "node").select("doc_id", "text_hash", "component")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the smallest doc_id (null ones last, then by a hash of
    the text). Texts without words are one class. Rows that repeat doc_id and text leave one."""
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64("text"))
    classes = near_classes(docs).select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_hash", "component")
    kept = classes.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("k"), F.count("*").alias("n")).select("k.*")
    kept = materialise(kept, "near-copies-kept")
    again = classes.groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash")
    # helper columns under names that the input lacks
    id_, hash_, twice = (_unused(docs, x) for x in ("id", "hash", "twice"))
    rows = docs.withColumns({id_: key[0], hash_: key[1]})
    rows = rows.join(kept.join(again.withColumn("twice", F.lit(True)), ["id", "text_hash"], "left").toDF(id_, hash_, twice), [id_, hash_])
    once = rows.where(F.col(twice).isNull()).unionByName(rows.where(F.col(twice).isNotNull()).dropDuplicates([id_, hash_]))
    return once.drop(id_, hash_, twice)


def _unused(docs: DataFrame, name: str) -> str:
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs``."""
    own = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    labels = components(links(nodes))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialise(labelled.join(firsts, "label").select("fp", "component_id"), "components")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
