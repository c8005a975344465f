"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to ``chunk`` characters are one chunk and are encoded where they lie, without a shuffle. Longer texts are
cut into chunks that overlap; the chunks are dealt over all tasks and pre-tokenised there, and two neighbours are
stitched at the first pre-token boundary that both found inside their overlap. From a common boundary on, the pattern
(which never looks back) finds the same pre-tokens whichever side it came from, so by induction from chunk 0 each
stitch is a boundary of the whole text. The segments between stitches are encoded on their own, in parallel, and put
together in order. Pre-tokens that end within ``MARGIN`` characters of a chunk's end aren't trusted, since the pattern
may have wanted to look further. A text in which some neighbours share no trusted boundary (one run of letters longer
than the overlap, say) is encoded in one piece, which gives the same ids. Decoding joins the tokens' raw bytes.

Null text counts as empty: no ids and the digest of nothing. Repeated doc_ids are rows of their own; long ones that also
repeat the text are encoded once and counted.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, table

CHUNK, OVERLAP, MARGIN = 16_384, 1_024, 8
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OUT = "doc_id long, n_tokens long, ids binary, decoded binary"


@functools.cache
def encoder(ranks_path: str, pattern: str):
    """The tiktoken encoder of a rank file, once per process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(ranks_path: str, pattern: str) -> list[bytes]:
    e = encoder(ranks_path, pattern)
    found = [b""] * e.n_vocab
    for b, i in e._mergeable_ranks.items():
        found[i] = b
    return found


@functools.cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Start of each pre-token, and the end of the last one."""
    return [0, *(m.end() for m in splitter(pattern).finditer(text))]


def _encode(texts: list[str], ranks_path: str, pattern: str):
    for ids in encoder(ranks_path, pattern).encode_ordinary_batch(texts, num_threads=1):
        yield np.array(ids, dtype="<u4")


def decode(ids: np.ndarray, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """Raw bytes of the ids, one token's after another's."""
    return b"".join(map(token_bytes(ranks_path, pattern).__getitem__, ids.tolist()))


def _whole(ranks_path: str, pattern: str, digest: bool):
    """Encodes whole texts; with ``digest``, only the digests of ids and decoded bytes are kept."""

    def work(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for at in range(0, len(ids), 64):
                part = [t or "" for t in texts[at : at + 64]]
                coded = list(_encode(part, ranks_path, pattern))
                yield _batch(ids[at : at + 64], [len(x) for x in coded], [x.tobytes() for x in coded], [decode(x, ranks_path, pattern) for x in coded], digest)

    return work


def _batch(doc_ids, n, ids, decoded, digest):
    if digest:
        ids, decoded = ([hashlib.sha256(x).hexdigest() for x in y] for y in (ids, decoded))
    kind = pa.string() if digest else pa.binary()
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], ["doc_id", "n_tokens", "ids", "decoded"])


def encode_decode(docs: DataFrame, ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row of ``docs``: ids as little-endian unsigned 32-bit integers, decoded as
    raw bytes; with ``digest``, lowercase SHA-256 of both instead, so that ids never leave the task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = OUT.replace("binary", "string") if digest else OUT
    short = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk
    whole = rows.where(short).mapInArrow(_whole(ranks_path, pattern, digest), out)
    return whole.unionByName(_long(rows.where(~short), ranks_path, pattern, chunk, overlap, digest, out))


def _long(rows: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, digest: bool, out: str) -> DataFrame:
    """Texts of several chunks. key tells rows apart by doc_id and text; equal rows share it and are counted."""

    def key_of(doc_id: int | None, text: str) -> bytes:
        return hashlib.md5(f"{doc_id}:".encode() + text.encode()).digest()

    def cut(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for i, t in zip(ids, texts):
                key, last = key_of(i, t), (len(t) - 1) // chunk
                for k in range(last + 1):  # one row at a time: a long text never stands in memory many times
                    yield pa.record_batch([pa.array([key]), pa.array([i], pa.int64()), pa.array([k], pa.int32()), pa.array([last], pa.int32()), pa.array([t[k * chunk : (k + 1) * chunk + overlap]])], ["key", "doc_id", "k", "last", "piece"])

    def mark(batches):
        for keys, ks, lasts, pieces in rows_of(batches, "key", "k", "last", "piece"):
            heads, tails, ends = [], [], []
            for k, last, p in zip(ks, lasts, pieces):
                b = boundaries(p, pattern)
                trusted = b if k == last else [x for x in b if x <= len(p) - MARGIN]
                heads.append([k * chunk + x for x in trusted if x < overlap])
                tails.append([k * chunk + x for x in trusted if x >= chunk])
                ends.append(k * chunk + len(p))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ks, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), pa.array(ends, pa.int64())], ["key", "k", "head", "tail", "upto"])

    def encode(batches):
        for keys, ids, copies, ks, starts, ends, apart, pieces in rows_of(batches, "key", "doc_id", "copies", "k", "start", "end", "apart", "piece"):
            # where the text can't be stitched, its own characters go on instead of ids
            part = ["" if x else p[a - k * chunk : b - k * chunk] for x, k, a, b, p in zip(apart, ks, starts, ends, pieces)]
            coded = [p[:chunk].encode() if x else c.tobytes() for x, c, p in zip(apart, _encode(part, ranks_path, pattern), pieces)]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(ks, pa.int32()), pa.array(apart), pa.array(coded, pa.binary())], ["key", "doc_id", "copies", "k", "apart", "coded"])

    def gather(pdf):
        copies, i = int(pdf["copies"].iloc[0]), pdf["doc_id"].iloc[0]
        ids = b"".join(pdf.sort_values("k")["coded"])
        if pdf["apart"].iloc[0]:
            ids = next(_encode([ids.decode()], ranks_path, pattern)).tobytes()
        x = np.frombuffer(ids, "<u4")
        i = None if i is None or i != i else int(i)
        return _batch([i], [len(x)], [ids], [decode(x, ranks_path, pattern)], digest).to_pandas().assign(copies=copies)

    # rows that repeat doc_id and text are counted before the shuffle, so that each chunk is there once
    pieces = rows.mapInArrow(cut, "key binary, doc_id long, k int, last int, piece string")
    chunks = pieces.groupBy("key", "k").agg(F.first("doc_id").alias("doc_id"), F.first("last").alias("last"), F.first("piece").alias("piece"), F.count("*").alias("copies"))
    marks = chunks.mapInArrow(mark, "key binary, k int, head array<long>, tail array<long>, upto long")
    order, every = Window.partitionBy("key").orderBy("k"), Window.partitionBy("key")
    meet = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    starts = marks.select("key", "k", "upto", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(meet).alias("start"))
    stitches = starts.select("key", "k", "start", F.coalesce(F.lead("start").over(order), "upto").alias("end"), F.max(F.col("start").isNull()).over(every).alias("apart"))
    coded = chunks.join(stitches, ["key", "k"]).mapInArrow(encode, "key binary, doc_id long, copies long, k int, apart boolean, coded binary")
    once = coded.groupBy("key").applyInPandas(gather, f"{out}, copies long")
    return once.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
