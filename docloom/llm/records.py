"""Token ids as length-delimited binary records.

Documents are encoded where they lie, their ids range-partitioned by doc_id, sorted and written, one data file and one index file per
partition, into a folder that all executors share. A data file is a run of frames:

    length   unsigned 64-bit, of the payload in bytes
    check    unsigned 32-bit, masked CRC-32 of the length's 8 bytes
    payload  the ids, little-endian, 16-bit where the vocabulary fits and 32-bit otherwise
    check    unsigned 32-bit, masked CRC-32 of the payload

A mask (rotate by 15 bits, add a constant) keeps a checksum of data that hold checksums apart. The index file has, for
each record, doc_id (signed 64-bit), offset and number of ids (unsigned 64-bit), so that a reader can seek to records
in shuffled order. A file is written under a name of its own and then renamed, so a task that runs twice, or is lost
with its executor, leaves one whole file. A small manifest (one row per file) gives each file's place in the corpus.

Encoding: an Arrow batch's words are listed once each, plain words are cut into pre-tokens, and the tokenizer encodes
the pre-tokens that a process has not met; words with other characters, or with what may be a special token, it
encodes as they are. ``Words`` says why the ids are those of whole texts.

Null text counts as empty: only the end id. Null doc_ids come first and are read back as null. Rows with equal doc_id
are ordered by the checksum of their ids. Empty table: no files, no rows.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, ragged, rows_of, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Pre-tokens kept per process, beyond which the store starts anew, and bytes of text that are encoded at once.
PIECES_KEPT, SLICE = 500_000, 16 << 20
MASK = 0xA282EAD8
#: Stands for a null doc_id in files.
NO_ID = -(1 << 63)
#: The tokenizer's own rules that the store of pre-tokens relies on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words with any character but visible ASCII ones and the letters from A-grave to y-diaeresis, or with a special token's start.
ODD = r"[^\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]|<\|"
#: The same rule over lower-case plain words, and a blank for the end of a word.
PIECE = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^ 0-9a-zß-öø-ÿ]+| ")
MANIFEST = "file string, first_doc long, first_check long, n_records long, n_tokens long, width int"
RECORDS = "doc_id long, start long, n_tokens long, ids binary"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and the place after it; ValueError if a checksum fails."""
    size, check = struct.unpack_from("<QI", data, at)
    payload = data[at + 12 : at + 12 + size]
    if masked(data[at : at + 8]) != check or len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + size


class Words:
    """The tokenizer of one file in one process, with the ids of the pre-tokens it has met.

    ``plain`` holds if the file's normaliser and pre-tokenizer are the ones below. Only then are words told apart at all:
    white space never lies inside a pre-token, so a text's ids are those of its words. A word of ``PLAIN`` characters
    without ``<|`` has its pre-tokens where ``PIECE`` finds them in lower case, since such words are their own NFC form,
    and each piece stands for itself: piece i has ids flat[start[i] : start[i] + n[i]]. Any other word goes to the
    tokenizer as it is written, and with any other file whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.plain = (made["normalizer"], made["pre_tokenizer"], made["model"]["end_of_word_suffix"]) == (NORMALIZER, PRE_TOKENIZER, "</w>")
        vocabulary = self.tokenizer.get_vocab()
        #: True for the ids that end a pre-token
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {" ": 0}  # the end of a word, which has no ids
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        new = list({p for p in pieces if p not in self.place})
        if len(self.place) + len(new) > PIECES_KEPT:
            self.clear()
            new = list(set(pieces) - {" "})
        for at in range(0, len(new), 8_192):
            part = new[at : at + 8_192]
            ids = np.array(self._library([" ".join(part)])[0], np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a pre-token without an end of its own")
            base = len(self.place)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while base + len(part) > len(self.start):
                self.start, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.n))
            n = np.diff(ends, prepend=0)
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[base : base + len(part)], self.n[base : base + len(part)] = self.used + ends - n, n
            self.place.update(zip(part, range(base, base + len(part))))
            self.used += len(ids)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        if not self.plain:
            found = self._library(texts.to_pylist())
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, start, n = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        many = n[word]
        ends = np.concatenate([[0], np.cumsum(many)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return flat[ragged(start[word], many)], np.diff(ends)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: word i has flat[start[i] : start[i] + n[i]]."""
        odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)
        pieces = PIECE.findall(" ".join(words.filter(pa.array(~odd)).to_pylist()).lower()) if not odd.all() else []
        self._learn(pieces)
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        own, n = self.n[at], np.zeros(len(words), np.int64)
        if not odd.all():
            n[~odd] = np.bincount(np.cumsum(at == 0), own, int((~odd).sum()))
        found = self._library(words.filter(pa.array(odd)).to_pylist())
        n[odd] = [len(x) for x in found]
        flat = np.concatenate([self.flat[ragged(self.start[at], own)], np.array([i for x in found for i in x], np.uint32)])
        order = np.argsort(odd, kind="stable")  # plain words lie first
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return flat, start, n


def _slices(texts: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts, at = [0], 0
    while at < len(total):
        before = total[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        cuts.append(at)
    return list(zip(cuts, cuts[1:]))


@functools.cache
def _words(path: str) -> Words:
    return Words(path)


def _width(words: Words) -> int:
    return 2 if words.tokenizer.get_vocab_size() <= 1 << 16 else 4


def encoded(rows: DataFrame, cuts: list[float], tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, range (by doc_id, between ``cuts``), check and ids (little-endian, 16 or 32 bits each, with the end id)."""

    def work(batches):
        words = _words(tokenizer)
        kind = f"<u{_width(words)}"
        for b in batches:
            doc_id, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for x, y in _slices(text):
                flat, n = words.encode(text.slice(x, y - x))
                out, ends = np.full(len(flat) + len(n), end_id, kind), np.cumsum(n)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                stops = (ends + np.arange(1, len(n) + 1)) * out.itemsize
                data = out.tobytes()
                rows = [data[a:z] for a, z in zip(np.append(0, stops), stops)]
                place = np.searchsorted(np.array(cuts), doc_id.slice(x, y - x).to_numpy().astype(float)).astype(np.int32)
                yield pa.record_batch([doc_id.slice(x, y - x), pa.array(place), pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "range", "check", "ids"])

    return rows.mapInArrow(work, "doc_id long, range int, check long, ids binary")


def write_records(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as records below ``folder`` and returns the manifest, one row per file."""

    def write(batches):
        place, root = fs.FileSystem.from_uri(folder)
        data, index, name, at, n_tokens, head = None, [], uuid.uuid4().hex, 0, 0, None
        own, width = f"{root}/.{name}", _width(_words(tokenizer))
        try:
            for doc_ids, checks, ids in rows_of(batches, "doc_id", "check", "ids"):
                if data is None:
                    place.create_dir(root, recursive=True)
                    data, head = place.open_output_stream(f"{own}.data"), (doc_ids[0], checks[0])
                frames = [frame(x) for x in ids]
                sizes = np.cumsum([at, *map(len, frames)])
                rows = np.zeros(len(ids), INDEX)
                rows["doc_id"], rows["offset"], rows["n"] = doc_ids, sizes[:-1], [len(x) // width for x in ids]
                index.append(rows)
                at, n_tokens = int(sizes[-1]), n_tokens + int(rows["n"].sum())
                data.write(b"".join(frames))
        finally:
            if data is not None:
                data.close()
        if data is not None:
            with place.open_output_stream(f"{own}.index") as out:
                out.write(np.concatenate(index).tobytes())
            for kind in ("index", "data"):
                place.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
            yield pa.record_batch([pa.array([name]), pa.array([head[0]], pa.int64()), pa.array([head[1]], pa.int64()), pa.array([sum(map(len, index))], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([width], pa.int32())], ["file", "first_doc", "first_check", "n_records", "n_tokens", "width"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    # ranges come from a pass over doc_id alone; texts are encoded once, where they lie, and only their ids move
    n = files or partitions(docs)
    cuts = sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    dealt = encoded(rows, cuts, tokenizer, end_id).repartitionById(n, "range").sortWithinPartitions("doc_id", "check")
    manifest = f"{folder}/manifest"
    dealt.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each record of the manifest's files."""

    def read(batches):
        place, root = fs.FileSystem.from_uri(folder)
        for files, bases, widths in rows_of(batches, "file", "base", "width"):
            for file, base, width in zip(files, bases, widths):
                with place.open_input_stream(f"{root}/{file}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                starts = base + np.cumsum(index["n"].astype(np.int64)) - index["n"].astype(np.int64)
                with place.open_input_file(f"{root}/{file}.data") as f:
                    for k in range(0, len(index), 512):
                        part, last = index[k : k + 512], k + 512 >= len(index)
                        first = int(part["offset"][0])
                        f.seek(first)
                        block = f.read((f.size() if last else int(index["offset"][k + 512])) - first)
                        ids = [np.frombuffer(unframe(block, int(o) - first)[0], f"<u{width}") for o in part["offset"]]
                        yield pa.record_batch([pa.array(part["doc_id"], mask=part["doc_id"] == NO_ID), pa.array(starts[k : k + 512]), pa.array(part["n"].astype(np.int64)), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    # one row per file, so the running total over all files is a short sort
    before = Window.orderBy("first_doc", "first_check", "file").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return based.repartition(partitions(manifest), "file").mapInArrow(read, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder)
    return read_records(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
