"""Substring deduplication by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A window of a document is repeated if the same word sequence also starts in a
document with a smaller doc_id; the words that repeated windows cover are removed.

Finding candidates: a document's phrases of ``PHRASE`` words are hashed, and of each window the phrases with the
smallest hash are its anchors. Equal windows have equal anchors, so windows can only recur where an anchor does; about a
fifth of the phrases are anchors. Anchors are counted over all documents (smallest and largest doc_id each, combined
before the shuffle), and those of two documents or more are recurring. Around its recurring anchors, a document has
candidate passages: all words of the windows that hold one.

Confirming and locating: a passage goes to the shard of the document in which its anchor occurs first, so all
occurrences of a window meet in one shard and a copied document goes to few. A shard confirms the windows that occur in
two documents and joins neighbours with the same anchor to pieces of 13 to 21 words. It compiles the distinct pieces into
an Aho-Corasick automaton over words and streams its passages through it: a hit says that the piece's windows lie there,
and each piece carries the first document of its windows, which makes them repeated in any later one. (Pieces need about
a quarter of the nodes of single windows, and near copies share all that no edit touches.)

Skew: shards of ordinary first documents are packed to about ``SHARD`` anchors. A first document with more than that
(a large group of near copies, a passage in a third of all documents) is hot: its passages are dealt over slots by
document, and each slot holds the first document besides, so that it can tell by itself what repeats that one. Only
windows that the first document lacks are listed by the slots, confirmed across them by a combined aggregation on their
128-bit hashes, and located in each slot. In an automaton a word is written with a few of ``_DIGIT`` symbols, so that
looking up a branch stays short however many words a shard has.

Memory: texts are hashed in blocks of words; a task holds one text and one shard's or slot's passages.

Null text: no words. Texts of under 13 words: nothing removed. Null doc_id: nothing removed, and nothing held against.
Rows with equal doc_id never repeat each other; each is judged by its own text. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, ragged, rows_of, sliced, table

WINDOW, PHRASE, SHARD = 13, 5, 20_000
_REACH = WINDOW - PHRASE
#: Odd multipliers of the hashes: fixed, arbitrary.
_BYTE, _WORD, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


#: Windows that are hashed at once; words of at most so many bytes are hashed together, longer ones one by one.
_BLOCK, _LONG = 1 << 12, 128
#: Symbols of the automata: a word is a number of so many values for each digit.
_DIGIT = 128


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BYTE and of its inverse modulo 2**64, enough for a block of words."""
    inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
    n = (_BLOCK + WINDOW) * (_LONG + 1)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, m)]).astype(np.uint64)) for m in (_BYTE, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and one past the last byte of each word."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers()
    long = np.flatnonzero(ends - starts > _LONG)
    if len(long):  # without them, and without the white space, the block's words are short enough for the tables
        short = ends - starts <= _LONG
        sizes = (ends - starts)[short]
        close = np.cumsum(sizes)
        out = np.zeros(len(starts), np.uint64)
        out[short] = _word_hashes(data[ragged(starts[short], sizes)], close - sizes, close)
        out[long] = [int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little") for i in long]
        return out
    a, z = int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(ends) else 0
    if z - a >= len(power):  # white space in plenty
        sizes = ends - starts
        close = np.cumsum(sizes)
        return _word_hashes(data[ragged(starts, sizes)], close - sizes, close)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * power[: z - a])])
    return _mixed((sums[ends - a] - sums[starts - a]) * inverse[starts - a])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (words before it) and hashes of the phrases that have the smallest hash of some window, block by block."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for x in range(0, len(starts) - WINDOW + 1, _BLOCK):
        y = min(x + _BLOCK + WINDOW - 1, len(starts))
        words = _word_hashes(data, starts[x:y], ends[x:y])
        n = len(words) - PHRASE + 1
        h = np.zeros(n, np.uint64)
        for j in range(PHRASE):
            h = h * _WORD + words[j : j + n]
        h = _mixed(h)
        m = n - _REACH  # windows
        least = h[:m].copy()
        for j in range(1, _REACH + 1):
            np.minimum(least, h[j : j + m], out=least)
        chosen = np.zeros(n, bool)
        for j in range(_REACH + 1):
            chosen[j : j + m] |= h[j : j + m] == least
        at = np.flatnonzero(chosen)
        places.append(at + x)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 2:  # blocks share phrases
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return at, h


def _anchored(batches):
    for ids, texts in rows_of(sliced(batches), "doc_id", "text"):
        found = []
        for t in texts:
            data = np.frombuffer((t or "").encode(), np.uint8)
            found.append(np.unique(anchors(data, *word_spans(data))[1]))
        n = [len(x) for x in found]
        yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), n))], ["h", "doc_id"])


def _passages(batches):
    """The candidate passages of each document: from ``at`` words on, bytes from its first to its last word."""
    for ids, texts, marks in rows_of(sliced(batches), "doc_id", "text", "marks"):
        out: list[tuple] = []
        for i, t, m in zip(ids, texts, marks):
            if not m:
                continue
            raw = t.encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends = word_spans(data)
            at, h = anchors(data, starts, ends)
            known = np.array([x["h"] for x in m], np.int64)
            order = np.argsort(known)
            low, high = (np.searchsorted(known[order], h.view(np.int64), side=x) for x in ("left", "right"))
            at, place = np.repeat(at, high - low), order[ragged(low, high - low)]  # a hot first document has a mark for each slot
            shard, slot = np.array([x["shard"] for x in m], np.int64)[place], np.array([x["slot"] for x in m], np.int32)[place]
            key = hashlib.blake2b(raw, digest_size=8).digest()
            for s, k in sorted(set(zip(shard.tolist(), slot.tolist()))):
                own = at[(shard == s) & (slot == k)]
                a, b = np.maximum(own - _REACH, 0), np.minimum(own + WINDOW, len(starts))
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                for x, y in zip(a[new], b[np.append(new[1:], len(a)) - 1]):
                    out.append((s, k, i, key, int(x), raw[starts[x] : ends[y - 1]]))
        for k in range(0, len(out), 2_000):
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out[k : k + 2_000]), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["shard", "slot", "doc_id", "key", "at", "passage"])


class Shard:
    """The passages of one shard: their words as numbers, one passage after another, and their distinct windows."""

    def __init__(self, rows: pa.Table):
        split = pc.ascii_split_whitespace(rows["passage"].combine_chunks().cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        self.rows, self.vocabulary, self.word = rows, coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.begin = split.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(self.begin)
        self.row = np.repeat(np.arange(len(sizes)), sizes)  # each word's passage
        #: where windows start
        self.at = ragged(self.begin[:-1], np.maximum(sizes - WINDOW + 1, 0))
        self.doc = rows["doc_id"].to_numpy()[self.row[self.at]]
        self.lane = _column_hashes(self.vocabulary)[self.word]
        h = _hashed(self.lane, self.at, WINDOW)
        order = np.argsort(h)
        h = h[order]
        new = np.append(True, h[1:] != h[:-1])[: len(order)]
        # hashes bring equal windows together; the words decide
        again = np.flatnonzero(~new)
        one, like = self.at[order[again]], self.at[order[np.flatnonzero(new)[np.cumsum(new)[again] - 1]]]
        if any((self.word[one + j] != self.word[like + j]).any() for j in range(WINDOW)):
            group = np.unique(self.word[self.at[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(group, kind="stable")
            new = np.append(True, np.diff(group[order]) > 0)
        self.order, self.first_of = order, np.flatnonzero(new)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct window first stands, and its smallest and largest doc_id."""
        if not len(self.order):
            return (np.zeros(0, np.int64),) * 3
        doc = self.doc[self.order]
        return self.order[self.first_of], np.minimum.reduceat(doc, self.first_of), np.maximum.reduceat(doc, self.first_of)

    def hashes(self, at: np.ndarray) -> list[bytes]:
        """128-bit hashes of the words of windows."""
        raw = [hashlib.blake2b(w.encode(), digest_size=16).digest() for w in self.vocabulary.to_pylist()]
        lanes = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, 2)[self.word]
        both = np.stack([_hashed(np.ascontiguousarray(x), self.at[at], WINDOW) for x in lanes.T], 1)
        return [x.tobytes() for x in both]

    def pieces(self, window: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the automaton holds: each distinct piece's first word and number of windows, the first documents of all these
        windows one after another, and where each piece's begin.

        A piece is a run of confirmed windows (numbers of self.at, with their first documents in ``first``) that follow each
        other in a text and have one anchor, so at most ``_REACH`` + 1 of them. Copies with an edit have the same pieces
        elsewhere."""
        none = np.iinfo(np.int64).max
        number = np.zeros(len(self.order), np.int64)
        number[self.first_of] = 1
        member = np.empty(len(self.order), np.int64)
        member[self.order] = np.cumsum(number) - 1
        known = np.full(len(self.first_of), none)
        known[member[window]] = first
        earliest = known[member]  # the first document of the window at each place, if it is confirmed
        # each window's anchor: the place of its phrase with the least hash
        phrase = _hashed(self.lane, np.arange(max(len(self.word) - PHRASE + 1, 0)), PHRASE)
        least, anchor = phrase[self.at], self.at.copy()
        for j in range(1, _REACH + 1):
            h = phrase[self.at + j]
            lower = h < least
            least[lower], anchor[lower] = h[lower], self.at[lower] + j
        confirmed = earliest < none
        goes_on = np.append(False, confirmed[1:] & confirmed[:-1] & (self.at[1:] == self.at[:-1] + 1) & (anchor[1:] == anchor[:-1]))
        start = np.flatnonzero(confirmed & ~goes_on)
        stop = np.append(start[1:], len(self.at))[: len(start)]
        n = np.add.reduceat(confirmed.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        assert (n <= stop - start).all() and (n <= _REACH + 1).all()
        # its first and its last window hold all words of a piece
        _, own = np.unique(np.stack([member[start], member[start + n - 1], n], 1), axis=0, return_index=True)
        start, n = start[own], n[own]
        return self.at[start], n, earliest[ragged(start, n)], np.cumsum(n) - n

    def locate(self, window: np.ndarray, first: np.ndarray) -> pa.Table:
        """Words [start, stop) of each row that confirmed windows of earlier documents cover: an automaton of the pieces
        streams the passages, and its hits say where windows lie and which document has them first."""
        import ahocorasick

        doc_id, at = self.rows["doc_id"].to_numpy(), self.rows["at"].to_numpy()
        begin, n, earliest, base = self.pieces(window, first)
        if not len(begin):
            return SPANS_ARROW.empty_table()
        # words of the pieces get numbers, written with few symbols so that no node has many branches
        length = n + WINDOW - 1
        used, number = np.unique(self.word[ragged(begin, length)], return_inverse=True)
        digits = 1
        while _DIGIT**digits < len(used):
            digits += 1
        step = _DIGIT ** np.arange(digits)
        symbols = lambda x: (x[..., None] // step % _DIGIT + 1 + _DIGIT * np.arange(digits)).astype("<u4")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        written, stops = symbols(number).tobytes().decode("utf-32-le"), (np.cumsum(length) * digits).tolist()
        for k, (a, z) in enumerate(zip([0, *stops], stops)):
            automaton.add_word(written[a:z], k)
        automaton.make_automaton()
        code = np.full(len(self.vocabulary), -1, np.int64)
        code[used] = np.arange(len(used))
        own = code[self.word]
        text = symbols(own)
        text[own < 0] = 0  # in no piece
        hits = np.array(list(automaton.iter(text.tobytes().decode("utf-32-le"))), np.int64).reshape(-1, 2)
        last, piece = hits[:, 0] // digits, hits[:, 1]
        start = last - length[piece] + 1
        inside = self.row[start] == self.row[last]  # not from one passage into the next
        start, piece = start[inside], piece[inside]
        covered, document = ragged(start, n[piece]), earliest[ragged(base[piece], n[piece])]
        start = np.unique(covered[document < doc_id[self.row[covered]]])
        row = self.row[start]
        # windows of a row that overlap or touch are one span
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + WINDOW))[: len(row)])
        last = np.append(new[1:], len(row))[: len(new)] - 1
        found, low, high = row[new], start[new] - self.begin[row[new]], start[last] + WINDOW - self.begin[row[new]]
        return pa.table([pa.array(doc_id[found]), self.rows["key"].combine_chunks().take(pa.array(found)), pa.array(at[found] + low), pa.array(at[found] + high)], schema=SPANS_ARROW)


def _hashed(lane: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, from hashes of words."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _WORD + lane[at + j]
        out ^= out >> np.uint64(29)
    return _mixed(out)


def _column_hashes(words: pa.StringArray) -> np.ndarray:
    """Hash of each word of a column."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if ends[-1] else np.zeros(0, np.uint8)
    parts = [_word_hashes(data, ends[:-1][k : k + _BLOCK], ends[1:][k : k + _BLOCK]) for k in range(0, len(words), _BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])
SPANS = "doc_id long, key binary, start long, stop long"


def _locate_cold(rows: pa.Table) -> pa.Table:
    s = Shard(rows)
    at, low, high = s.windows()
    return s.locate(at[low < high], low[low < high])


WINDOWS_ARROW = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("hash", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])


def _list_windows(rows: pa.Table) -> pa.Table:
    """The slot's windows but those of the shard's first document, which it knows whole."""
    s = Shard(rows)
    at, low, high = s.windows()
    at, low, high = (x[low != rows["shard"][0].as_py()] for x in (at, low, high))
    whole = [pa.array(np.full(len(at), rows[c][0].as_py()), kind) for c, kind in (("shard", pa.int64()), ("slot", pa.int32()))]
    return pa.table([*whole, pa.array(s.hashes(at), pa.binary()), pa.array(low), pa.array(high)], schema=WINDOWS_ARROW)


def _locate_hot(rows: pa.Table, confirmed: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return SPANS_ARROW.empty_table()
    s = Shard(rows)
    at, low, high = s.windows()
    first = rows["shard"][0].as_py()
    known, others = (low == first) & (low < high), np.flatnonzero(low != first)
    if confirmed.num_rows:
        told = dict(zip(confirmed["hash"].to_pylist(), confirmed["first"].to_pylist()))
        for i, h in zip(others.tolist(), s.hashes(at[others])):
            if h in told:
                low[i], known[i] = told[h], True
    return s.locate(at[known], low[known])


def repeated(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The columns of ``docs`` and spans, an array of struct<key, start, stop> of repeated words, in which key tells rows
    with equal doc_id apart; null if there are none. Columns but doc_id and text may have any name except ``spans``."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    n = partitions(docs)
    texts = rows.where("doc_id is not null").select("doc_id", "text")
    marks = materialise(texts.mapInArrow(_anchored, "h long, doc_id long"), "anchors")
    counted = marks.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    recurring = materialise(counted.where("first < last").select("h", "first"), "recurring-anchors")
    found = materialise(marks.join(recurring, "h").select("doc_id", "h", "first"), "anchored")
    sizes = found.groupBy("first").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id") == F.col("first")).alias("own")).where(F.col("n") > shard)
    # a hot document's slots are small, but not smaller than the document itself, which each of them holds
    slots = F.ceil(F.col("n") / F.greatest(F.lit(shard / 8), F.col("own"))).cast("int")
    hot = materialise(sizes.select("first", slots.alias("slots")), "hot-documents")
    any_hot = hot.limit(1).count() > 0
    packs = max(n, found.count() // shard + 1)
    cold = (F.pmod(F.xxhash64("first"), F.lit(packs)), F.lit(-1))
    if any_hot:
        own_slot = F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int")
        every = F.when(F.col("slots").isNull(), F.array(F.lit(-1))).when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array(own_slot))
        found = found.join(hot, "first", "left").withColumn("slot", F.explode(every))
        cold = (F.when(F.col("slots").isNull(), cold[0]).otherwise(F.col("first")), F.col("slot"))
    lists = found.select("doc_id", F.struct("h", cold[0].alias("shard"), cold[1].cast("int").alias("slot")).alias("m")).groupBy("doc_id").agg(F.collect_list("m").alias("marks"))
    passages = materialise(texts.join(lists, "doc_id").mapInArrow(_passages, "shard long, slot int, doc_id long, key binary, at long, passage binary"), "passages")
    spans = passages.where("slot = -1").repartition(n, "shard").groupBy("shard").applyInArrow(_locate_cold, SPANS)
    if any_hot:
        hot_passages = passages.where("slot >= 0").repartition(n, "shard", "slot")
        windows = materialise(hot_passages.groupBy("shard", "slot").applyInArrow(_list_windows, "shard long, slot int, hash binary, low long, high long"), "hot-windows")
        first = windows.groupBy("shard", "hash").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last")
        confirmed = windows.select("shard", "slot", "hash").join(first, ["shard", "hash"]).select("shard", "slot", "hash", "first")
        spans = spans.unionByName(hot_passages.groupBy("shard", "slot").cogroup(confirmed.groupBy("shard", "slot")).applyInArrow(_locate_hot, SPANS))
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "stop")).alias("spans"))
    return rows.join(listed, "doc_id", "left")


def _kept(text: str | None, spans) -> tuple[list[bytes], int]:
    """The words kept, and how many there were."""
    raw = (text or "").encode()
    words = raw.split()
    if not spans:
        return words, len(words)
    key, kept = hashlib.blake2b(raw, digest_size=8).digest(), np.ones(len(words), bool)
    for s in spans:
        if s["key"] == key:
            kept[s["start"] : s["stop"]] = False
    return [words[i] for i in np.flatnonzero(kept)], len(words)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``."""

    def work(batches):
        for ids, texts, spans in rows_of(sliced(batches), "doc_id", "text", "spans"):
            found = [_kept(t, s) for t, s in zip(texts, spans)]
            n = [m for _, m in found]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array([m - len(k) for k, m in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in found])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with each text that loses words replaced by what is left of it, joined by blanks; n_chars, where there
    is such a column, follows. Other columns may have any name."""

    def work(batches):
        for b in sliced(batches):
            (texts, spans), out = next(rows_of([b], "text", "spans")), []
            for t, s in zip(texts, spans):
                kept, n = _kept(t, s)
                out.append(t if len(kept) == n else b" ".join(kept).decode())
            at = b.schema.names.index
            yield pa.record_batch([b.column(at("doc_id")), pa.array(out, pa.string()), b.column(at("rest"))], ["doc_id", "text", "rest"])

    # other columns travel under numbers, so that none clashes with the names used here
    named = docs.toDF(*(c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)))
    others = [c for c in named.columns if c not in ("doc_id", "text")]
    rows = repeated(named.select("doc_id", "text", F.struct(F.lit(0).alias("c"), *others).alias("rest"))).select("doc_id", "text", "rest", "spans")
    out = rows.mapInArrow(work, rows.drop("spans").schema)
    n_chars = F.char_length("text")
    columns = [F.col(c) if c == "text" else F.col(c).cast(docs.schema[i].dataType) if c == "doc_id" else (F.coalesce(n_chars.cast(docs.schema[i].dataType), F.col("rest").getField(c)) if docs.columns[i] == "n_chars" else F.col("rest").getField(c)) for i, c in enumerate(named.columns)]
    return out.select(*(c.alias(name) for c, name in zip(columns, docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(generate_series(0, {WINDOW - 1})) AS k FROM windows JOIN firsts USING (g) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
