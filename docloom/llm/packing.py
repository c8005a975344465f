"""Best-fit packing of token ids into sequences of a fixed capacity, by the linear grouping scheme.

Documents are encoded where they lie, end with ``END_ID`` and are cut only where they are longer than the capacity. All
that a packing depends on is how many pieces have which length, a table of at most ``CAPACITY`` rows whatever the corpus,
so the plan is made on the driver from these counts:

1. Pieces over ``LARGE`` of the capacity are ranked by length and cut into groups of equal cardinality; each length is
   rounded up to the longest of its group. That leaves a few sizes. A linear program over configurations (which sizes
   share a sequence) says how often each is used; columns come from a knapsack over the capacity. Multiplicities are
   rounded down. The plan is made for each of ``GROUPS`` numbers of groups and the one with the fewest sequences taken.
2. The pieces of a group fill its places in the configurations, by rank. What a sequence then holds is known by actual
   lengths, so runs of neighbouring sequences with the same room are one entry.
3. What is left of the large pieces, and all small ones, go best-fit in descending length: into the fullest sequence
   with room for one, as many as it takes, then into new sequences.

A plan is a list of runs of ranks: piece ``rank`` of a run lies in sequence ``first + (rank - start) // each`` at a known
offset. Pieces of one length are numbered by the part they were written in and their place there, so no length is
gathered in one task, and each piece finds its place by a search in the plan. The plan grows with the capacity, not with
the corpus (a few thousand runs for 4,096 tokens).

Null text: only the end id. Null and repeated doc_ids: pieces of their own. Empty table: no rows. Columns besides doc_id
and text do no harm.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, rows_of, sliced, table
from .records import _slices, _words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END_ID = 4_096, 1
#: Share of the capacity over which a piece is large, and the numbers of groups that are tried.
LARGE, GROUPS = 1 / 4, (8, 16, 32, 64)
#: Most rows of the table of numbers that are broadcast: beyond, pieces and numbers are joined by a shuffle.
BROADCAST = 1_000_000
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


# ---- the plan, from counts of lengths -------------------------------------------------------------------------------


def configurations(sizes: list[int], wanted: np.ndarray, capacity: int, most: int = 3_000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (places per size) and how often each is used, by the linear program that covers ``wanted`` with the fewest
    sequences: revised simplex, each new column from a knapsack over the capacity. ``sizes`` are positive and distinct."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    used = wanted / np.diag(basis)
    for _ in range(most):
        worth = np.linalg.solve(basis.T, np.ones(n))
        column, value = _knapsack(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        used = np.maximum(used - step * ratio[out], 0)
        used[out], basis[:, out] = ratio[out], column
    return basis.astype(int), used


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Places per size of the most valuable sequence: best[k] is for at most k pieces, by room."""
    best, chosen = [np.zeros(capacity + 1)], []
    for _ in range(capacity // min(sizes)):
        last, value = best[-1], best[-1].copy()
        choice = np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if worth[i] > 0:
                better = last[: capacity + 1 - s] + worth[i] > value[s:] + 1e-12
                value[s:][better] = (last[: capacity + 1 - s] + worth[i])[better]
                choice[s:][better] = i
        if (choice < 0).all():
            break
        best.append(value)
        chosen.append(choice)
    places, room = np.zeros(len(sizes)), capacity
    for choice in reversed(chosen):
        if choice[room] >= 0:
            places[choice[room]] += 1
            room -= sizes[choice[room]]
    return places, float(worth @ places)


class Plan:
    """Runs of ranks with their places; ``counts[l]`` pieces have length l, and ranks ascend by length."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS[0], large: float = LARGE):
        self.capacity, self.n = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  # rank of the first piece of a length
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs (sequence, how many) by the room left
        low, high = int(self.first[int(capacity * large) + 1]), int(self.first[-1])
        left = self._grouped(low, high, groups) if high > low else []
        small = [(l, int(self.first[l]), int(counts[l])) for l in range(1, int(capacity * large) + 1) if counts[l]]
        for length, rank, n in sorted(left + small, reverse=True):
            self._best_fit(length, rank, n)

    def _parts(self, low: int, high: int) -> list[tuple[int, int, int]]:
        """The ranks low .. high - 1 as (length, first rank, how many)."""
        out = []
        while low < high:
            length = int(np.searchsorted(self.first, low, side="right")) - 1
            end = min(high, int(self.first[length + 1]))
            out.append((length, low, end - low))
            low = end
        return out

    def _grouped(self, low: int, high: int, groups: int) -> list[tuple[int, int, int]]:
        """Places for large pieces in configurations; returns the pieces left over."""
        cuts = sorted({low + (high - low) * k // groups for k in range(1, groups + 1)})
        ends: dict[int, int] = {}  # groups rounded to the same length are one
        for c in cuts:
            ends[int(np.searchsorted(self.first, c - 1, side="right")) - 1] = c
        sizes, stops = list(ends), list(ends.values())
        at = [low, *stops[:-1]]
        columns, used = configurations(sizes, np.diff([low, *stops]).astype(float), self.capacity)
        for k in np.argsort(-used):
            column = columns[:, k]
            own = [i for i in range(len(sizes)) for _ in range(column[i])]
            many = min([int(used[k] + 1e-6), *((stops[i] - at[i]) // column[i] for i in set(own))])
            if many > 0:
                starts = []
                for i in own:
                    starts.append(at[i])
                    at[i] += many
                self._configured(starts, many)
        return [x for a, z in zip(at, stops) for x in self._parts(a, z)]

    def _configured(self, starts: list[int], many: int) -> None:
        """``many`` new sequences: the i-th holds the pieces of ranks start + i. Where lengths change, a new run begins."""
        cuts = sorted({0, many} | {x - s for s in starts for _, x, _ in self._parts(s, s + many)})
        for a, z in zip(cuts, cuts[1:]):
            offset = 0
            for s in starts:
                length = int(np.searchsorted(self.first, s + a, side="right")) - 1
                self.runs.append((s + a, 1, length, self.n + a, offset))
                offset += length
            self.room[self.capacity - offset].append((self.n + a, z - a))
        self.n += many

    def _best_fit(self, length: int, rank: int, n: int) -> None:
        while n:
            rooms = sorted(r for r in self.room if r >= length)
            for room in rooms or [self.capacity]:
                while n and (self.room.get(room) or not rooms):
                    each = room // length
                    if rooms:
                        sequence, many = self.room[room].pop()
                    else:
                        sequence, many = self.n, -(-n // each)
                        self.n += many
                    used = min(many, -(-n // each))
                    put = min(n, used * each)
                    self.runs.append((rank, each, length, sequence, self.capacity - room))
                    if used < many:
                        self.room[room].append((sequence + used, many - used))
                    full = put // each
                    for place, k, taken in ((sequence, full, each), (sequence + full, used - full, put % each)):
                        if k:
                            self.room[room - taken * length].append((place, k))
                    rank, n = rank + put, n - put
                if not self.room.get(room):
                    self.room.pop(room, None)
                if not n:
                    return

    def arrays(self) -> np.ndarray:
        """start, each, length, first sequence, offset of each run, by start."""
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


def place(plan: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each rank."""
    start, each, length, first, offset = plan[np.searchsorted(plan[:, 0], rank, side="right") - 1].T
    return first + (rank - start) // each, offset + (rank - start) % each * length


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    return min((Plan(counts, capacity, g) for g in GROUPS), key=lambda p: p.n)


# ---- pieces and their places ----------------------------------------------------------------------------------------


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with ids as little-endian 16- or 32-bit integers, the part (task) they were made in and
    their number there among the pieces of their length."""

    def work(batches):
        words = _words(tokenizer)
        kind = f"<u{_width(tokenizer)}"
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            doc_id, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for x, y in _slices(text):
                flat, n = words.encode(text.slice(x, y - x))
                out = np.full(len(flat) + len(n), end_id, kind)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                n = n + 1
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                order = np.argsort(length, kind="stable")  # the n-th of its length
                lengths, at, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(at, count) + np.repeat(seen[lengths], count)
                seen[lengths] += count
                data, ends = out.tobytes(), np.cumsum(length) * out.itemsize
                ids = [data[a:z] for a, z in zip(np.append(0, ends), ends)]
                yield pa.record_batch([doc_id.slice(x, y - x).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset of each piece."""
    own = materialise(pieces(docs, capacity, tokenizer, end_id), "packing-pieces")
    parts = materialise(own.groupBy("length", "part").count(), "packing-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most one row for each length
        counts[r["length"]] = r["n"]
    first = np.cumsum(counts) - counts
    plan = docs.sparkSession.sparkContext.broadcast(best_plan(counts, capacity).arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    wide = _width(tokenizer)
    if parts.count() <= BROADCAST:
        shifts = F.broadcast(shifts)

    def placed(batches):
        for b in sliced(batches, 2_048):
            length, nth, shift = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "nth", "shift"))
            sequence, offset = place(plan.value, first[length] + shift + nth)
            (ids,) = next(rows_of([b], "ids"))
            ids = [np.frombuffer(x, f"<u{wide}").astype("<u4").tobytes() for x in ids]
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start")]
            yield pa.record_batch([*kept, pa.array(length.astype(np.int64)), pa.array(ids, pa.binary()), pa.array(sequence), pa.array(offset)], [f.split()[0] for f in PACKED.split(", ")])

    return own.join(shifts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids", "nth", "shift").mapInArrow(placed, PACKED)


def _width(tokenizer: str) -> int:
    return 2 if _words(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (little-endian unsigned 32-bit) and offsets, where pieces begin.
    A group is one sequence, so at most its capacity."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("each"))
    joined = F.unhex(F.array_join(F.transform("each", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", F.expr("aggregate(each, 0L, (n, x) -> n + x.length)").alias("n_tokens"), joined.alias("ids"), F.col("each.offset").alias("offsets"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
