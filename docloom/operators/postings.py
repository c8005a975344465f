"""An inverted index of byte runs: which texts contain which patterns, without comparing each with each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.frames import spread_join, stored

#: Lengths of the runs, in bytes of UTF-8 and 7 at most: a pattern is looked up by the longest that fits in it.
RUNS = (1, 3, 5)
#: The filter over the patterns' runs: places for each run, the fewest and the most; powers of two.
FILTER_PLACES, FILTER_LEAST, FILTER_MOST = 64, 1 << 10, 1 << 24
#: Positions that are hashed at once.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(data: np.ndarray, n: int, scope: np.ndarray) -> np.ndarray:
    """A hash of the n bytes from each of the first positions of ``data``, within the scope of the position."""
    run = np.full(len(scope), n, np.uint64)
    for k in range(n):
        run = (run << np.uint64(8)) | data[k : len(scope) + k]
    run = (run * _ODD[0]) ^ scope
    return (run ^ (run >> np.uint64(32))) * _ODD[1]


def _runs(rows: DataFrame, runs: tuple[int, ...], bits: bytes | None = None, counted: bool = False) -> DataFrame:
    """id, gram: the distinct runs of each text that the filter ``bits`` lets through; without it, all of the longest length
    that fits in the text. With ``counted`` gram, texts: how many texts have it, of those that are read at once. rows: id,
    scope (long), text (binary), none of them null. The time is linear in a text's length."""

    def work(batches):
        table = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        for b in batches:
            text, scopes = b.column(2), b.column(1).to_numpy().view(np.uint64)
            ends = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_binary(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            sizes = np.diff(ends)
            fits = np.max([np.where(sizes >= n, n, 0) for n in runs], axis=0)
            first = 0
            while first < len(text):  # whole texts of about CHUNK bytes, or one that is longer
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
                found = []
                for at in range(ends[first], ends[last], CHUNK):
                    to = min(at + CHUNK, ends[last])
                    row = np.repeat(np.arange(first, last), np.maximum(np.minimum(ends[first + 1 : last + 1], to) - np.maximum(ends[first:last], at), 0))
                    scope, left = scopes[row], ends[row + 1] - np.arange(at, to)
                    for n in runs:
                        whole = max(0, min(to, len(data) - n + 1) - at)
                        gram = _hashes(data[at:], n, scope[:whole])
                        keep = (left[:whole] >= n) & (fits[row[:whole]] == n if table is None else table[gram >> np.uint64(65 - len(table).bit_length())])
                        found.append(_distinct(row[:whole][keep], gram[keep]))
                if found:
                    row, gram = _distinct(*(np.concatenate(x) for x in zip(*found)))
                    if counted:
                        gram, n = np.unique(gram, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "texts"])
                    else:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(gram.view(np.int64))], names=["id", "gram"])
                first = last

    return rows.select("id", "scope", "text").mapInArrow(work, "gram long, texts long" if counted else f"id {rows.schema['id'].dataType.simpleString()}, gram long")


def _distinct(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _filter(grams: DataFrame) -> bytes:
    """A bit for each place that some of the grams falls on. Its size is bounded: with very many it lets more through."""
    n = grams.count()
    places = min(FILTER_MOST, max(FILTER_LEAST, 1 << (n * FILTER_PLACES).bit_length()))
    bit = grams.select(F.shiftrightunsigned("gram", 65 - places.bit_length()).alias("bit"))
    longs = bit.groupBy(F.shiftright("bit", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
    found = np.zeros(places // 64, np.int64)
    for r in longs.toLocalIterator():  # at most FILTER_MOST / 64 rows
        found[r["k"]] = r["v"]
    return found.astype("<i8").tobytes()


def containing(texts: DataFrame, patterns: DataFrame, runs: tuple[int, ...] = RUNS) -> DataFrame:
    """The columns of ``texts`` (id, which is unique, text, scope and others) and pattern, for each pattern of the same scope
    that stands in the text as written. patterns: scope, pattern; of fewer bytes than the shortest of ``runs``: found nowhere.

    Two passes over the texts, which all patterns share: the first counts the texts that have each run of a pattern, where
    they lie; the second finds those with the run that each pattern is looked up by, which the fewest texts have, and only
    these are searched. Both let through what a filter knows. A pattern with a run that no text has is found nowhere, and a
    run that a great part of the texts has is dealt over many tasks."""
    hashed = lambda column: (F.xxhash64("scope").alias("scope"), F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text"))
    patterns = patterns.where("pattern is not null").select(F.struct("scope", "pattern").alias("id")).distinct().select("id", "id.*")
    indexed = stored(_runs(patterns.select("id", *hashed("pattern")), runs), "pattern-runs")
    grams = indexed.select("gram").distinct()
    rows = texts.select("id", *hashed("text"))
    counts = _runs(rows, runs, _filter(grams), counted=True).join(grams, "gram", "left_semi").groupBy("gram").agg(F.sum("texts").alias("texts"))
    known = indexed.join(counts, "gram", "left")
    best = known.groupBy("id").agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.bool_and(F.col("texts").isNotNull()).alias("all")).where("all")
    best = stored(best, "pattern-lookups")
    chosen = best.select("gram").distinct()
    postings = stored(_runs(rows, runs, _filter(chosen)).join(chosen, "gram", "left_semi"), "text-runs")
    hits = spread_join(postings, best.select("gram", F.col("id").alias("sought")), "gram", F.col("id")).select(F.col("id").alias("hit_id"), "sought")
    found = texts.join(hits, texts["id"] == hits["hit_id"]).where(texts["scope"].eqNullSafe(F.col("sought.scope")) & F.contains("text", "sought.pattern"))
    return found.select(*(texts[c] for c in texts.columns), F.col("sought.pattern").alias("pattern"))


def occurrences(text: Column, pattern: Column) -> Column:
    """How often a pattern stands in a text without overlapping itself."""
    return ((F.char_length(text) - F.char_length(F.replace(text, pattern, F.lit("")))) / F.char_length(pattern)).cast("long")
