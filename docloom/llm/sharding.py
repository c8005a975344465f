"""Sharding by sampled splitters.

A record's key is (XXH64 of its text, doc_id, a number of its own); its size is the UTF-8 bytes of the text plus 1, and
its weight the size plus the mean size, so that neither bytes nor rows pile up. A weighted sample of keys (each record
with a probability in proportion to its weight, decided by a hash of the key) gives quantile boundaries over the text
hashes, and a record falls in the range between two of them. The exact weight of each range is then counted, and a range
that is overfull is subdivided by a sample of its own, again and again until every range fits or is one row. A cut goes
before a text, and inside one, by doc_id and then by the row's own number, only if that text fills more than a part.
Neighbouring ranges are laid into shards so that the cumulative size is cut nearest to equal parts (law ``bytes``). So
equal texts share a shard whenever they fit a part.

Slots are gapless within a shard: the offset of the range in its shard plus the row's place in its range. No step
sorts a whole shard in one task, and texts never move: only key, size and checksum do. Keys are written to the shared
folder once, so a task that runs again sees the same numbers.

Null text: size 1, checksum 0 of no bytes. Repeated doc_ids, null ones too: rows of their own. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARDS = 8
#: First ranges at least, rows beyond which there are more of them, keys sampled per range, and the multiple of a range's
#: mean weight, and share of a shard, beyond which it is subdivided.
RANGES, RANGE_ROWS, PER_RANGE, OVERFULL, OF_SHARD = 1_024, 4_000_000, 32, 2, 1 / 64
KEY = ("text_hash", "doc_id", "row")
LOWEST = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"),
    )


def _sampled(rows: DataFrame, rate: Column) -> pd.DataFrame:
    """Keys (doc_id not null) and weights of a sample: a row with probability min(1, weight * rate), decided by its hash."""
    u = F.pmod(F.xxhash64(F.lit("sample"), *KEY), F.lit(1 << 40)) / F.lit(float(1 << 40))
    found = rows.withColumn("rate", rate).where(u < F.col("weight") * F.col("rate"))
    kept = [c for c in ("range",) if c in rows.columns]
    return found.select(*kept, "text_hash", F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "row", F.greatest("weight", 1 / F.col("rate")).alias("weight")).toPandas()


def splitters(keys: pd.DataFrame, n: int) -> list[tuple[int, int, int]]:
    """At most n - 1 ascending distinct keys that cut the sample (of positive weight) into n parts of about equal weight.
    A text that holds fewer than two of the cuts is not cut: the cut goes before it."""
    if not len(keys):
        return []
    keys = keys.sort_values(list(KEY), ignore_index=True)
    total = keys["weight"].cumsum().to_numpy()
    at = np.minimum(np.searchsorted(total, total[-1] * np.arange(1, n) / n), len(keys) - 1)
    cuts = keys.loc[at, list(KEY)].to_numpy(np.int64).tolist()
    texts = Counter(t for t, _, _ in cuts)
    return sorted({(t, LOWEST, LOWEST) for t in texts} | {(t, d, r) for t, d, r in cuts if texts[t] > 1})


def _between(cuts: list[tuple[int, int, int]], text_hash: np.ndarray, doc_id: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each key."""
    texts = np.array([t for t, _, _ in cuts], np.int64)
    low, high = np.searchsorted(texts, text_hash, side="left"), np.searchsorted(texts, text_hash, side="right")
    found = high.copy()
    inside = np.flatnonzero(high - low > 1)  # texts that are cut themselves
    for t in np.unique(text_hash[inside]):
        own = inside[text_hash[inside] == t]
        a, b = low[own[0]], high[own[0]]
        keys = np.concatenate([np.array([c[1:] for c in cuts[a:b]], np.int64), np.stack([doc_id[own], row[own]], 1)])
        order = np.lexsort((np.arange(len(keys)) >= b - a, keys[:, 1], keys[:, 0]))  # a cut comes before an equal key
        upto = np.empty(len(keys), np.int64)
        upto[order] = np.cumsum(order < b - a)
        found[own] = a + upto[b - a :]
    return found.astype(np.int32)


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``, under the law ``bytes``. ``ranges``:
    that many at least; a range is sorted in one task, so there are more where they would have over ``RANGE_ROWS`` rows."""
    rows = materialise(keyed(docs), "sharding-keys")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    rows = rows.withColumn("weight", F.col("size") + total / max(n, 1))
    ranges = max(ranges, -(-n // RANGE_ROWS))
    limit = max(1.0, min(2 * total / ranges * OVERFULL, 2 * total / shards * OF_SHARD))
    cuts = splitters(_sampled(rows, F.lit(ranges * PER_RANGE / max(2 * total, 1))), ranges)
    while True:
        ranged, sizes = _ranged(rows, cuts)
        full = sizes[(sizes["weight"] > limit) & (sizes["n"] > 1)]
        if not len(full):
            break
        parts = np.ceil(full["weight"] / limit).astype(int) * 2
        rates = full.assign(rate=parts * PER_RANGE / full["weight"])[["range", "rate"]].astype({"range": "int32", "rate": float})
        drawn = _sampled(ranged.join(F.broadcast(rows.sparkSession.createDataFrame(rates, "range int, rate double")), "range"), F.col("rate"))
        many = dict(zip(full["range"], parts))
        more = {c for r, g in drawn.groupby("range") for c in splitters(g, many[r])} - set(cuts)
        if not more:  # what is left cannot be cut further
            break
        cuts = sorted({*cuts, *more})
    sizes = sizes.sort_values("range", ignore_index=True)
    middle = sizes["size"].cumsum() - sizes["size"] / 2
    sizes["shard"] = np.minimum(shards - 1, (middle * shards // max(total, 1)).astype(int)).astype(np.int32) if len(sizes) else 0
    sizes["offset"] = sizes.groupby("shard")["n"].cumsum() - sizes["n"] if len(sizes) else 0
    places = docs.sparkSession.createDataFrame(sizes[["range", "shard", "offset"]].astype({"range": "int32", "shard": "int32", "offset": "int64"}), "range int, shard int, offset long")
    place = Window.partitionBy("range").orderBy(*KEY)
    return ranged.withColumn("at", F.row_number().over(place)).join(F.broadcast(places), "range").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _ranged(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> tuple[DataFrame, pd.DataFrame]:
    """``rows`` with their range, and the size, weight and rows of each range: at most one more than there are cuts."""

    @F.pandas_udf("int")
    def range_of(t: pd.Series, i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(_between(cuts, t.to_numpy(np.int64), i.to_numpy(np.int64), r.to_numpy(np.int64)))

    ranged = rows.withColumn("range", range_of("text_hash", F.coalesce("doc_id", F.lit(LOWEST)), "row"))
    return ranged, ranged.groupBy("range").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")).toPandas()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
