"""Progress events and ingestion as streams.

Events: event_id, document_id, type, ts. Streams carry a watermark on ts; state is kept per key and ends with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.frames import prepared, united
from docloom.sources import snapshots

#: Events that close a document's progress.
TERMINAL = ("completed", "failed", "summary_failed", "replace_complete", "replace_failed")
#: How long a document's state outlives its last event, in event time.
KEEP_MS = 24 * 3_600_000
PROGRESS = "document_id long, events long, last_type string, terminal_id long, closed boolean"


def dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once: replayed history and live events share ids. Repeats are remembered for ``delay``; events that come
    later than that behind the newest are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def document_progress(events: DataFrame) -> DataFrame:
    """Running progress per document: events so far, last type, and the terminal event that closed it. What comes after the
    terminal event is ignored. A document's state is three numbers and a word, however many events it has; it ends a day
    of event time after its last event. ``events`` needs a watermark on ts."""
    rows = events.select("document_id", "event_id", "type", "ts")
    state = "events long, last_type string, terminal_id long"
    return rows.groupBy("document_id").applyInPandasWithState(_advance, PROGRESS, state, "update", GroupStateTimeout.EventTimeTimeout)


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    n, last, closed = state.get if state.exists else (0, None, None)
    frames = list(batches)
    for e in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples() if frames else ():
        if closed is None:
            n, last = n + 1, e.type
            closed = int(e.event_id) if e.type in TERMINAL else None
    state.update((n, last, closed))
    newest = max((int(f["ts"].max().timestamp() * 1_000) for f in frames), default=0)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + KEEP_MS)
    yield pd.DataFrame({"document_id": [key[0]], "events": [n], "last_type": [last], "terminal_id": pd.array([closed], "Int64"), "closed": [closed is not None]})


def document_progress_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table: the first terminal event is an aggregate, so no document is sorted."""
    at = F.struct("ts", "event_id")
    first = events.where(F.col("type").isin(*TERMINAL)).groupBy("document_id").agg(F.min(at).alias("end"))
    rows = events.join(first, "document_id", "left").where(F.col("end").isNull() | (at <= F.col("end")))
    return rows.groupBy("document_id").agg(F.count("*").alias("events"), F.max_by("type", at).alias("last_type"), F.first("end.event_id").alias("terminal_id"), F.first(F.col("end").isNotNull()).alias("closed"))


def unit_progress_counts(units: DataFrame) -> DataFrame:
    """document_id, total_units, linked_units so far, of a stream of units (update mode) or a table."""
    return units.groupBy("document_id").agg(F.count("*").alias("total_units"), F.count_if(F.col("chunk_id").isNotNull()).alias("linked_units"))


#: What ``ingest`` gives for a batch: tables by name, and (document_id, reason) of documents that it could not take.
Ingested = tuple[dict[str, DataFrame], DataFrame]
STATUS = "document_id long, status string, reason string"


def isolated(docs: DataFrame, ingest: Callable[[DataFrame], Ingested], stored: Callable[[DataFrame, str], DataFrame], depth: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of ``ingest`` over ``docs`` (which must be stored), written, and the failures that it names.

    If it raises, the documents are halved by a hash and each half is taken by itself, until the one that it raises for is
    alone: that is a failure with the exception as its reason. So f bad documents of n cost about f log2(n) runs, and
    documents that ``ingest`` tells apart by itself cost none."""
    try:
        tables, failures = ingest(docs)
        return {name: stored(df, name) for name, df in tables.items()}, stored(failures, "failures")
    except Exception as e:
        ids = docs.select("document_id").distinct()
        if ids.limit(2).count() < 2:
            said = next((x.strip() for x in reversed(str(e).splitlines()) if re.match(r"\s*(\w+\.)*\w+(Error|Exception)\b", x)), str(e).split("\n")[0])
            return {}, stored(ids.select("document_id", F.lit(said).alias("reason")), "failures")
        side = F.pmod(F.xxhash64("document_id", F.lit(depth)), F.lit(2))
        found = [isolated(docs.where(side == k), ingest, stored, depth + 1) for k in (0, 1)]
        names = {n for tables, _ in found for n in tables}
        return {n: united([t[n] for t, _ in found if n in t]) for n in names}, united([f for _, f in found])


def ingest_stream(documents: DataFrame, ingest: Callable[[DataFrame], Ingested], path: str, checkpoint: str, stored: Callable[[DataFrame, str], DataFrame]):
    """Starts a query that ingests arriving documents (document_id, text and more) per micro-batch. Documents without text,
    and those that ``ingest`` names or raises for, are FAILED with a reason and don't stop the others.

    What a batch gives, status included, is published as one part named by its number (see sources.snapshots): readers
    see a batch whole or not at all, and a batch that runs twice replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        spark = prepared(df.sparkSession)
        docs = stored(df, "batch")
        good = F.trim(F.coalesce("text", F.lit(""))) != ""
        tables, failures = isolated(docs.where(good), ingest, stored)
        why = failures.groupBy("document_id").agg(F.min("reason").alias("reason"))
        rows = docs.select("document_id", good.alias("good")).groupBy("document_id").agg(F.bool_or("good").alias("good")).join(why, "document_id", "left")
        reason = F.when(F.col("good"), F.col("reason")).otherwise("no text")
        status = rows.select("document_id", F.when(reason.isNull(), "COMPLETED").otherwise("FAILED").alias("status"), reason.alias("reason"))
        snapshots.publish(spark, path, [(name, f"batch={number}", df) for name, df in ({"status": status} | tables).items()])

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def choose_replacements(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """``uploads`` (document_id, version, ts) with accepted: at most one per document, the earliest, and only if it is the
    next version. documents: id, version."""
    w = Window.partitionBy("document_id").orderBy("ts", "version")
    now = documents.select(F.col("id").alias("document_id"), F.col("version").alias("_now"))
    rows = uploads.withColumn("_n", F.row_number().over(w)).join(now, "document_id", "left")
    return rows.select(*uploads.columns, F.coalesce((F.col("_n") == 1) & (F.col("version") == F.col("_now") + 1), F.lit(False)).alias("accepted"))


def replace_stream(uploads: DataFrame, documents: Callable[[], DataFrame], replace: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch's accepted uploads to ``replace(accepted, batch number)``; ``documents``
    gives the catalogue as it is when the batch runs."""

    def batch(df: DataFrame, number: int) -> None:
        replace(choose_replacements(df, documents()).where("accepted"), number)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
