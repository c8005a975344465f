"""Queries: event streams (X rows), each run to its end over the events table and read back from what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import markdown
from docloom.operators import chunking, documents
from docloom.registry import query
from docloom.sources import snapshots
from docloom.streaming import events as X

from .chunking import OUTLINE
from .tables import new_folder, stored, table


def streamed(spark, sf_dir):
    """The events table as a stream of files (a pattern, since the table may be one file or a folder)."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def events(spark, sf_dir, stream: bool):
    """Events of users as documents: the error event of every user's number closes it, and every third event is sent twice."""
    rows = streamed(spark, sf_dir) if stream else table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), "completed").otherwise(F.col("event_type"))
    sent = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("event_id", F.col("user_id").alias("document_id"), kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.explode(sent).alias("copy")).drop("copy")


def drained(df, spark, name: str, mode: str = "append"):
    """Runs a stream over what there is and returns the rows it wrote."""
    out = new_folder(spark, name)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("x1_dedupe_events", "SELECT event_id, user_id AS document_id, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'completed' ELSE event_type END AS type FROM events")
def deduped(spark, sf_dir):
    return drained(X.dedupe_events(events(spark, sf_dir, True)), spark, "x1").select("event_id", "document_id", "type")


PROGRESS = """WITH e AS (SELECT event_id, user_id AS document_id, ts, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'completed' ELSE event_type END AS type FROM events),
ends AS (SELECT document_id, min((ts, event_id)) AS fin FROM e WHERE type = 'completed' GROUP BY 1)
SELECT document_id, count(*) AS events, arg_max(type, (ts, event_id)) AS last_type, any_value(fin[2]) AS terminal_id, bool_or(fin IS NOT NULL) AS closed FROM e LEFT JOIN ends USING (document_id) WHERE fin IS NULL OR (ts, event_id) <= fin GROUP BY 1"""


@query("x2_document_progress", PROGRESS)
def progress(spark, sf_dir):
    """The stateful stream; its last row of each document is the state after all events."""
    once = events(spark, sf_dir, True).where("ts is not null")
    rows = drained(X.document_progress(X.dedupe_events(once)), spark, "x2", "update")
    rows = rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(0))
    return rows.groupBy("document_id").agg(F.max_by(F.struct("events", "last_type", "terminal_id", "closed"), F.struct("batch", "events")).alias("s")).select("document_id", "s.*")


@query("x2_document_progress_batch", PROGRESS)
def progress_batch(spark, sf_dir):
    return X.document_progress_batch(events(spark, sf_dir, False).dropDuplicates(["event_id"]))


@query("x5_unit_progress", "SELECT user_id AS document_id, count(*) AS total_units, count(*) FILTER (event_type = 'click') AS linked_units FROM events GROUP BY 1")
def unit_progress(spark, sf_dir):
    units = streamed(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("chunk_id"))
    rows = drained(X.unit_progress_counts(units), spark, "x5", "update")
    return rows.groupBy("document_id").agg(F.max("total_units").alias("total_units"), F.max("linked_units").alias("linked_units"))


@query("x4_choose_replacements", """SELECT document_id, version, ts, row_number() OVER (PARTITION BY document_id ORDER BY ts, version) = 1 AND version = 2 AS accepted FROM (SELECT DISTINCT user_id % 50 AS document_id, CAST(event_id % 3 + 1 AS INT) AS version, ts FROM events)""")
def replacements(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("document_id"), (F.col("event_id") % 3 + 1).cast("int").alias("version"), "ts").distinct()
    docs = e.select(F.col("document_id").alias("id"), F.lit(1).alias("version")).distinct()
    return X.choose_replacements(e, docs)


PAGE_LINES, DAMAGED = 20, "%%damaged%%"


def checked_blocks(text, is_plain):
    """The parser of the stream's pages: it stops at a damaged one."""
    if text and DAMAGED in text:
        raise ValueError(f"damaged at {text.index(DAMAGED)}")
    return markdown.blocks(text, is_plain)


def ingest_pages(docs):
    """W1 over plain texts, twenty lines to a page; document_id as doc_id."""
    line = docs.select(F.col("document_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pages = line.groupBy("doc_id", (F.floor(F.col("n") / PAGE_LINES) + 1).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    none = F.lit(None).cast("string")
    pages = pages.withColumns({"is_plain": F.lit(True), "refs": F.array().cast("array<string>"), "appendix": none, "boundary": none})
    titles = pages.select("doc_id").distinct().withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    parents, children, faults = chunking.build_sound_chunks(pages, titles, docs.sparkSession.createDataFrame([], OUTLINE), stored, checked_blocks)
    return {"parents": parents, "children": documents.embed(children)}, faults.withColumnRenamed("doc_id", "document_id")


@query("x3_ingest_stream", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS text FROM documents),
w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM d),
s AS (SELECT doc_id, words, CASE WHEN coalesce(trim(text), '') = '' THEN 'no text' WHEN doc_id % 10 = 3 THEN 'page 1: ValueError: damaged at 0' WHEN doc_id % 10 = 7 AND len(string_split(text, chr(10))) > {PAGE_LINES} THEN 'page 2: ValueError: damaged at 0' END AS reason FROM d JOIN w USING (doc_id))
SELECT doc_id AS document_id, CASE WHEN reason IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, reason, CASE WHEN reason IS NULL THEN words END AS words, CASE WHEN reason IS NULL THEN words END AS child_words, CASE WHEN reason IS NULL THEN true END AS embedded FROM s""")
def ingested(spark, sf_dir):
    """Documents arrive as a stream and go through W1. Every tenth has no text, and of two more in ten a page is damaged:
    the first, or the second if there is one. The chunks hold all words of the documents that are completed."""
    damaged = F.transform(F.split("text", "\n"), lambda x, i: F.when(((F.col("doc_id") % 10 == 3) & (i == 0)) | ((F.col("doc_id") % 10 == 7) & (i == PAGE_LINES)), F.concat(F.lit(DAMAGED), x)).otherwise(x))
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    docs = docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 10 != 0, F.array_join(damaged, "\n")).alias("text"))
    out = new_folder(spark, "x3")
    X.ingest_stream(docs, ingest_pages, out, f"{out}/checkpoint", stored).awaitTermination()
    words = F.regexp_count("text", F.lit(r"\S+"))
    parents = snapshots.current(spark, out, "parents").groupBy(F.col("doc_id").alias("document_id")).agg(F.sum(words).alias("words"))
    children = snapshots.current(spark, out, "children").groupBy(F.col("doc_id").alias("document_id")).agg(F.sum(words).alias("child_words"), F.bool_and(F.col("embedding").isNotNull()).alias("embedded"))
    return snapshots.current(spark, out, "status").join(parents, "document_id", "left").join(children, "document_id", "left")


@query("x4_replace_stream", """SELECT document_id, version, ts FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, version) AS n FROM (SELECT user_id AS document_id, CAST(event_id % 3 + 1 AS INT) AS version, ts FROM events)) WHERE n = 1 AND version = 2""")
def replaced(spark, sf_dir):
    """Uploads arrive as a stream; the accepted ones are written by batch."""
    uploads = streamed(spark, sf_dir).select(F.col("user_id").alias("document_id"), (F.col("event_id") % 3 + 1).cast("int").alias("version"), "ts")
    out = new_folder(spark, "x4")
    docs = lambda: table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit(1).alias("version")).distinct()

    def write(accepted, number):
        accepted.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    X.replace_stream(uploads, docs, write, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("document_id", "version", "ts")
