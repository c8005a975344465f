"""Tables whose parts are replaced together: readers see the state before a change or after it, never half of one.

Below a path, ``data/`` holds folders of Parquet files that are written once and never changed, and ``manifest/`` says
which of them make up the tables. A change writes new folders for the parts that it touches, then one manifest file for
the next version, which names these and, for all other parts, the folders of the version before. A version counts only
once its manifest file is there, and that comes in one rename; a writer that fails on the way leaves folders that no
manifest names. A part is named by its writer: a bucket of documents, or a micro-batch.

One writer at a time; any number of readers. Manifests are as long as there are parts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from docloom.functions.frames import stored

#: As many documents that are replaced may be sent to all tasks.
BROADCAST_DOCUMENTS = 1_000_000
MANIFEST = "version long, name string, part string, folder string"


def _manifest(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(table, part, folder) of the last version; empty before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    return [] if last is None else [(r["name"], r["part"], r["folder"]) for r in rows.where(F.col("version") == last).collect()]


def current(spark: SparkSession, path: str, name: str, parts: list[str] | None = None) -> DataFrame | None:
    """The table ``name`` (or those parts of it) as the last version has it; None where that has nothing of it."""
    folders = [f for n, p, f in _manifest(spark, path) if n == name and (parts is None or p in parts)]
    return spark.read.parquet(*(f"{path}/data/{f}" for f in folders)) if folders else None


def _save(rows: DataFrameWriter, folder: str) -> None:
    """Folders of versions before stay for their readers, so they are packed tightly."""
    rows.option("compression", "zstd").parquet(folder)


def publish(spark: SparkSession, path: str, changes: list[tuple[str, str, DataFrame]]) -> None:
    """Makes a new version in which each (table, part, rows) of ``changes`` is what these rows are. All of them show at once."""
    written = {}
    for name, part, rows in changes:
        folder = f"{name}-{uuid.uuid4().hex}"
        _save(rows.write, f"{path}/data/{folder}")
        written[name, part] = folder
    switch(spark, path, written)


def switch(spark: SparkSession, path: str, written: dict[tuple[str, str], str]) -> None:
    """The last step of a change: a manifest with the folders of ``written`` (by table and part) in place of those before."""
    kept = {(n, p): f for n, p, f in _manifest(spark, path)} | written
    last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").agg(F.max("version")).first()[0] if _manifest(spark, path) else 0
    rows = [(last + 1, n, p, f) for (n, p), f in kept.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one task, so one file


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def replace_documents(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int, documents: DataFrame | None = None) -> None:
    """Puts the rows of ``tables`` (all with document_id) in place of whatever the tables hold of these documents, and of
    those in ``documents``, which may have no rows any more. Only the buckets that these fall in are written anew: what
    they hold of other documents is merged in, so callers give no more than their own documents."""
    own = [df.select("document_id") for df in [*tables.values(), *([documents] if documents is not None else [])]]
    gone = stored(reduce(DataFrame.unionByName, own).distinct(), "replaced-documents")
    listed = F.broadcast(gone) if gone.count() <= BROADCAST_DOCUMENTS else gone
    touched = sorted(r[0] for r in gone.select(bucket_of(buckets)).distinct().collect())  # at most one row a bucket
    written = {}
    for name, rows in tables.items():
        before = current(spark, path, name, [str(b) for b in touched])
        if before is not None:
            rows = before.join(listed, "document_id", "left_anti").unionByName(rows, allowMissingColumns=True)
        folder = f"{name}-{uuid.uuid4().hex}"
        _save(rows.withColumn("bucket", bucket_of(buckets)).repartition("bucket").write.partitionBy("bucket"), f"{path}/data/{folder}")
        held = {r[0] for r in spark.read.schema("bucket int").parquet(f"{path}/data/{folder}").distinct().collect()}
        written |= {(name, str(b)): f"{folder}/bucket={b}" for b in touched if b in held}
        empty = [b for b in touched if b not in held]
        if empty:  # buckets that have lost their last row
            spare = f"{name}-{uuid.uuid4().hex}"
            rows.limit(0).coalesce(1).write.parquet(f"{path}/data/{spare}")
            written |= {(name, str(b)): spare for b in empty}
    switch(spark, path, written)
