"""What the operators of this subpackage share: tables, the shared work folder and byte-level word tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from docloom.functions.frames import prepared

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on just these.
JAVA_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in local mode, where all of them are one
    process, a folder of our own may stand in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = prepared(df.sparkSession)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, for exchanges that name a number."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1 for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sliced(batches: Iterator, rows: int = 1_024) -> Iterator:
    """The batches in parts of at most so many rows, for steps whose Python objects take many times the rows' memory."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Arrow batches as tuples of Python lists, one per column."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)
