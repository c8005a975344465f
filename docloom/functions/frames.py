"""What DataFrames need before they are put together."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this part of all rows is heavy: there are fewer than this many of those, whatever the data.
HEAVY = 1_000


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with unions taken for what they are. Spark 4.1 counts the partitions of equally partitioned tables as
    those of their union even where adaptive execution has merged them differently, and groups above such a union come
    apart; tests/test_oracle.py (e4_validate_grades) shows it."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def united(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames, columns by name."""
    prepared(frames[0].sparkSession)
    return reduce(DataFrame.unionByName, frames)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only in local mode, where all are one
    process, a folder of our own may stand in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a Parquet table in the shared folder: what several steps read is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, asked: DataFrame, key: str, by: Column, heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined to ``asked`` on ``key``, where a few keys may have a great part of ``rows``.

    Keys are counted (before the shuffle, task by task). One that has more than 1/heavy of all rows is heavy, and there are
    fewer than ``heavy`` of them, so their list can be sent to all tasks. Rows of a heavy key are dealt by ``by`` over as
    many copies of the key as bring each below that share, and what asks for it is repeated for each copy."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    copies = F.ceil(F.col("_n") * heavy / F.col("_all")).cast("int")
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * heavy > F.col("_all")).select(F.col(key).alias("_key"), copies.alias("_copies"))  # the total is one row
    hot = F.broadcast(hot)
    left = rows.join(hot, rows[key] == hot["_key"], "left").withColumn("_copy", F.pmod(F.xxhash64(by), F.coalesce("_copies", F.lit(1)))).drop("_key", "_copies")
    right = asked.join(hot, asked[key] == hot["_key"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_key", "_copies")
    return left.join(right, [key, "_copy"]).drop("_copy")
