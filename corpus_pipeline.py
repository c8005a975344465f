"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Stages keep rows without doc_id, which count as the last ones. Repeated rows stand and fall together, but of near copies
and of rows that repeat doc_id and text one stays. All stages but the last return the columns of the documents given to
them, whatever their names; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.frames import prepared
from docloom.llm import bpe, decontaminate, simhash, substrings, toxicity
from docloom.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model is fitted on the labels of the documents given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.is_toxic(F.col("text"), model))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies by five-word shingles: that of the smallest doc_id, null ones last."""
    return simhash.without_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; n_chars follows the text."""
    return substrings.cleaned(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded bytes of each document left."""
    found = bpe.encode_decode(docs, digest=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Fitted models and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
