"""Reading documents and golden questions, writing chunks and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots

#: File kinds that hold text.
TEXT_KINDS = ("txt", "md", "markdown", "html", "htm", "csv", "json", "xml")


def read_corpus(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Documents below ``path``: ``text`` (one row per file: path, text), ``binary`` (path, content, for hashing) or
    ``parquet`` (as it is)."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "binary":
        return spark.read.format("binaryFile").load(path).select("path", "content")
    if kind != "text":
        raise ValueError(f"unknown kind of corpus: {kind}")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*TEXT_KINDS))


def save_chunks(parents: DataFrame, children: DataFrame, units: DataFrame, path: str, buckets: int = 64, documents: DataFrame | None = None) -> None:
    """Puts the documents' parents, children and units in place of what was saved of them below ``path``, all at once:
    until the last step readers (``saved``) have the old version whole. ``documents`` (document_id) names documents that
    go without a successor."""
    snapshots.replace_documents(parents.sparkSession, path, {"parents": parents, "children": children, "units": units}, buckets, documents)


def saved(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """``parents``, ``children`` or ``units`` as last saved."""
    return snapshots.current(spark, path, name)


def export_parents(parents: DataFrame, documents: DataFrame, filename_like: str) -> DataFrame:
    """id, text and metadata (JSON) of the parents of documents whose file name contains the text, whatever its case."""
    wanted = documents.where(F.contains(F.lower("filename"), F.lit(filename_like.lower()))).select(F.col("id").alias("document_id"))
    kept = [c for c in parents.columns if c not in ("id", "text", "document_id")]
    return parents.join(wanted, "document_id", "left_semi").select("id", "text", F.to_json(F.struct(*kept)).alias("metadata"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, targets (array, empty for null), category of a JSON array of golden questions; those whose
    target is still PENDING are left out."""
    schema = "id int, question string, target_parent_chunk_id string, expected_answer string, category string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    raw = F.trim("target_parent_chunk_id")
    many = F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>")
    targets = F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(many, F.array(raw)))
    return rows.select(F.col("id").alias("question_id"), "question", targets.alias("targets"), "category").where(~F.array_contains("targets", "PENDING"))
