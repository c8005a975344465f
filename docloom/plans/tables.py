"""Which table plays which part: the driver's tables as lines, chunks, users, messages and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.frames import new_folder, stored  # noqa: F401  (what plans take from here)
from docloom.functions.text import trim_all

LINES_PER_PAGE = 20
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_as_sql(text: Column) -> Column:
    """Without the white space that LINES_SQL takes off: less than ``trim_all`` does."""
    return F.regexp_replace(text, r"\A[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")


def lines(spark: SparkSession, sf_dir: str, trimmed: Callable[[Column], Column] = trim_all) -> DataFrame:
    """doc_id, page, line_no (from 0), text: the lines of documents, a page for every 20."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return split.select("doc_id", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int").alias("page"), "line_no", trimmed(F.col("text")).alias("text")).where("text <> ''")


LINES_SQL = f"""lines AS (
    SELECT doc_id, CAST(floor((pos - 1) / {LINES_PER_PAGE}) + 1 AS INT) AS page, CAST(pos - 1 AS INT) AS line_no, text FROM (
        SELECT doc_id, generate_subscripts(l, 1) AS pos, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    ) WHERE text <> '')"""


def new_lines(old: DataFrame) -> DataFrame:
    """A second version of ``lines``: every tenth line gone, some upper-cased, some reworded, one added."""
    n = F.col("line_no")
    text = F.when(n % 7 == 2, F.translate("text", LOWER, LOWER.upper())).when(n % 11 == 5, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    kept = old.where(n % 10 != 3).select("doc_id", "page", "line_no", text.alias("text"))
    extra = old.groupBy("doc_id").agg(F.max("page").alias("page"), (F.max("line_no") + 1).alias("line_no")).withColumn("text", F.lit("This version adds one closing line."))
    return kept.unionByName(extra)


NEW_LINES_SQL = f"""new_lines AS (
    SELECT doc_id, page, line_no, CASE WHEN line_no % 7 = 2 THEN translate(text, '{LOWER}', '{LOWER.upper()}') WHEN line_no % 11 = 5 THEN text || ' (revised)' ELSE text END AS text
    FROM lines WHERE line_no % 10 <> 3
    UNION ALL SELECT doc_id, max(page), max(line_no) + 1, 'This version adds one closing line.' FROM lines GROUP BY doc_id)"""


def normal_sql(column: str) -> str:
    return f"trim(regexp_replace(translate(lower({column}), '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g'))"


def hash_sql(column: str) -> str:
    return f"substr(sha256({normal_sql(column)}), 1, 16)"
