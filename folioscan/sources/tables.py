"""Scans: the driver's tables, and the views of them that stand for a library's datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; filters and columns reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as library entries: title (first line), type (source), size, flags from the labels."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    title = F.substring_index("text", "\n", 1)
    return joined.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("source").alias("entry_type"), "lang", F.col("n_chars").alias("size"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("starred"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("trashed"), "text")


def entry_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, tag): a label with the value 1 is a tag."""
    labels = load(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("entry_id"), F.explode(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("tag")).where("tag is not null")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: (attachment_id, page, content), a page a line, numbered from 1; blank lines are no pages."""
    docs = load(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("attachment_id"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    return rows.where(F.trim("content") != "").select("attachment_id", (F.col("at") + 1).cast("long").alias("page"), "content")


#: The same views in DuckDB's SQL, for the oracles.
ENTRIES_SQL = """(SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.source AS entry_type, d.lang, d.n_chars AS size,
  coalesce(l.quality = 1, false) AS starred, coalesce(l.toxic = 1, false) AS trashed, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TAGS_SQL = """(SELECT doc_id AS entry_id, 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"""
LINES_SQL = """(SELECT attachment_id, page, content FROM (SELECT doc_id AS attachment_id, unnest(string_split(text, chr(10))) AS content,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS page FROM documents) WHERE trim(content) <> '')"""
