"""Incremental ingestion: new files become versions, each content once, by a stream that ends when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.scalars import content_hash


def versions_of(rows: DataFrame, extractor: str = "text-1") -> DataFrame:
    """(attachment_id, content_key, text): the key is a hash of the content and of what reads it."""
    return rows.select(F.col("doc_id").alias("attachment_id"), content_hash("text", F.lit(extractor)).alias("content_key"), "text")


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, store: str) -> None:
    """Append the versions that ``store`` doesn't have yet. A batch that is run again adds nothing."""
    new = versions_of(batch).dropDuplicates(["attachment_id", "content_key"])
    try:
        old = spark.read.parquet(store)
        new = new.join(old.where(F.col("batch") < batch_id).select("attachment_id", "content_key"), ["attachment_id", "content_key"], "left_anti")
    except Exception as e:  # the first batch finds no store
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)


def run(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str) -> None:
    """Read all new Parquet files under ``source`` and merge them, batch by batch; ends when none are left."""
    stream = spark.readStream.schema(schema).parquet(source)
    job = stream.writeStream.foreachBatch(lambda df, n: merge_batch(df.sparkSession, df, n, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def current(versions: DataFrame) -> DataFrame:
    """Of each attachment the version of the last batch."""
    return versions.groupBy("attachment_id").agg(F.max_by(F.struct("content_key", "text"), F.struct("batch", "content_key")).alias("v")).select("attachment_id", "v.content_key", "v.text")
