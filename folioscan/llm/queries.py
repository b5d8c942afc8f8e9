"""One query per training-data operator, each over its whole table, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import jaccard, language, media, packing, pii, quality, sampling, spans, urls, vectors
from folioscan.llm.common import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    found = jaccard.classes(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by cosine 0.98 or more between vectors of a label, and their components."""
    found = vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as chunked samples and read back."""
    return media.columns(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text by prototypes of the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.prototypes(docs.where(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text, and whether it decodes to the text."""
    rows = sampling.decode(sampling.encode(_table(spark, sf_dir, "documents")))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (text == F.col("decoded")).alias("lossless"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with the place of each in the packed sequences."""
    rows = packing.pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(save(rows, "pieces"), ["doc_id", "start"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packed(_table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page rated against the list entries that were active on the day of its capture."""
    captures = urls.captures_of(_table(spark, sf_dir, "pages"))
    return urls.rate(captures, urls.sample_events(captures))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and digest of the base kinds, and all spans."""
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text by the discriminant, fitted on the labels that are not held out."""
    feats = save(quality.features(_table(spark, sf_dir, "documents")), "features")
    model = quality.fit_on(feats, _table(spark, sf_dir, "labels"))
    score = F.col("score")
    return quality.score(feats, model).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), score, F.when(score >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the sentences that a non-first repeated span covers."""
    return spans.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_jaccard": op1_jaccard, "op2_embeddings": op2_embeddings, "op3_media": op3_media, "op4_language": op4_language, "op5_sampling": op5_sampling, "op6_packing": op6_packing, "op7_urls": op7_urls, "op8_pii": op8_pii, "op9_quality": op9_quality, "op10_spans": op10_spans}


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": urls.ORACLE}
