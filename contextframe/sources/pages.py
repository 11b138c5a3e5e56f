"""Web pages and documents in tables, as content items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.paths import content_hash, media_type, url_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_items(pages: DataFrame) -> DataFrame:
    """source, relative_path, media_type, content_hash, list_seq of pages(page_id, url, html)."""
    rel = url_path(F.col("url"))
    return pages.select(F.col("url").alias("source"), rel.alias("relative_path"), media_type(rel).alias("media_type"), content_hash(F.col("html")).alias("content_hash"), F.col("page_id").alias("list_seq"))
