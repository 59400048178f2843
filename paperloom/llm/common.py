"""Inputs shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import read_table


def latest_pages(pages: DataFrame, files: DataFrame, extensions: tuple[str, ...], longer_than: int = -1) -> DataFrame:
    """doc_id, page_number, text of each page of files with one of the extensions.

    A page delivered twice counts once, with the text that arrived last (ties: the larger text).
    Pages without text or key, and files without a name, take no part.
    """
    suffix = F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)\s*$", 1))
    wanted = files.where(suffix.isin(*extensions)).select("doc_id").distinct()
    return (
        pages.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("page_number").isNotNull())
        .where(F.length("text") > longer_than)
        .select("doc_id", "page_number", "text", "arrived_at")
        .join(wanted, "doc_id", "left_semi")
        .groupBy("doc_id", "page_number")
        .agg(F.max(F.struct("arrived_at", "text")).alias("last"))
        .select("doc_id", "page_number", F.col("last.text").alias("text"))
    )


def pages_of(spark: SparkSession, sf_dir: str, extensions: tuple[str, ...], longer_than: int = -1) -> DataFrame:
    return latest_pages(read_table(spark, sf_dir, "document_pages"), read_table(spark, sf_dir, "files"), extensions, longer_than)
