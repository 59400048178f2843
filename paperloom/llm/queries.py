"""Queries of the training-data problems, over their whole tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import common, entities, language, mail, mixing, neighbours, packing, scans, split, tokens
from paperloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.pages_of(spark, sf_dir, ("docx", "txt", "md"), longer_than=1000)
    pieces = split.split_pages(pages)
    return pieces.select("doc_id", "page_number", "start_off", "end_off").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.mention_pairs(entities.link(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "files")))


def p2_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.parties(entities.link(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "files")))


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.inspect_pages(scans.flagged_pages(read_table(spark, sf_dir, "document_pages"), read_table(spark, sf_dir, "files")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(spark, sf_dir).where("kind <> 'text'").drop("text", "continues").distinct()


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired pages; `continues` tells that a page goes on in the paragraph of the page before."""
    return _inspected(spark, sf_dir).where("kind = 'text'").select("doc_id", "page_number", "text", "continues")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(read_table(spark, sf_dir, "embed_cache")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.pages_of(spark, sf_dir, ("eml",))
    return mail.reduce_mails(pages).select("doc_id", "page_number", "line_no").distinct()


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return tokens.with_token_counts(documents, {"doc_id": F.col("doc_id"), "source": F.col("source")})


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir).drop("source"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))[1]


def p7_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when the total is all tokens there are, so that scarce sources end at max_repeats."""
    return mixing.mix(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), whole=True)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language.foreign_paragraphs(language.sentence_languages(documents, language.train(documents)))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language.document_languages(documents, language.sentence_languages(documents, language.train(documents)))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return language.segments(language.sentence_languages(documents, language.train(documents)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
