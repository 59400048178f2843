"""Reports for people: citation lists, memos, evaluation reports, session names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpoint


def citation_lines(citations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """n, line (and the columns to keep): Source, File, Page, Score, Excerpt as CSV with doubled quotes. citations: n, file_name, page_number, score, excerpt."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("n").cast("string"), quote(F.col("file_name")), F.col("page_number").cast("string"), F.format_string("%.3f", F.col("score").cast("double")), quote(F.substring("excerpt", 1, 200)))
    return citations.select(*keep, "n", line.alias("line"))


def memo(turns: DataFrame) -> DataFrame:
    """session_id, memo: numbered questions and answers with their sources, once each. turns: session_id, turn, question, answer, sources array."""
    part = F.concat(F.lit("## Question "), F.col("turn").cast("string"), F.lit("\n\n"), "question", F.lit("\n\n### Analysis\n\n"), "answer", F.lit("\n\n### Sources\n\n"), F.array_join(F.transform(F.array_distinct("sources"), lambda s: F.concat(F.lit("- "), s)), "\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda p: p["part"])
    return turns.groupBy("session_id").agg(F.array_join(parts, "\n\n---\n\n").alias("memo"))


def report_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct(*[F.col(c) for c in summary.columns])).alias("json"))


BUCKETS = 256


def replace_documents(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Put rows into a table of documents in place of what it has of these documents.

    The table lies in folders by a hash of doc_id. Only folders of documents that come in are rewritten, each by a
    few tasks; their other documents are carried over through a checkpoint, as a table can't be read while it is
    written. All rows of a document must come in at once.
    """
    spark = rows.sparkSession
    fresh = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    merged = fresh
    if files.exists(place) and files.listStatus(place):
        touched = fresh.select("bucket").distinct()  # at most `buckets` rows
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(fresh.select("doc_id").distinct(), "doc_id", "left_anti")
        merged = checkpoint(old.select(*fresh.columns).unionByName(fresh))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def session_name(question: str, names: list[str] = ()) -> str:
    """A short name of a session: its document and subject, the parties of a case, an amount, or its first words."""
    stem = re.sub(r"\.[A-Za-z0-9]+$", "", names[0]) if names else ""
    versus = re.search(r"([A-Z][\w.]*(?:\s+[A-Z][\w.]*)*)\s+v(?:s)?\.?\s+([A-Z][\w.]*(?:\s+[A-Z][\w.]*)*)", question)
    amount = re.search(r"\$[\d,]+(?:\.\d{2})?", question)
    subject = versus and f"{versus[1]} v. {versus[2]}" or amount and amount[0] or " ".join(w for w in question.split() if w.lower() not in ("what", "is", "the", "a", "an", "of", "are", "who", "how"))
    return (f"{stem}: {subject}" if stem else subject).strip(" ?.:")[:50].strip() or "New session"


def label(stem: Column, question: Column) -> Column:
    return F.concat(stem, F.lit(": "), F.substring(question, 1, 30))
