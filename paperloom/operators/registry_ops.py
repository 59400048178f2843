"""Bookkeeping of files, cases, sessions and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the largest order; ties by the whole row's hash."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*[F.col(c) for c in rows.columns])))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def rebuild_registry(chunks: DataFrame) -> DataFrame:
    """doc_id, file_name, chunk_count, total_pages from the chunks themselves."""
    return chunks.groupBy("doc_id").agg(F.min("file_name").alias("file_name"), F.count("*").alias("chunk_count"), F.max("page_number").alias("total_pages"))


def restore(registry: DataFrame, saved: DataFrame, columns: list[str]) -> DataFrame:
    """The registry with attributes of a saved one where that has the file."""
    old = saved.select("doc_id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = registry.join(old, "doc_id", "left")
    return out.select(*[c for c in registry.columns if c not in columns], *[F.coalesce(F.col(f"_{c}"), F.col(c) if c in registry.columns else F.lit(None)).alias(c) for c in columns])


def in_case(rows: DataFrame, files: DataFrame, case_id: str | None) -> DataFrame:
    """Rows of the files of one case; without a case, of the files that have none."""
    wanted = files.where(F.col("case_id").eqNullSafe(F.lit(case_id))).select("doc_id").distinct()
    return rows.join(wanted, "doc_id", "left_semi")


def changed(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not known: new or changed ones."""
    return incoming.join(known.select("file_path", "content_hash").distinct(), ["file_path", "content_hash"], "left_anti")


def replace_version(rows: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows without those of the documents that come in anew, and the incoming ones."""
    return rows.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(incoming)


def upsert_sessions(sessions: DataFrame, updates: DataFrame, keep: int = 200) -> DataFrame:
    """Sessions with updates applied, the newest `keep`."""
    return latest(sessions.unionByName(updates), "session_id", "updated_at").orderBy(F.desc("updated_at"), "session_id").limit(keep)


def delete_case(files: DataFrame, chunks: DataFrame, case_id: str, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) after a case is deleted: its files and chunks go too, or lose the case."""
    if cascade:
        gone = files.where(F.col("case_id") == case_id).select("doc_id").distinct()
        return files.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")
    return files.withColumn("case_id", F.when(F.col("case_id") != case_id, F.col("case_id"))), chunks


def set_attribute(rows: DataFrame, key: str, value: str, column: str, new) -> DataFrame:
    """A point update; a blank text becomes null."""
    new = None if isinstance(new, str) and not new.strip() else new
    return rows.withColumn(column, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(column)))


def add_entities(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities with new names added; of several entries of a new name the first file's counts."""
    fresh = incoming.join(known.select("name").distinct(), "name", "left_anti")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("source_file", "entity_id"))
    return known.unionByName(fresh.withColumn("_r", rank).where("_r = 1").drop("_r").select(*known.columns))


def entities_of_case(entities: DataFrame, files: DataFrame, case_id: str | None) -> DataFrame:
    wanted = files.where(F.col("case_id").eqNullSafe(F.lit(case_id))).select(F.col("file_name").alias("source_file")).distinct()
    return entities.join(wanted, "source_file", "left_semi")


def age_bucket(then: Column, now: Column) -> Column:
    """today, yesterday, week, month, older for epoch milliseconds."""
    days = F.floor((now - then) / 86_400_000)
    return F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 7, "week").when(days < 30, "month").otherwise("older")


def paired_turns(messages: DataFrame, last: int = 3) -> DataFrame:
    """session_id, user, assistant, back: neighbouring question and answer, the last few of a session."""
    w = Window.partitionBy("session_id").orderBy("turn")
    nxt = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("content").over(w))
    pairs = nxt.where("role = 'user' and next_role = 'assistant'")
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return pairs.withColumn("back", back).where(F.col("back") <= last).select("session_id", F.col("content").alias("user"), F.col("answer").alias("assistant"), "back")


def search_names(named: DataFrame, terms: DataFrame) -> DataFrame:
    """word and the row of each of the names that have it, in any case and as a part; terms: word, few."""
    return named.join(F.broadcast(terms), F.lower("name").contains(F.lower("word")))


def summaries(sessions: DataFrame, excluded: DataFrame) -> DataFrame:
    """session_id, case_id, summary of sessions with a summary, without the one excluded for their case.

    excluded: case_id, exclude (null excludes none).
    """
    shown = sessions.where(F.coalesce("summary", F.lit("")) != "").join(excluded, "case_id", "left")
    return shown.where(~F.col("session_id").eqNullSafe(F.col("exclude"))).select("session_id", "case_id", "summary")


def without(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows after the one with a key is deleted; null keys stay."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(value)))


def path_of_url(url: Column) -> Column:
    """The path a percent-encoded URL path names; a plus stays a plus, and what is no code stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def excerpt_place(page: Column, excerpt: Column) -> tuple[Column, Column]:
    """(how, where) an excerpt stands on a page: whole, most or half of it, or none at place 0; both with single blanks."""
    at = lambda share: F.instr(page, F.substring(excerpt, F.lit(1), F.floor(F.length(excerpt) * share).cast("int")))
    whole, most, half = F.instr(page, excerpt), at(0.7), at(0.35)
    kind = F.when(whole > 0, "whole").when(most > 0, "most").when(half > 0, "half").otherwise("none")
    return kind, F.when(whole > 0, whole).when(most > 0, most).otherwise(half)
