"""Context for a generator: budgets, neighbours, order and assembly of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import compress_lines, section_header


def budgets(ranked: DataFrame, total: int, least: int, key: str = "doc_id") -> DataFrame:
    """Add `budget`: the share of `total` by score, no less than `least` (or an even share, if smaller).

    What this exceeds is taken from the last ranks first. ranked: key, rank, score.
    """
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    floor_ = F.least(F.lit(least), F.floor(F.lit(total) / n)).cast("bigint")
    s = F.sum("score").over(w)
    raw = F.when(s <= 0, F.floor(F.lit(total) / n)).otherwise(F.floor(F.round(F.col("score") / s * total, 6))).cast("bigint")
    rows = ranked.withColumn("floor_", floor_).withColumn("raw", F.greatest(raw, F.col("floor_")))
    rows = rows.withColumn("over", F.greatest(F.lit(0), F.sum("raw").over(w) - total)).withColumn("give", F.col("raw") - F.col("floor_"))
    after = F.coalesce(F.sum("give").over(w.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.least(F.col("give"), F.greatest(F.lit(0), F.col("over") - after))
    return rows.withColumn("budget", F.col("raw") - cut).drop("floor_", "raw", "over", "give")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda x: F.octet_length(x) > 4))


def neighbours(selected: DataFrame, chunks: DataFrame, shared: int = 5) -> DataFrame:
    """doc_id, chunk_index of chunks next to a selected one that are not selected and share five long words with it."""
    s = selected.select("doc_id", F.col("chunk_index").alias("at"), long_words(F.col("text")).alias("w"))
    around = s.select("doc_id", "w", F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("chunk_index"))
    near = chunks.join(around, ["doc_id", "chunk_index"]).join(selected.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")
    return near.where(F.size(F.array_intersect(long_words(F.col("text")), "w")) >= shared).select("doc_id", "chunk_index").distinct()


def sandwich(rank: Column, n: Column) -> Column:
    """Place of a rank when the best comes first, the second last and the weakest in between first."""
    return F.when((n < 3) | (rank == 1), rank).when(rank == 2, n).otherwise(n - rank + 2)


def relevance(score: Column, most: Column) -> Column:
    share = F.when(most > 0, score / most).otherwise(0.0)
    return F.when(share > 0.85, "high").when(share > 0.60, "medium").otherwise("low")


def assemble(ranked: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """key, context, used: formatted chunks in sandwich order up to the first that would exceed `limit`.

    ranked: key, rank, score, file_name, page_number, text, budget; at most a pool of rows a key.
    """
    w = Window.partitionBy(key)
    head = section_header(F.col("text"))
    label = F.concat(
        F.lit("--- Source "), F.col("rank").cast("string"), F.lit(": "), "file_name", F.lit(" | p. "), F.col("page_number").cast("string"),
        F.when(head.isNull(), "").otherwise(F.concat(F.lit(" | §"), head)), F.lit(" | relevance: "), relevance(F.col("score"), F.max("score").over(w)), F.lit(" ---\n"),
    )
    rows = ranked.withColumn("label", label).withColumn("body", compress_lines(F.col("text"))).withColumn("room", F.greatest(F.lit(0), F.col("budget") - F.length("label")))
    cut = F.when(F.length("body") <= F.col("room"), F.col("body")).otherwise(F.concat(F.expr("substring(body, 1, cast(room as int))"), F.lit("...")))
    rows = rows.withColumn("part", F.concat("label", cut)).withColumn("place", sandwich(F.col("rank"), F.count("*").over(w)))
    total = F.sum(F.length("part") + F.when(F.col("place") > 1, 7).otherwise(0)).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("total", total).where(F.col("total") <= limit)  # totals grow, so the first excess ends it
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda p: p["part"])
    return kept.groupBy(key).agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("used"))
