"""Fusion of rankings and the boosts on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_ranks(lists: list[tuple[DataFrame, float]], id_: str = "doc_id") -> DataFrame:
    """query_id, id, score: sum of 1 / (k + rank) over ranked lists (query_id, id, rank from 1), 9 decimals."""
    parts = [df.select("query_id", id_, (1.0 / (k + F.col("rank"))).alias("s")) for df, k in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", id_).agg(F.round(F.sum("s"), 9).alias("score"))


def boosted(fused: DataFrame, form_boost: float = 0.15, intro_boost: float = 0.08, decay: float = 0.03, last: int = 2) -> DataFrame:
    """score with boosts for rows with columns text, position, caption, asks_form, asks_party.

    Filled forms gain for questions about forms. Early chunks gain for questions about parties, half as
    much again with a caption, if their score reaches the median of all scores of the query.
    """
    form = F.when(F.col("asks_form") & F.col("text").startswith("FILLED FORM DATA"), form_boost).otherwise(0.0)
    base = fused.withColumn("score", F.col("score") + form)
    base = base.withColumn("middle", F.median("score").over(Window.partitionBy("query_id")))
    gain = (intro_boost - F.col("position") * decay) * F.when(F.col("caption"), 1.5).otherwise(1.0)
    due = F.col("asks_party") & (F.col("position") <= last) & (F.col("score") >= F.col("middle")) & (gain > 0)
    return base.withColumn("score", F.round(F.col("score") + F.when(due, gain).otherwise(0.0), 9)).drop("middle")


def alpha_blend(scored: DataFrame, alpha: float = 0.5, form_boost: float = 0.0) -> DataFrame:
    """alpha * cosine + (1 - alpha) * bm25 / largest bm25 of the query; with a boost, filled forms (by `text`) gain
    it and the score is at most 1."""
    most = F.max("bm25").over(Window.partitionBy("query_id"))
    share = F.when(most > 0, F.col("bm25") / most).otherwise(0.0)
    score = alpha * F.col("cosine") + (1 - alpha) * share
    if form_boost:
        score = F.least(F.lit(1.0), score + F.when(F.col("text").startswith("FILLED FORM DATA"), form_boost).otherwise(0.0))
    return scored.withColumn("score", F.round(score, 8))


def adaptive_cut(ranked: DataFrame, top_k: int, gap: float) -> DataFrame:
    """Keep the ranks up to the largest gap in score over `gap` among the first top_k, at least 2.

    A query with no more than top_k rows keeps them all. ranked: query_id, rank, score.
    """
    w = Window.partitionBy("query_id")
    step = F.col("score") - F.lead("score").over(w.orderBy("rank"))
    marked = ranked.withColumn("n", F.count("*").over(w)).withColumn("step", F.when((F.col("rank") < top_k) & (step > gap), F.round(step, 9)))
    cut = F.max(F.when(F.col("step").isNotNull(), F.struct("step", -F.col("rank")))).over(w)
    keep = F.when(F.col("n") <= top_k, F.col("n")).otherwise(F.greatest(F.lit(2), F.least(F.lit(top_k), F.coalesce(-cut["col2"], F.lit(top_k)))))
    return marked.withColumn("keep", keep).where(F.col("rank") <= F.col("keep")).drop("n", "step", "keep")
