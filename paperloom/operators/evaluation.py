"""Judging of retrieval cases: what must and must not be among the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW_SCORE = 0.65  # fixed value: the score under which nothing relevant was retrieved


def judged(cases: DataFrame, top: DataFrame, most: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """case_id, case_type, low, found, violated of each case (case_id, expected).

    top: case_id, rank, score, t (lower case), the results of a case. most: case_id, most, the largest score possible.
    A standard case is violated by a forbidden word in a sentence of the first right result that has what is
    expected; one that expects nothing (negative), by such a word in any result. `low` tells that no score reaches
    LOW_SCORE of the most, `found` that a result has what is expected.
    """
    bad = lambda text: reduce(lambda a, b: a | b, [text.contains(w) for w in forbidden])
    rows = cases.join(top, "case_id", "left").join(most, "case_id", "left")
    has = lambda text: F.exists("expected", lambda x: text.contains(F.lower(x)))
    sentences = F.filter(F.split("t", "[.!?]"), has)
    beside = F.coalesce(F.exists(sentences, bad), F.lit(False))
    hit = F.coalesce(has(F.col("t")), F.lit(False))
    per = rows.groupBy("case_id").agg(
        F.first(F.size("expected") == 0).alias("negative"),
        F.coalesce(F.max(F.round(F.col("score") / F.col("most"), 4)), F.lit(0.0)).alias("best"),
        F.coalesce(F.bool_or(bad(F.col("t"))), F.lit(False)).alias("anywhere"),
        F.min(F.when(hit, F.struct("rank", beside.alias("beside")))).alias("first_hit"),
    )
    violated = F.when(F.col("negative"), F.col("anywhere")).otherwise(F.coalesce("first_hit.beside", F.lit(False)))
    return per.select("case_id", F.when(F.col("negative"), "negative").otherwise("standard").alias("case_type"), (F.col("best") < LOW_SCORE).alias("low"), F.col("first_hit").isNotNull().alias("found"), violated.alias("violated"))
