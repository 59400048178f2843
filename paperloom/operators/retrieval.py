"""Hybrid retrieval: both rankings, fusion, near-duplicate removal, adaptive cut and diversity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.words import MODES
from paperloom.operators import bm25, lists, vectors
from paperloom.session import checkpoint


@dataclass(frozen=True)
class Settings:
    top_k: int = 6
    pool: int = 36
    mmr_lambda: float = 0.7
    jaccard: float = 0.88
    gap: float = 0.003
    threshold: float = 0.0

    @staticmethod
    def of_mode(mode: str) -> Settings:
        k, pool, _, _, lam, _, jac, gap, *_ = MODES[mode]
        return Settings(k, pool, lam, jac, gap)


class Backend(Protocol):
    """Anything that ranks a corpus for queries."""

    def retrieve(self, corpus: DataFrame, queries: DataFrame, settings: Settings) -> DataFrame: ...


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def drop_near_duplicates(texts: list[str], threshold: float, most: int | None = None) -> list[int]:
    """Positions kept, in order: one is dropped if a kept one before it is more similar than the threshold.
    Ends when `most` are kept."""
    kept: list[int] = []
    sets: list[set[str]] = []
    for i, t in enumerate(texts):
        if len(kept) == most:
            break
        s = set(t.split())
        if not any(jaccard(s, other) > threshold for other in sets):
            kept.append(i)
            sets.append(s)
    return kept


def adaptive_k(scores: list[float], top_k: int, gap: float) -> int:
    if len(scores) <= top_k:
        return len(scores)
    cut, largest = top_k, 0.0
    for i in range(top_k - 1):
        step = round(scores[i] - scores[i + 1], 9)
        if step > gap and step > largest:
            largest, cut = step, i + 1
    return min(max(cut, 2), top_k)


def mmr(scores: list[float], matrix: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy choice of k rows: relevance less similarity to what is chosen; negative similarity counts 0,
    ties go to the earlier row."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    unit = matrix / np.where(length > 0, length, 1)[:, None]
    left, chosen = list(range(len(scores))), []
    most = np.zeros(len(scores))
    while left and len(chosen) < k:
        worth = [scores[i] if not chosen else lam * scores[i] - (1 - lam) * most[i] for i in left]
        best = left[int(np.argmax(np.round(worth, 12)))]
        left.remove(best)
        chosen.append(best)
        most = np.maximum(most, unit @ unit[best])
    return chosen


def mmr_rounds(rows: DataFrame, group: str, id_: str, score: str, vector: str, k: int, lam: float) -> DataFrame:
    """group, id, place: k rows of each group, one after the other, each relevant and unlike those before.

    The same choice as `mmr`, for groups of any size: a round takes the best row of each group by an aggregate,
    and joins it back to all rows of the group. Negative similarity counts 0, ties go to the smaller id.
    """
    left = rows.select(group, id_, F.col(score).alias("s"), F.col(vector).alias("v"), F.lit(0.0).alias("near"))
    chosen = None
    for place in range(1, k + 1):
        worth = F.col("s") if place == 1 else F.round(lam * F.col("s") - (1 - lam) * F.col("near"), 9)
        best = checkpoint(left.groupBy(group).agg(F.max_by(F.struct(id_, "v"), F.struct(worth.alias("w"), (-F.col(id_)).alias("i"))).alias("b")))
        one = best.select(group, F.col(f"b.{id_}").alias(id_), F.lit(place).alias("place"))
        chosen = one if chosen is None else chosen.unionByName(one)
        if place < k:
            taken = best.select(group, F.col(f"b.{id_}").alias("taken"), F.col("b.v").alias("tv"))
            near = F.greatest("near", F.round(vectors.cosine(F.col("v"), F.col("tv")), 6))
            left = left.join(taken, group).where(F.col(id_) != F.col("taken")).withColumn("near", near).drop("taken", "tv")
    return chosen


def distinct_texts(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    """The rows (group, rank, text) that `drop_near_duplicates` keeps in each group, for groups of any size.

    Texts of the same words are one, of which the first rank counts. The others meet by prefix filtering: two
    word sets with a Jaccard similarity over the threshold share one of their rarest words. Then, round after
    round, a row is kept once all similar rows before it are dropped, and dropped once one of them is kept.
    Texts without words are like no other.
    """
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    sets = rows.select(group, "rank", words.alias("w"), F.sha2(F.array_join(F.array_sort(words), " "), 256).alias("h"))
    empty = sets.where(F.size("w") == 0).select(group, "rank")
    full = sets.where(F.size("w") > 0)
    first = checkpoint(full.groupBy(group, "h").agg(F.min("rank").alias("rank"), F.first("w").alias("w")))
    seen = first.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    weighed = first.select(group, "rank", F.size("w").alias("n"), F.explode("w").alias("x")).join(seen, "x").groupBy(group, "rank", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    prefix = F.slice("o", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1)
    posted = weighed.select(group, "rank", "n", F.explode(prefix).alias("p")).select(group, "rank", "n", F.col("p.x").alias("x"))
    a, b = posted.select(group, "x", F.col("rank").alias("early"), F.col("n").alias("na")), posted.select(group, "x", F.col("rank").alias("late"), F.col("n").alias("nb"))
    met = a.join(b, [group, "x"]).where((F.col("early") < F.col("late")) & (F.least("na", "nb") > threshold * F.greatest("na", "nb"))).select(group, "early", "late").distinct()
    w = first.select(group, "rank", "w")
    both = met.join(w.select(group, F.col("rank").alias("early"), F.col("w").alias("wa")), [group, "early"]).join(w.select(group, F.col("rank").alias("late"), F.col("w").alias("wb")), [group, "late"])
    edges = checkpoint(both.where(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")) > threshold).select(group, "early", "late"))
    open_ = checkpoint(edges.select(group, F.col("late").alias("rank")).distinct())
    dropped = open_.limit(0)
    while not open_.isEmpty():
        # an open row is decided when none of the rows before it that are like it is open
        waiting = edges.join(open_.withColumnRenamed("rank", "early"), [group, "early"], "left_semi").select(group, F.col("late").alias("rank")).distinct()
        ready = open_.join(waiting, [group, "rank"], "left_anti")
        like_kept = edges.join(dropped.withColumnRenamed("rank", "early"), [group, "early"], "left_anti").select(group, F.col("late").alias("rank")).distinct()
        dropped = checkpoint(dropped.unionByName(ready.join(like_kept, [group, "rank"], "left_semi")))
        open_ = checkpoint(open_.join(ready, [group, "rank"], "left_anti"))
    kept = first.select(group, "rank").join(dropped, [group, "rank"], "left_anti").unionByName(empty)
    return rows.join(kept, [group, "rank"], "left_semi")


def text_class(threshold: float) -> Column:
    """A key that texts of the same words share, as only the first of them can outlive near-duplicate
    removal; texts without words have one each."""
    own = F.concat(F.lit("id:"), F.col("doc_id").cast("string"))
    if threshold >= 1:
        return own
    words = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda x: x != ""))
    return F.when(F.size(words) == 0, own).otherwise(F.sha2(F.array_join(F.array_sort(words), " "), 256))


def both_lists(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, bm25, cosine, b, c: every row of the corpus for every query, with its exact ranks in the
    lexical (b) and the vector (c) list.

    A row that shares no term with the query, or has no usable vector, counts 0 in that list; ties stand by id.
    corpus: doc_id, text, vector. queries: query_id, term, mult and the query's vector on each row of it. Use
    `lists.run` where less than all rows are needed.
    """

    def use(q, own, scores, near):
        row = np.round(scores[0], 6)
        return {"doc_id": own.ids, "bm25": row, "cosine": near, "b": lists.ranks(row), "c": lists.ranks(near)}

    index = lists.build(corpus, vectors=corpus.select("doc_id", "vector"))
    return lists.run(index, queries, use, "query_id bigint, doc_id bigint, bm25 double, cosine double, b bigint, c bigint")


def merge_variants(corpus: DataFrame, variants: DataFrame, k: float = 60.0, top: int | None = None) -> DataFrame:
    """query_id, doc_id, rank, score: the lexical lists of all variants of a query, merged by their reciprocal ranks; with
    `top`, the best of them only.

    variants: query_id, variant, term, mult. The corpus is tokenised once for all of them.
    """

    def use(q, own, scores, near):
        rows = [(np.where(s > 0, np.round(s, 6), -1.0), k) for s in scores]
        at, score = lists.fused_top(rows, len(own.ids) if top is None else top)
        return {"doc_id": own.ids[at], "rank": np.arange(1, len(at) + 1), "score": score}

    index = lists.build(corpus)
    return lists.settled(lists.run(index, variants, use, "query_id bigint, doc_id bigint, rank bigint, score double"), index)


def route(best: Column, floors: dict[str, float]) -> Column:
    """The mode with the highest floor that the best cosine reaches, or not_found; null counts as nothing found."""
    out = F.lit("not_found")
    for mode, floor in sorted(floors.items(), key=lambda f: f[1]):
        out = F.when(best >= floor, mode).otherwise(out)
    return out


class Hybrid:
    """BM25 and cosine, fused by reciprocal ranks; short queries give both lists smaller constants."""

    def pools(self, index: lists.Lists, queries: DataFrame, depth: int) -> DataFrame:
        """query_id, doc_id, score, rank, more: the first `depth` different texts of each query, from exact ranks in both
        lists over the whole corpus; more: whether there are others.

        Of texts of one kind (the mark of the index) the best counts. A query without a usable vector has the
        lexical list only.
        """

        def use(q, own, scores, near):
            short = q["words"] is not None and q["words"] <= 5
            score = lists.fused(np.round(scores[0], 6), near, 20.0 if short else 60.0, 40.0 if short else 60.0, q["seen"])
            order = np.argsort(-score, kind="stable")
            first = np.sort(np.unique(own.marks["kind"][order], return_index=True)[1])
            at = order[first[:depth]]
            return {"doc_id": own.ids[at], "score": score[at], "rank": np.arange(1, len(at) + 1), "more": len(first) > depth}

        return lists.run(index, queries, use, "query_id bigint, doc_id bigint, score double, rank int, more boolean", carry=("words",))

    def retrieve(self, corpus: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
        """query_id, doc_id, rank (in order of choice), score.

        corpus: doc_id, text, vector. queries: query_id, term, mult, words, vector of the query on each
        row of it. The pool of a query is the first settings.pool of its different texts. Texts of the
        same words count as one; where those taken hold too few that differ, the query is asked again
        with four times as many, until the pool is full or the corpus at its end. What is taken is the
        largest group a task gathers.
        """
        need = max(settings.pool, settings.top_k + 1)
        index = lists.build(corpus, vectors=corpus.select("doc_id", "vector"), marks={"kind": F.xxhash64(text_class(settings.jaccard))})
        texts = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "vector")

        def choose(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("rank", kind="stable")
            query, taken, more = group["query_id"].iloc[0], len(group), bool(group["more"].any())
            group = group.iloc[drop_near_duplicates([t or "" for t in group["text"]], settings.jaccard, need)]
            if more and len(group) < need:
                return pd.DataFrame({"query_id": [query], "doc_id": [-1], "rank": [0], "score": [float(taken)]})
            k = adaptive_k(group["score"].tolist(), settings.top_k, settings.gap)
            group = group[group["score"] >= settings.threshold] if settings.threshold > 0 else group
            group = group.iloc[: settings.pool]
            scores = group["score"].tolist()
            dim = max((len(v) for v in group["vector"] if v is not None), default=1)
            matrix = np.array([np.asarray(v, dtype=float) if v is not None and len(v) == dim and np.isfinite(np.asarray(v, dtype=float)).all() else np.zeros(dim) for v in group["vector"]])
            order = mmr(scores, matrix, k, settings.mmr_lambda) if scores else []
            return pd.DataFrame({"query_id": group["query_id"].iloc[order], "doc_id": group["doc_id"].iloc[order], "rank": range(1, len(order) + 1), "score": [scores[i] for i in order]})

        parts, depth = [], 2 * need
        while True:
            pool = self.pools(index, queries, depth)
            got = checkpoint(pool.join(texts, "doc_id").groupBy("query_id").applyInPandas(choose, "query_id bigint, doc_id bigint, rank int, score double"))
            parts.append(got.where("rank > 0"))
            short = got.where("rank = 0").select("query_id")
            if short.isEmpty():
                index.drop()
                return reduce(DataFrame.unionByName, parts)
            queries, depth = queries.join(short, "query_id", "left_semi"), 4 * depth


class Reranked:
    """A first pass without diversity, ordered anew by a model that scores (query, text) pairs."""

    def __init__(self, scorer, first: Backend | None = None):
        self.scorer, self.first = scorer, first or Hybrid()

    def retrieve(self, corpus: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
        wide = Settings(500, 500, 1.0, settings.jaccard, settings.gap)
        found = self.first.retrieve(corpus, queries, wide).join(corpus.select("doc_id", "text"), "doc_id")
        scored = found.withColumn("score", self.scorer(F.col("query_id"), F.col("text")).cast("double"))
        return bm25.top(scored, settings.top_k).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), "score")


BACKENDS = {"hybrid": Hybrid, "default": Hybrid, "reranker": Reranked}
