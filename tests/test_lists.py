"""Whole lists from the written corpus: the same as row by row, and no exchange or window over pairs."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.operators import bm25, lists

DATA = Path("/root/testdata/sf0.001")


def corpus(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 211, rng.choice("ab"), " ".join(f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(30)))) for i in range(211)]
    rows += [(300, "a", None), (301, "b", ""), (302, "a", "w1 " * 70_000)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)


@pytest.mark.parametrize("group", [None, "source"])
def test_top_is_that_of_scored_rows(spark, monkeypatch, group):
    monkeypatch.setattr(lists, "POSTINGS", 500)
    docs = corpus(spark)
    own = docs.where("doc_id % 10 = 0")
    queries = own.select("doc_id", "source", F.explode(F.split("text", " ")).alias("term")).where("term <> ''").select(F.col("doc_id").alias("query_id"), "source", "term", F.lit(1).alias("mult"))
    queries = queries.distinct()
    index = lists.build(docs, group=group)
    assert sum(s["docs"] for s in index.segments) == 214 and len(index.segments) >= 3
    got = {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in lists.top(index, queries, 7, group=group).collect()}
    want = {(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25.top(bm25.score(docs, queries, group=group), 7).collect()}
    assert {g[:3] for g in got} == {w[:3] for w in want} and len(got) > 100


def test_fused_top_is_that_of_whole_lists():
    rng = np.random.default_rng(2)
    for n in (1, 5, 400, 3000):
        for _ in range(20):
            b, c = np.round(rng.random(n), 2), np.round(rng.random(n), int(rng.integers(1, 6)))
            b[rng.random(n) < 0.5] = 0
            boost = 0.15 * (rng.random(n) < 0.02)
            for kb, kc, gain in ((60.0, 60.0, None), (20.0, 40.0, None), (60.0, 60.0, boost)):
                score = lists.fused(b, c, kb, kc)
                score = score if gain is None else np.round(score + gain, 9)
                at, got = lists.fused_top([(b, kb), (c, kc)], 10, gain)
                want = lists.best(score, 10)
                assert at.tolist() == want.tolist() and got.tolist() == score[want].tolist()
            at = rng.integers(0, n, 9)
            assert lists.ranks_at(b, at).tolist() == lists.ranks(b)[at].tolist()


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["bm25_score_all", "hybrid_alpha_blend", "hybrid_form_blend", "rrf_intro_boost_median"])
def test_pairs_are_handed_on_as_they_are_scored(spark, name):
    plan = entry.queries()[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and "Window" not in plan


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["adaptive_topk", "bm25_filtered", "bm25_saved_index", "bm25_topk", "jaccard_of_results", "hybrid_retrieve", "multi_query_rrf", "route_by_cosine_floor", "rrf_form_boost", "rrf_fusion", "rrf_short_query_k"])
def test_ranked_queries_score_in_lists(spark, monkeypatch, name):
    """None of them makes a row for each pair, which bm25.score and vectors.similarities do."""

    def none(*args, **more):
        raise AssertionError("a row for each pair")

    for module, f in ((bm25, "score"), (lists.V, "similarities")):
        monkeypatch.setattr(module, f, none)
    assert entry.queries()[name](spark, str(DATA)).count() > 0


DATA_10 = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA_10.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["bm25_score_all", "hybrid_alpha_blend", "hybrid_form_blend", "rrf_intro_boost_median"])
def test_all_scores_stand_document_by_document(spark, name):
    """Within a task the queries of a document stand together, so that its id is stored once for all of them."""
    got = entry.queries()[name](spark, str(DATA_10)).select(F.spark_partition_id().alias("p"), "query_id", "doc_id").collect()
    parts: dict[int, list] = {}
    for r in got:
        parts.setdefault(r["p"], []).append((r["doc_id"], r["query_id"]))
    assert max(len({q for _, q in rows}) for rows in parts.values()) > 1
    assert len({(r["query_id"], r["doc_id"]) for r in got}) == len(got) == 20_000
    for rows in parts.values():
        assert [d for d, _ in rows] == sorted(d for d, _ in rows)


def test_sums_over_often_and_seldom_terms(spark, monkeypatch):
    """Terms of many documents are added as whole lists, the others by place; neither changes a score."""
    docs = corpus(spark)
    queries = spark.createDataFrame([(q, f"w{t}", 1 + (q + t) % 2) for q in range(6) for t in range(1 + q, 60, 1 + q)], "query_id bigint, term string, mult int")
    own = lists.Corpus(lists.build(docs))
    asked = queries.groupBy("query_id").agg(F.collect_list(F.xxhash64("term")).alias("h"), F.collect_list("mult").alias("m")).orderBy("query_id").collect()
    terms = []
    for r in asked:
        h, m = np.array(r["h"]), np.array(r["m"], float)
        terms.append(("", np.sort(h), m[np.argsort(h)]))
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.score(docs, queries).collect()}
    for often in (0.0, 0.15, 2.0):
        monkeypatch.setattr(lists, "OFTEN", often)
        got = own.lexical(terms, 0.9, 0.5)
        assert got.shape == (6, 214)
        for q, row in enumerate(got):
            assert row == pytest.approx([want.get((q, d), 0.0) for d in own.ids.tolist()], abs=2e-6)
