"""Retrieval, context and grading against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import answers as A
from paperloom.operators import bm25, context, fusion, retrieval, vectors


def docs(spark):
    rows = [(1, "the rent is due monthly rent"), (2, "the deposit is due"), (3, ""), (4, None), (5, "pets are not allowed")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_bm25_matches_the_formula(spark):
    d = docs(spark)
    q = spark.createDataFrame([(9, "rent", 2), (9, "due", 1), (9, "absent", 1)], "query_id bigint, term string, mult int")
    got = {r["doc_id"]: r["score"] for r in bm25.score(d, q).collect()}
    dl = {1: 6, 2: 4, 3: 0, 4: 0, 5: 4}
    avg = sum(dl.values()) / 5

    def w(tf, n, doc):
        return max(0, math.log((5 - n + 0.5) / (n + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl[doc] / avg))

    assert got == {1: round(2 * w(2, 1, 1) + w(1, 2, 1), 6), 2: round(w(1, 2, 2), 6)}


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    q = spark.createDataFrame([], "query_id bigint, term string, mult int")
    assert bm25.score(none, q).count() == 0
    empty = spark.createDataFrame([], "vec_id bigint, vector array<float>")
    assert vectors.search(empty, empty, 3).count() == 0


def test_search_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).round(2)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 8), (103, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    got = vectors.search(df, df, 4, dim=8, block=20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, int(j), k + 1) for i in range(60) for k, j in enumerate([j for j in np.lexsort((np.arange(60), -s[i])) if j != i][:4])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()} == want


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, -1, 0, 0]


def test_fusion_boosts(spark):
    rows = [(1, 1, 0.02, "FILLED FORM DATA x", 5, False, True, True), (1, 2, 0.03, "t", 0, True, True, True), (1, 3, 0.01, "t", 0, False, True, True), (1, 4, 0.03, "t", 1, False, True, True)]
    df = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double, text string, position int, caption boolean, asks_form boolean, asks_party boolean")
    got = {r["doc_id"]: r["score"] for r in fusion.boosted(df).collect()}
    assert got == {1: 0.17, 2: 0.15, 3: 0.01, 4: 0.08}


def test_greedy_parts():
    assert retrieval.drop_near_duplicates(["a b c d", "a b c d", "x y"], 0.88) == [0, 2]
    assert retrieval.adaptive_k([0.9, 0.89, 0.5, 0.49, 0.48, 0.47, 0.46], 6, 0.1) == 2
    assert retrieval.adaptive_k([0.9, 0.1], 6, 0.1) == 2
    rng = random.Random(1)
    scores = sorted((rng.random() for _ in range(9)), reverse=True)
    matrix = np.random.default_rng(1).normal(size=(9, 5))
    assert retrieval.mmr(scores, matrix, 9, 1.0) == list(range(9))
    same = np.ones((3, 4))
    same[2] = [1, -1, 1, -1]
    assert retrieval.mmr([0.9, 0.89, 0.5], same, 2, 0.5) == [0, 2]


def test_hybrid_end_to_end(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"word{i % 7} rent clause number {i} of the agreement", [float(v) for v in rng.normal(size=64)]) for i in range(40)] + [(40, None, None)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string, vector array<double>")
    q = corpus.where("doc_id < 2").select(F.col("doc_id").alias("query_id"), F.lit("rent").alias("term"), F.lit(1).alias("mult"), F.lit(3).alias("words"), "vector")
    got = retrieval.Hybrid().retrieve(corpus, q, retrieval.Settings())
    assert {r["query_id"] for r in got.collect()} == {0, 1}
    assert got.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 6


def test_hybrid_looks_behind_copies(spark):
    """Copies and near-copies ahead of other texts don't use up the pool; against brute force over the whole corpus."""
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(60))
    texts = [f"rent {long}"] * 90 + [f"rent {long} x{i}" for i in range(90)] + [f"rent lease {i} " + " ".join(f"t{i}_{j}" for j in range(120)) for i in range(12)] + ["nothing of it", None]
    rows = [(i, t, [float(v) for v in rng.normal(size=64)]) for i, t in enumerate(texts)]
    rows[3] = (3, texts[3], None)
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string, vector array<double>")
    q = spark.createDataFrame([(7, "rent", 1, 9, rows[0][2])], "query_id bigint, term string, mult int, words int, vector array<double>")
    s = retrieval.Settings(top_k=6, pool=8, gap=1.0, mmr_lambda=1.0)
    got = [(r["doc_id"], round(r["score"], 9)) for r in retrieval.Hybrid().retrieve(corpus, q, s).orderBy("rank").collect()]

    lexical = {r["doc_id"]: r["score"] for r in bm25.score(corpus, q.select("query_id", "term", "mult")).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    near = {i: round(float(unit(v) @ unit(rows[0][2])), 6) if v else 0.0 for i, _, v in rows}
    b = {d: n for n, d in enumerate(sorted(near, key=lambda d: (-lexical.get(d, 0.0), d)), 1)}
    c = {d: n for n, d in enumerate(sorted(near, key=lambda d: (-near[d], d)), 1)}
    score = {d: round(1 / (60 + b[d]) + 1 / (60 + c[d]), 9) for d in near}
    order = sorted(score, key=lambda d: (-score[d], d))
    kept = [order[i] for i in retrieval.drop_near_duplicates([texts[d] or "" for d in order], s.jaccard)]
    assert len(got) == 6 and got == [(d, score[d]) for d in kept[:6]]


def test_budgets_keep_the_total(spark):
    df = spark.createDataFrame([("d", r, s) for r, s in enumerate((0.9, 0.05, 0.03, 0.02), 1)], "doc_id string, rank int, score double")
    got = {r["rank"]: r["budget"] for r in context.budgets(df, 1000, 200).collect()}
    assert sum(got.values()) <= 1000 and min(got.values()) == 200 and got[1] == 400
    zero = context.budgets(df.withColumn("score", F.lit(0.0)), 1000, 200)
    assert [r["budget"] for r in zero.collect()] == [250] * 4


def test_grades(spark):
    df = spark.createDataFrame([("The Rent is 1,850 dollars. [a.pdf, p. 1]", "rent: The Rent is 1,850"), ("It appears nothing.", "x"), ("", "x")], "a string, s string")
    got = df.select(A.grade_grounding(F.col("a"), F.col("s")).alias("g"), A.confidence(F.col("a"), F.col("s")).alias("c"), A.not_found(F.col("a")).alias("n")).collect()
    assert [r["g"] for r in got] == [100.0, 100.0, 100.0]
    assert all(0 <= r["c"] <= 1 for r in got) and got[0]["c"] > got[1]["c"]
    assert [r["n"] for r in got] == [False, False, True]
    ranks = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,), (None,)], "r int")
    assert [r[0] for r in ranks.select(A.grade_retrieval(F.col("r"))).collect()] == [100, 75, 50, 25, 10, 0]
