"""Queries of retrieval: index, rankings, fusion, diversity. The stated queries are the rows whose id is
divisible by 50; texts and vectors are paired by doc_id = vec_id."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import words as W
from paperloom.functions.text import any_of, keyword_set
from paperloom.operators import bm25, classify, fusion, lists, retrieval, vectors
from paperloom.plans.registry import query
from paperloom.plans.text_queries import _quote, sql_any
from paperloom.session import read_table, shared_folder

_STOP = ", ".join(map(_quote, W.QUESTION_STOP))
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2)"
_POST = f"""t as (select doc_id, unnest({_TOKENS}) as term from documents), p as (select doc_id, term, count(*) as tf from t group by doc_id, term),
d as (select doc_id, coalesce(len({_TOKENS}), 0) as dl from documents), s as (select count(*) as n_docs, avg(dl) as avg_dl from d), f as (select term, count(*) as df, sum(tf) as cf from p group by term)"""
_QUERIES = rf"""q as (select distinct doc_id as query_id, term from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) as term from documents where doc_id % 50 = 0) where strlen(term) >= 3 and term not in ({_STOP}))"""
_SCORE = """b as (select query_id, doc_id, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl / avg_dl))), 6) as score from q join f using (term) join p using (term) join d using (doc_id), s group by query_id, doc_id)"""
_VECTORS = """u as (select vec_id, list_transform(vector, lambda x: cast(x as double)) as v from embed_cache where vector is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as (select vec_id, v from u where list_inner_product(v, v) > 0)"""
_COSINE = "c as (select a.vec_id as query_id, b.vec_id as doc_id, round(list_cosine_similarity(a.v, b.v), 6) as score from v a join v b on true where a.vec_id % 50 = 0 and b.vec_id in (select doc_id from documents) and a.vec_id in (select doc_id from documents))"
_ALL = f"""with {_POST}, {_QUERIES}, {_SCORE}, {_VECTORS}, {_COSINE}, e as (select query_id, doc_id, coalesce(b.score, 0) as bm25, coalesce(c.score, 0) as cosine from (select query_id, doc_id from (select distinct query_id from q) x, documents) left join b using (query_id, doc_id) left join c using (query_id, doc_id)),
l as (select *, row_number() over (partition by query_id order by bm25 desc, doc_id) as rb, row_number() over (partition by query_id order by cosine desc, doc_id) as rc from e)"""
_BOTH = f"with {_POST}, {_QUERIES}, {_SCORE}, {_VECTORS}, {_COSINE}, lb as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b), lc as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from c)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _stated(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 50 = 0")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = read_table(spark, sf_dir, "embed_cache").select(F.col("vec_id").alias("doc_id"), "vector")
    return _documents(spark, sf_dir).join(vec, "doc_id", "left")


def _asked(stated: DataFrame) -> DataFrame:
    """The keywords of each stated text, with its size in words and its vector."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return stated.select(F.col("doc_id").alias("query_id"), F.explode(keyword_set(F.col("text"), W.QUESTION_STOP, 3)).alias("term"), F.lit(1).alias("mult"), words.alias("words"), "vector")


def _ranked_texts(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k best texts of each stated query by BM25."""
    docs = _documents(spark, sf_dir)
    index = lists.build(docs)
    return lists.settled(lists.top(index, bm25.keyword_queries(_stated(docs)), k), index).select("query_id", "doc_id", "rank", "score")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, the vectors by doc_id, and the stated queries with their vectors."""
    docs = _documents(spark, sf_dir)
    vec = read_table(spark, sf_dir, "embed_cache").select(F.col("vec_id").alias("doc_id"), "vector")
    return docs, vec, _asked(_stated(docs).join(_stated(vec), "doc_id", "left"))


def _form() -> Column:
    return F.coalesce(F.col("text").startswith("FILLED FORM DATA"), F.lit(False))


def _fused_top(spark: SparkSession, sf_dir: str, kb: float, kc: float, form_boost: float = 0.0) -> DataFrame:
    """The ten best of each query by reciprocal ranks over both whole lists, and a boost of filled forms."""
    docs, vec, asked = _both(spark, sf_dir)
    index = lists.build(docs, vectors=vec, marks={"form": _form()})

    def use(q, corpus, scores, near):
        # every text is in both lists, so that none is below 0
        rows = [(np.round(scores[0], 6), kb), (near - near.min(initial=0.0), kc)]
        at, score = lists.fused_top(rows, 10, form_boost * corpus.marks["form"] if form_boost else None)
        return {"doc_id": corpus.ids[at], "rank": np.arange(1, len(at) + 1), "score": score}

    return lists.settled(lists.run(index, asked, use, "query_id bigint, doc_id bigint, rank bigint, score double"), index)


def _blended(spark: SparkSession, sf_dir: str, form_boost: float = 0.0) -> DataFrame:
    """Half the cosine and half the share of the largest BM25 of the query, of every text for every query; with a
    boost, filled forms gain it and the score is at most 1."""
    docs, vec, asked = _both(spark, sf_dir)
    index = lists.build(docs, vectors=vec, marks={"form": _form()})

    def use(q, corpus, scores, near):
        row = np.round(scores[0], 6)
        most = row.max(initial=0.0)
        score = 0.5 * near + 0.5 * (row / most if most > 0 else row)
        if form_boost:
            score = np.minimum(1.0, score + form_boost * corpus.marks["form"])
        return np.round(score, 8)

    return lists.run(index, asked, use, "query_id bigint, doc_id bigint, score double", whole=True)


@query(f"with {_POST} select doc_id, dl from d")
def bm25_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.doc_stats(_documents(spark, sf_dir))


@query(f"with {_POST} select term, df, cast(cf as bigint) as cf from f")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(bm25.postings(_documents(spark, sf_dir)))


@query(f"with {_POST}, {_QUERIES}, {_SCORE} select query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b) where rank <= 10", wide=("rank",))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_texts(spark, sf_dir, 10)


@query(f"""
with d0 as (select doc_id, text, coalesce(source, '') as source from documents), t as (select source, doc_id, unnest({_TOKENS}) as term from d0), p as (select source, doc_id, term, count(*) as tf from t group by all),
d as (select source, doc_id, coalesce(len({_TOKENS}), 0) as dl from d0), s as (select source, count(*) as n_docs, avg(dl) as avg_dl from d group by source), f as (select source, term, count(*) as df from p group by all),
q as (select distinct source, doc_id as query_id, term from (select source, doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as term from d0 where doc_id % 50 = 0) where strlen(term) >= 3 and term not in ({_STOP})),
b as (select source, query_id, doc_id, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl / avg_dl))), 6) as score from q join f using (source, term) join p using (source, term) join d using (source, doc_id) join s using (source) group by all)
select source, query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b) where rank <= 10""", wide=("rank",))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, documents and queries of one source: what a filter before scoring gives."""
    docs = _documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("")))
    own = _stated(docs)
    queries = own.select("source", F.col("doc_id").alias("query_id"), F.explode(keyword_set(F.col("text"), W.QUESTION_STOP, 3)).alias("term"), F.lit(1).alias("mult"))
    index = lists.build(docs, group="source")
    return lists.settled(lists.top(index, queries, 10, group="source"), index).select(F.col("g").alias("source"), "query_id", "doc_id", "rank", "score")


@query(f"""with {_VECTORS}, c as (select a.vec_id as query_id, b.vec_id as vec_id, round(list_cosine_similarity(a.v, b.v), 6) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, vec_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c) where rank <= 10""", wide=("rank",))
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = read_table(spark, sf_dir, "embed_cache").select("vec_id", "vector")
    return vectors.search(vec, vec.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "rank", "score")


@query(f"with {_VECTORS} select vec_id, round(sqrt(list_inner_product(v, v)), 6) as norm from v")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = read_table(spark, sf_dir, "embed_cache").where(vectors.usable(F.col("vector"), 64))
    return vec.select("vec_id", F.round(vectors.norm(F.col("vector")), 6).alias("norm"))


@query("""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
m as (select label, list(s order by i) as v from (select label, i, sum(x) as s from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by label, i) group by label),
c as (select e.label, vec_id, round(list_cosine_similarity(e.v, m.v), 6) as score from e join m using (label))
select label, vec_id, score from (select *, row_number() over (partition by label order by score desc, vec_id) as r from c) where r = 1""")
def cosine_best_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of each label that is most like the mean of the label."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    mean = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("m"))
    scored = e.join(mean, "label").select("label", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("m")), 6).alias("score"))
    return scored.groupBy("label").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b")).select("label", "b.vec_id", "b.score")


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
select a.vec_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(0.8 * p[1] + 0.2 * p[2], 2))), 6) as energy from e a join e b on b.vec_id = a.vec_id + 1""")
def vector_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("context"))
    mixed = e.join(after, "vec_id").select("vec_id", vectors.blend(F.col("embedding"), F.col("context")).alias("m"))
    return mixed.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


_TEN = "select query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r) where rank <= 10"


@query(f"{_ALL}, r as (select query_id, doc_id, round(1.0 / (60 + rb) + 1.0 / (60 + rc), 9) as score from l) {_TEN}", wide=("rank",))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal ranks over both whole lists."""
    return _fused_top(spark, sf_dir, 60.0, 60.0)


@query(f"{_ALL}, r as (select query_id, doc_id, round(1.0 / (20 + rb) + 1.0 / (40 + rc), 9) as score from l) {_TEN}", wide=("rank",))
def rrf_short_query_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused_top(spark, sf_dir, 20.0, 40.0)


@query(f"{_ALL}, r as (select query_id, doc_id, round(round(1.0 / (60 + rb) + 1.0 / (60 + rc), 9) + case when starts_with(text, 'FILLED FORM DATA') then 0.15 else 0 end, 9) as score from l join documents using (doc_id)) {_TEN}", wide=("rank",))
def rrf_form_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion for questions about forms: filled forms gain."""
    return _fused_top(spark, sf_dir, 60.0, 60.0, 0.15)


_PARTY = f"""(text is not null and len(list_filter({list(W.PARTY_ROLES)}, lambda w: contains(lower(text), w))) > 0)"""
_BOOST = f"""{_ALL}, r as (select query_id, doc_id, round(1.0 / (60 + rb) + 1.0 / (60 + rc), 9) as score from l),
m as (select *, median(score) over (partition by query_id) as middle from r), y as (select doc_id, text, row_number() over (partition by coalesce(source, '') order by created_at, doc_id) - 1 as position from documents), ask as (select doc_id as query_id, {_PARTY} as asks from documents),
g as (select query_id, doc_id, score, middle, position, asks, (0.08 - position * 0.03) * case when {sql_any("lower(text)", W.CAPTION_ROLES)} and len(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), lambda x: strlen(x) >= 3 and not regexp_matches(x, '[^\\p{{Lu}}]') and x not in ({", ".join(map(_quote, W.CAPTION_BOILERPLATE))}))) > 0 then 1.5 else 1 end as gain from m join y using (doc_id) join ask using (query_id))
select query_id, doc_id, round(score + case when asks and position <= 2 and score >= middle and gain > 0 then gain else 0 end, 9) as score from g"""


@query(_BOOST)
def rrf_intro_boost_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost of the first texts of a source for queries that name a party, over the median of all fused scores."""
    d = read_table(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy(F.coalesce("source", F.lit(""))).orderBy("created_at", "doc_id")) - 1
    first = d.select("doc_id", "source", "created_at").select("doc_id", place.alias("position")).where("position <= 2")
    early = d.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("doc_id", "position", classify.caption(F.col("text")).alias("caption"))
    gain = (0.08 - F.col("position") * 0.03) * F.when(F.col("caption"), 1.5).otherwise(1.0)
    gains = {r["doc_id"]: r["gain"] for r in early.select("doc_id", gain.alias("gain")).where("gain > 0").collect()}  # at most three a source
    docs, vec, asked = _both(spark, sf_dir)
    party = F.coalesce(any_of(F.lower("text"), W.PARTY_ROLES), F.lit(False))
    asked = asked.join(_stated(docs).select(F.col("doc_id").alias("query_id"), party.alias("party")), "query_id")
    index = lists.build(docs, vectors=vec)
    places, due = np.array(sorted(gains), dtype=np.int64), np.array([gains[i] for i in sorted(gains)], dtype=float)

    def use(q, corpus, scores, near):
        score = lists.fused(np.round(scores[0], 6), near, 60.0, 60.0)
        if q["party"] and len(places):
            at = np.searchsorted(corpus.ids, places)
            score[at] = np.where(score[at] >= np.median(score), np.round(score[at] + due, 9), score[at])
        return score

    return lists.run(index, asked, use, "query_id bigint, doc_id bigint, score double", carry=("party",), whole=True)


@query(f"{_ALL} select query_id, doc_id, round(0.5 * cosine + 0.5 * case when max(bm25) over (partition by query_id) > 0 then bm25 / max(bm25) over (partition by query_id) else 0 end, 8) as score from l")
def hybrid_alpha_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir)


@query(f"{_ALL} select query_id, doc_id, round(least(1, 0.5 * cosine + 0.5 * case when max(bm25) over (partition by query_id) > 0 then bm25 / max(bm25) over (partition by query_id) else 0 end + case when starts_with(text, 'FILLED FORM DATA') then 0.15 else 0 end), 8) as score from l join documents using (doc_id)")
def hybrid_form_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend with a boost of filled forms, at most 1."""
    return _blended(spark, sf_dir, 0.15)


@query(f"{_ALL} select query_id, doc_id, round(bm25, 6) as score from l")
def bm25_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every text for every query, 0 where no term is shared."""
    docs = _documents(spark, sf_dir)

    def use(q, corpus, scores, near):
        return np.round(scores[0], 6)

    return lists.run(lists.build(docs), bm25.keyword_queries(_stated(docs)), use, "query_id bigint, doc_id bigint, score double", whole=True)


@query(f"with {_POST}, {_QUERIES}, {_SCORE} select query_id, doc_id, rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b) where rank <= 5", wide=("rank",))
def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking from postings that were written once and are read by their terms."""
    docs = _documents(spark, sf_dir)
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    lists.build(docs, root=path, keep=True).save()
    index = lists.load(path)
    return lists.settled(lists.top(index, bm25.keyword_queries(_stated(docs)), 5), index).select("query_id", "doc_id", "rank", "score")


_VARIANTS = f"""v as (select query_id, term, 0 as variant from q union all select query_id, term, 1 from q where strlen(term) >= 6 union all select query_id, term, 2 from q where regexp_matches(term, '^[a-m]')),
vb as (select query_id, variant, doc_id, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl / avg_dl))), 6) as score from v join f using (term) join p using (term) join d using (doc_id), s group by all),
vr as (select *, row_number() over (partition by query_id, variant order by score desc, doc_id) as rank from vb)"""


@query(f"with {_POST}, {_QUERIES}, {_VARIANTS}, r as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from vr group by all) {_TEN}", wide=("rank",))
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three variants of each query (all its keywords, the long ones, those of the first half of the
    alphabet), merged by the sum of their reciprocal ranks."""
    docs = _documents(spark, sf_dir)
    asked = bm25.keyword_queries(_stated(docs))
    variants = asked.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    kept = (F.col("variant") == 0) | ((F.col("variant") == 1) & (F.octet_length("term") >= 6)) | ((F.col("variant") == 2) & F.col("term").rlike("^[a-m]"))
    return retrieval.merge_variants(docs, variants.where(kept), top=10).select("query_id", "doc_id", "rank", "score")


_FLOORS = {m: v[5] for m, v in W.MODES.items()}


@query(f"{_ALL}, best_of as (select query_id, max(cosine) as best from l group by query_id) select query_id, best, case when best >= {_FLOORS['quick']} then 'quick' when best >= {_FLOORS['balanced']} then 'balanced' when best >= {_FLOORS['extended']} then 'extended' else 'not_found' end as route from best_of")
def route_by_cosine_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest mode whose floor a query's best cosine reaches; below all floors nothing is answered from documents."""
    docs, vec, asked = _both(spark, sf_dir)
    index = lists.build(docs.select("doc_id", F.lit(None).cast("string").alias("text")), vectors=vec)  # no postings are needed

    def use(q, corpus, scores, near):
        return {"best": near.max(keepdims=True)}

    best = lists.settled(lists.run(index, asked, use, "query_id bigint, best double", lexical=False), index)
    return best.select("query_id", "best", retrieval.route(F.col("best"), _FLOORS).alias("route"))


@query(f"""with {_POST}, {_QUERIES}, {_SCORE}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b), o as (select * from r where rank <= 20),
g as (select *, count(*) over (partition by query_id) as n, round(score - lead(score) over (partition by query_id order by rank), 9) as step from o),
k as (select *, first_value(rank) over (partition by query_id order by case when rank < 6 and step > 0.5 then step else -1 end desc, rank rows between unbounded preceding and unbounded following) as cut_at, max(case when rank < 6 and step > 0.5 then step end) over (partition by query_id) as most from g)
select query_id, doc_id, rank, score from k where rank <= case when n <= 6 then n when most is null then 6 else greatest(2, least(6, cut_at)) end""", wide=("rank",))
def adaptive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.adaptive_cut(_ranked_texts(spark, sf_dir, 20), 6, 0.5).select("query_id", "doc_id", "rank", "score")


@query(f"""with {_POST}, {_QUERIES}, {_SCORE}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b), o as (select query_id, doc_id, rank, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from r join documents using (doc_id) where rank <= 10)
select a.query_id, a.doc_id as doc_a, b.doc_id as doc_b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) as jaccard from o a join o b on a.query_id = b.query_id and a.rank < b.rank""")
def jaccard_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the word sets within the ten results of each query."""
    docs = _documents(spark, sf_dir)
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    out = _ranked_texts(spark, sf_dir, 10).join(docs.select("doc_id", words.alias("w")), "doc_id")
    a, b = out.alias("a"), out.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    share = F.size(F.array_intersect("a.w", "b.w")) / F.size(F.array_union("a.w", "b.w"))
    return both.select("a.query_id", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.round(share, 6).alias("jaccard"))


@query(f"""{_BOTH}, w as (select l.query_id, l.doc_id, l.score, coalesce(d.source, '') as source from lc l join documents d using (doc_id)), h as (select distinct query_id, source from w join lc using (query_id, doc_id) where rank <= 6),
m as (select query_id, list(score order by score) as s from lc where rank <= 6 group by query_id), o as (select w.*, row_number() over (partition by w.query_id, w.source order by w.score desc, doc_id) as r from w where not exists (select 1 from h where h.query_id = w.query_id and h.source = w.source))
select query_id, source, doc_id, score, round(0.8 * s[len(s) // 2 + 1], 6) as given from o join m using (query_id) where r = 1 and score > 0.15""")
def diversity_best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source without a hit among six, its best text over 0.15; its score is 0.8 of the upper median."""
    corpus = _paired(spark, sf_dir)
    stated = _stated(corpus)
    hits = vectors.search(corpus, stated, 6, id_="doc_id", same=True)
    source = F.coalesce("source", F.lit(""))
    per_source = vectors.best_of_groups(corpus.withColumn("source", source), stated, "source", id_="doc_id")
    held = hits.join(corpus.select("doc_id", source.alias("source")), "doc_id").select("query_id", "source").distinct()
    given = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s")).select("query_id", F.round(0.8 * F.expr("s[size(s) div 2]"), 6).alias("given"))
    return per_source.join(held, ["query_id", "source"], "left_anti").where("score > 0.15").join(given, "query_id").select("query_id", "source", "doc_id", "score", "given")


def _hybrid_sql(depth: int = 150) -> str:
    """The flagship in SQL; near-duplicates are looked for among the first `depth` different texts of a query, which is
    deeper than any pool of the test tables reaches."""
    k, pool, _, _, lam, _, same, gap, *_ = W.MODES["balanced"]
    parts = [f"""{_ALL}, u1 as (select doc_id as query_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 5 as short, doc_id in (select vec_id from v) as seen from documents),
fz as (select query_id, doc_id, round(1.0 / (case when short then 20 else 60 end + rb) + case when seen then 1.0 / (case when short then 40 else 60 end + rc) else 0 end, 9) as score from l join u1 using (query_id)),
ws as (select doc_id, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as w from documents), kd as (select doc_id, w, case when len(w) = 0 then 'id:' || doc_id else array_to_string(list_sort(w), ' ') end as kind from ws),
fr as (select query_id, kind, min({{'s': -score, 'd': doc_id}}) as m from fz join kd using (doc_id) group by query_id, kind), rk as (select query_id, m.d as doc_id, -m.s as score, row_number() over (partition by query_id order by m.s, m.d) as rank from fr),
tp as (select query_id, rk.doc_id, score, rank, w from rk join kd using (doc_id) where rank <= {depth}),
pr as (select a.query_id, a.rank as early, b.rank as late from tp a join tp b on a.query_id = b.query_id and a.rank < b.rank where len(a.w) > 0 and least(len(a.w), len(b.w)) > {same} * greatest(len(a.w), len(b.w)) and len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > {same}),
gr(query_id, pos, kept) as (select distinct query_id, 0, [cast(0 as bigint)] from tp union all select gr.query_id, pos + 1, case when exists (select 1 from tp where tp.query_id = gr.query_id and tp.rank = pos + 1) and not exists (select 1 from pr where pr.query_id = gr.query_id and pr.late = pos + 1 and list_contains(kept, pr.early)) then list_append(kept, pos + 1) else kept end from gr where pos < {depth}),
po as (select *, row_number() over (partition by query_id order by rank) as n from (select tp.* from tp join gr on gr.query_id = tp.query_id and pos = {depth} and list_contains(kept, tp.rank))), pl as (select * from po where n <= {pool}),
st as (select query_id, n, round(score - lead(score) over (partition by query_id order by n), 9) as step, count(*) over (partition by query_id) as cnt from pl),
ct as (select query_id, any_value(cnt) as cnt, max({{'step': step, 'n': -n}}) filter (where n < {k} and step > {gap}) as best from st group by query_id), kk as (select query_id, case when cnt <= {k} then cnt when best is null then {k} else least(greatest(-best.n, 2), {k}) end as k from ct),
g0 as (select pl.query_id, pl.doc_id, score, n, v.v as x, cast(0 as double) as near from pl left join v on v.vec_id = pl.doc_id)"""]
    for i in range(1, k + 1):
        worth = "score" if i == 1 else f"round({lam} * score - {round(1 - lam, 6)} * near, 12)"
        parts.append(f"c{i} as (select query_id, doc_id, score, x from (select *, row_number() over (partition by query_id order by {worth} desc, n) as r from g{i - 1}) where r = 1)")
        parts.append(f"g{i} as (select g.query_id, g.doc_id, g.score, g.n, g.x, greatest(g.near, coalesce(list_cosine_similarity(g.x, c.x), 0)) as near from g{i - 1} g join c{i} c on g.query_id = c.query_id and g.doc_id <> c.doc_id)")
    chosen = " union all ".join(f"select query_id, doc_id, {i} as rank, score from c{i} join kk using (query_id) where k >= {i}" for i in range(1, k + 1))
    return ", ".join(parts).replace("with t as", "with recursive t as", 1) + " " + chosen


@query(_hybrid_sql())
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: both rankings, fusion, near-duplicate removal, adaptive cut and diversity for all stated queries."""
    corpus = _paired(spark, sf_dir)
    terms = _asked(_stated(corpus))
    return retrieval.Hybrid().retrieve(corpus.select("doc_id", "text", "vector"), terms, retrieval.Settings.of_mode("balanced"))


@query("""
with c as (select distinct doc_id, file_name, page_number, chunk_index, length(text) as n from chunks), r as (select *, row_number() over (partition by file_name, page_number order by n desc, chunk_index, doc_id) as r from c)
select file_name, page_number, doc_id, chunk_index, n as size from r where r = 1""", wide=("size",))
def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first citation of each page; here the longest chunk stands for the best score."""
    c = read_table(spark, sf_dir, "chunks").select("doc_id", "file_name", "page_number", "chunk_index", F.length("text").alias("size")).distinct()
    rank = F.row_number().over(Window.partitionBy("file_name", "page_number").orderBy(F.desc("size"), "chunk_index", "doc_id"))
    return c.withColumn("r", rank).where("r = 1").select("file_name", "page_number", "doc_id", "chunk_index", "size")


@query("""
with c as (select distinct doc_id, chunk_index, page_number, length(text) as n from chunks), r as (select *, row_number() over (partition by doc_id order by n desc, chunk_index, page_number) as rank, max(n) over (partition by doc_id) as m from c)
select doc_id, chunk_index, page_number, rank, case when rank <= 2 and n >= 0.75 * m then 'primary' else 'secondary' end as tier from r where rank <= 6""", wide=("rank",))
def citation_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "page_number", F.length("text").alias("n")).distinct()
    w = Window.partitionBy("doc_id")
    r = c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "chunk_index", "page_number"))).withColumn("m", F.max("n").over(w))
    tier = F.when((F.col("rank") <= 2) & (F.col("n") >= 0.75 * F.col("m")), "primary").otherwise("secondary")
    return r.where("rank <= 6").select("doc_id", "chunk_index", "page_number", "rank", tier.alias("tier"))


@query("""
with c as (select distinct doc_id, page_number, chunk_index, length(text) as n from chunks), r as (select *, row_number() over (partition by doc_id, page_number order by n desc, chunk_index) as r from c), k as (select *, row_number() over (partition by doc_id order by n desc, chunk_index, page_number) as rank from r where r <= 2)
select doc_id, page_number, chunk_index, rank from k where rank <= 6""", wide=("rank",))
def page_capped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two chunks of a page among the six of a file."""
    c = read_table(spark, sf_dir, "chunks").select("doc_id", "page_number", "chunk_index", F.length("text").alias("n")).distinct()
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy(F.desc("n"), "chunk_index"))).where("r <= 2")
    k = r.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "chunk_index", "page_number")))
    return k.where("rank <= 6").select("doc_id", "page_number", "chunk_index", "rank")
