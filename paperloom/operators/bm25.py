"""Inverted index and BM25 as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import keyword_set, tokens
from paperloom.functions.words import QUESTION_STOP
from paperloom.session import checkpoint

K1, B = 0.9, 0.5


def postings(docs: DataFrame, id_: str = "doc_id", group: str | None = None) -> DataFrame:
    """id, term, tf (and group) of every token of `text`; counted within tasks before the shuffle."""
    keys = [id_] + ([group] if group else [])
    return docs.select(*keys, F.explode(tokens(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame, id_: str = "doc_id", group: str | None = None) -> DataFrame:
    """id, dl: tokens of each document, 0 for null or empty texts."""
    keys = [id_] + ([group] if group else [])
    return docs.select(*keys, F.coalesce(F.when(F.col("text").isNotNull(), F.size(tokens(F.col("text")))), F.lit(0)).cast("bigint").alias("dl"))


def corpus_stats(stats: DataFrame, group: str | None = None) -> DataFrame:
    """n_docs, avg_dl of the corpus, or of each group of it."""
    per = stats.groupBy(group) if group else stats
    return per.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def term_stats(post: DataFrame, group: str | None = None) -> DataFrame:
    """term, df, cf: documents with a term and its count in all."""
    return post.groupBy(*([group] if group else []), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5) + 1))


def weight(tf: Column, dl: Column, avg_dl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def keyword_queries(docs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """query_id, term, mult: the keywords of each text, once each."""
    return docs.select(F.col(id_).alias("query_id"), F.explode(keyword_set(F.col("text"), QUESTION_STOP, 3)).alias("term"), F.lit(1).alias("mult"))


NO_TERM = ""
BROADCAST_TERMS = 500_000  # so many query terms at most are broadcast; more are joined by a shuffle


def matched_postings(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", group: str | None = None) -> DataFrame:
    """id, term, tf, dl (and group) of the terms that a query has, and a row without a term for every document.

    Texts are tokenised once: the size of a document travels with its tokens, terms that no query has are
    dropped before anything is shuffled, and the rows without a term carry the sizes of all documents.
    """
    keys = [id_] + ([group] if group else [])
    found = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    sized = docs.select(*keys, found.alias("w")).select(*keys, F.size("w").cast("bigint").alias("dl"), F.explode(F.array_append("w", F.lit(NO_TERM))).alias("term"))
    terms = queries.select("term").distinct()
    terms = terms.unionByName(docs.sparkSession.createDataFrame([(NO_TERM,)], "term string"))
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    return checkpoint(sized.join(terms, "term", "left_semi").groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")))


def score(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", group: str | None = None, post: DataFrame | None = None) -> DataFrame:
    """query_id, id, score (6 decimals) of documents that share a term with a query.

    queries: query_id, term, mult (and group): a term that a query has twice counts twice. With a group,
    documents, statistics and queries are those of one group. post: postings from `matched_postings` or
    `load_index`, which may hold more terms than the queries have.
    """
    extra = [group] if group else []
    post = matched_postings(docs, queries, id_, group) if post is None else post
    per = post.where(F.col("term") == NO_TERM)
    corpus = corpus_stats(per, group)
    wanted = queries.groupBy(*extra, "query_id", "term").agg(F.sum("mult").alias("mult"))
    terms = post.where(F.col("term") != NO_TERM).groupBy(*extra, "term").agg(F.count("*").alias("df"))
    # idf belongs to the few query terms, so it is joined to them and not to the postings
    wanted = wanted.join(terms, [*extra, "term"])
    wanted = wanted.join(corpus, extra) if group else wanted.join(F.broadcast(corpus))  # one row
    wanted = checkpoint(wanted.select(*extra, "query_id", "term", (F.col("mult") * idf(F.col("n_docs"), F.col("df"))).alias("qw"), "avg_dl"))
    matched = post.where(F.col("term") != NO_TERM)
    if wanted.count() <= BROADCAST_TERMS:
        # every document's postings lie in one task and meet the query terms there, so that the scores, of which
        # there are many more than postings, are summed up without a shuffle
        hits = matched.repartition(id_).join(F.broadcast(wanted), [*extra, "term"])
    else:
        hits = matched.join(wanted, [*extra, "term"])
    return hits.groupBy(*extra, "query_id", id_).agg(F.round(F.sum(F.col("qw") * weight(F.col("tf"), F.col("dl"), F.col("avg_dl"))), 6).alias("score"))


def save_index(docs: DataFrame, path: str, id_: str = "doc_id", buckets: int = 64) -> None:
    """Write the postings of all terms, with the size of each document, in folders by a hash of the term."""
    found = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    sized = docs.select(id_, found.alias("w")).select(id_, F.size("w").cast("bigint").alias("dl"), F.explode(F.array_append("w", F.lit(NO_TERM))).alias("term"))
    post = sized.groupBy(id_, "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", bucket(F.col("term"), buckets))
    post.repartition(buckets, "bucket", F.pmod(F.xxhash64(id_), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path, mode="overwrite")


def bucket(term: Column, buckets: int) -> Column:
    """The folder of a term; documents' own rows have one of their own."""
    return F.when(term == NO_TERM, F.lit(-1)).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def load_index(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """Postings of a saved index; with queries, of their terms only, found by join and not by a new tokenisation."""
    post = spark.read.parquet(path).drop("bucket")
    if queries is None:
        return post
    terms = queries.select("term").distinct().unionByName(spark.createDataFrame([(NO_TERM,)], "term string"))
    return post.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")


def top(scored: DataFrame, k: int, id_: str = "doc_id", by: str = "score") -> DataFrame:
    """The k best of each query with their rank, ties by id; pruned to k in every task."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), id_))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
