"""Similarity of vectors: exact search of a stated set of queries, norms and blends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    """Length of a vector in double precision; null for a null vector."""
    return F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))


def usable(vector: Column, dim: int) -> Column:
    """Neither null, of another length, with a null or not finite element, nor all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & ~bad & (norm(vector) > 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (length < 1e-10), 0.0).otherwise(dot / length)


def blend(a: Column, b: Column, share: float = 0.8) -> Column:
    """A question's vector with some of its context."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share))


def _matrix(values: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in values])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _packed(values: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(-1, dim)


UNIT = "id bigint, g string, v binary"


def _units(rows: DataFrame, dim: int) -> DataFrame:
    """id, g, unit vector as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(list(batch["v"])) if len(batch) else np.zeros((0, dim))
            yield pd.DataFrame({"id": batch["id"], "g": batch["g"], "v": [r.tobytes() for r in x]})

    return rows.mapInPandas(run, UNIT)


def _met(corpus: DataFrame, queries: DataFrame, dim: int, id_: str, vector: str, compare, schema: str, block: int, group: str | None = None) -> DataFrame:
    """What `compare(query ids, unit vectors, ids, groups, unit vectors)` gives for every batch of the corpus and every block of queries.

    The stated queries are few beside the corpus: up to `block` of them go to the tasks in one broadcast. More
    are numbered in blocks; each corpus row is sent to every block, and a task holds one block of queries and
    reads its share of the corpus as a stream.
    """
    spark = corpus.sparkSession
    kind = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = corpus.where(usable(F.col(vector), dim)).select(F.col(id_).cast("bigint").alias("id"), kind.alias("g"), F.col(vector).alias("v"))
    asked = queries.where(usable(F.col(vector), dim)).select(F.col(id_).cast("bigint").alias("id"), F.lit(None).cast("string").alias("g"), F.col(vector).alias("v"))
    many = asked.count()
    if many <= block:
        part = asked.toPandas()
        shared = spark.sparkContext.broadcast((part["id"].to_numpy(dtype=np.int64), _matrix(list(part["v"])) if len(part) else np.zeros((0, dim))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for batch in batches:
                if len(batch) and len(ids):
                    yield from compare(ids, q, batch["id"].to_numpy(dtype=np.int64), batch["g"].to_numpy(dtype=object), _matrix(list(batch["v"])))

        return rows.mapInPandas(run, schema)
    blocks = -(-many // block)
    left = _units(asked, dim).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    # corpus rows in pages, so that a page meets a block in one row and neither is unpacked again and again
    pages = _units(rows, dim).groupBy(F.spark_partition_id().alias("part"), F.floor(F.monotonically_increasing_id() / 1024).alias("page")).agg(F.collect_list("id").alias("own"), F.collect_list(F.coalesce("g", F.lit(""))).alias("kinds"), F.collect_list("v").alias("xs"))
    every = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, own, kinds, xs in zip(batch["ids"], batch["vs"], batch["own"], batch["kinds"], batch["xs"]):
                yield from compare(np.asarray(ids, dtype=np.int64), _packed(vs, dim), np.asarray(own, dtype=np.int64), np.asarray(kinds, dtype=object), _packed(xs, dim))

    return every.join(left, "block").select("ids", "vs", "own", "kinds", "xs").mapInPandas(run_blocks, schema)


def best_of_groups(corpus: DataFrame, queries: DataFrame, group: str, dim: int = 64, block: int = 8192, id_: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, group, id, score: of each group the row most similar to each query; ties by id."""

    def compare(ids, q, own, kinds, x):
        order = np.argsort(own, kind="stable")
        own, kinds, x = own[order], kinds[order], x[order]
        for a in range(0, len(ids), 512):
            sim = np.round(q[a : a + 512] @ x.T, 6)
            for g, at in pd.Series(range(len(own))).groupby(pd.Series(kinds), dropna=False).indices.items():
                best = sim[:, at].argmax(axis=1)  # the first of equals has the smallest id
                yield pd.DataFrame({"query_id": ids[a : a + 512], "g": g, "id": own[at[best]], "score": sim[np.arange(len(sim)), at[best]]})

    found = _met(corpus, queries, dim, id_, vector, compare, "query_id bigint, g string, id bigint, score double", block, group)
    best = found.groupBy("query_id", "g").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select("query_id", F.col("g").alias(group), (-F.col("b.i")).alias(id_), F.col("b.score").alias("score"))


def search(corpus: DataFrame, queries: DataFrame, k: int, dim: int = 64, block: int = 8192, id_: str = "vec_id", vector: str = "vector", same: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k rows most similar to each query, exactly; ties by id.

    Every batch of the corpus hands on only its k best (and ties of the last) for a query. Unusable vectors take
    no part; a row is no answer to its own query unless `same`.
    """

    def compare(ids, q, own, kinds, x):
        for a in range(0, len(ids), 512):
            sim = np.round(q[a : a + 512] @ x.T, 6)
            if not same:
                sim[ids[a : a + 512, None] == own[None, :]] = -9
            n = min(k, len(own))
            least = np.partition(sim, len(own) - n, axis=1)[:, len(own) - n]
            r, c = np.nonzero((sim >= least[:, None]) & (sim > -9))
            yield pd.DataFrame({"query_id": ids[a + r], "id": own[c], "score": sim[r, c]})

    found = _met(corpus, queries, dim, id_, vector, compare, "query_id bigint, id bigint, score double", block)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_)


def similarities(corpus: DataFrame, queries: DataFrame, dim: int = 64, block: int = 8192, id_: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, id, score of every usable row of the corpus for every usable query, a row for its own query too."""

    def compare(ids, q, own, kinds, x):
        for a in range(0, len(ids), 32):
            sim = np.round(q[a : a + 32] @ x.T, 6)
            yield pd.DataFrame({"query_id": np.repeat(ids[a : a + 32], len(own)), "id": np.tile(own, len(sim)), "score": sim.ravel()})

    return _met(corpus, queries, dim, id_, vector, compare, "query_id bigint, id bigint, score double", block).withColumnRenamed("id", id_)
