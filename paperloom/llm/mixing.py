"""Problem 7: a selection in which every source reaches its target share of the total size.

Unless it is given, the total is the largest for which no source has to be repeated more often than
allowed, so all shares can be met at once. Each source then needs `rate` copies of its size: every document gets
floor(rate) of them, and the fraction that is left is its probability of one more. The cube method
turns these probabilities into a selection: a step moves the probabilities of three documents along
the null space of the constraints (number of documents, number of tokens) until one of them is 0 or
1, which keeps both totals. This runs in salted blocks of each source; the LANDING or fewer undecided
documents of each block are gathered and moved on in the same way, and the last LANDING are landed
on the choice, of all there are, with the smallest miss in tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpoint

EPS = 1e-9
LANDING = 16
UNITS = "source string, doc_id bigint, n_tokens bigint, whole int, p double"


def clean_source(source: Column) -> Column:
    """One spelling of a source name: lower case, trimmed, words joined by underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractional probabilities through the null space of (1, size) until LANDING or fewer are left.

    The last LANDING - 2 rows stay as they are; two or fewer of the others remain undecided.
    """
    p = p.astype(float).copy()
    held: list[int] = []
    draws = rng.random(len(p) + 4).tolist()
    turn = 0
    p[(p <= EPS) | (p >= 1 - EPS)] = np.round(p[(p <= EPS) | (p >= 1 - EPS)])
    for k in range(len(p) - LANDING + 2):
        if not EPS < p[k] < 1 - EPS:
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for i, v in zip(held, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if draws[turn] * (up + down) < down else -down
        turn += 1
        stay = []
        for i, v in zip(held, u):
            p[i] += step * v
            if EPS < p[i] < 1 - EPS:
                stay.append(i)
            else:
                p[i] = round(p[i])
        held = stay
    return p


def flight_order(size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows from large to small, ties at random; at the end, for the landing, LANDING - 2 of all sizes, the largest
    too. The order leaves the inclusion probabilities as they are."""
    order = rng.permutation(len(size))
    order = order[np.argsort(-size[order], kind="stable")]
    spread = np.unique(np.linspace(0, 1, LANDING - 2) * (len(size) - 1)).astype(int) if len(size) > 4 * LANDING else np.arange(0)
    return np.concatenate([np.delete(order, spread), order[spread]])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the LANDING or fewer fractional probabilities that are left, for the smallest miss in
    tokens (then in documents)."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    if len(open_):
        want, many = float(p[open_] @ size[open_]), float(p[open_].sum())
        picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        miss = np.round(np.abs(picks @ size[open_] - want), 6)
        out[open_] = picks[np.lexsort((np.abs(picks.sum(axis=1) - many), miss))[0]]
    return out


def seed_of(source: str, block: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, block + 1, *source.encode()])


def rates(available: list[tuple[str, int]], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Copies of each source's size that give the target shares, as large as the repeats allow.

    With a given total each source gets its share of it, or all its repeats where they fall short. A
    source without tokens or repeats can't reach any share; the others keep their proportions.
    """
    have = dict(available)
    able = {s: (t, m * have.get(s, 0)) for s, t, m in targets if s and t and t > 0}
    if total is None:
        total = min((most / t for t, most in able.values() if most > 0), default=0.0)
    return {s: min(total * t, most) / have[s] if most > 0 else 0.0 for s, (t, most) in able.items()}


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, block: int = 20_000, seed: int = 11, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of rows (doc_id, source, n_tokens) and targets (source, target_share, max_repeats).

    selection: doc_id, source, n_tokens, copies, with copies > 0. report: source, target_share,
    reached_share, tokens, documents, copies, max_repeats, available_tokens. Rows of a source without a
    target take no part; texts of no tokens are drawn like others, as they cost nothing. With `whole` the
    total is all tokens of the wanted sources: scarce sources stop at their most repeats, short of their share.
    """
    wanted = targets.select(clean_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = [(r["source"], r["target_share"], r["max_repeats"] or 0) for r in wanted.collect()]  # one row a source
    named = checkpoint(sizes.select("doc_id", clean_source(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")))
    per = named.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    have = {r["source"]: (r["t"], r["c"]) for r in per.join(F.broadcast(wanted.select("source")), "source", "left_semi").collect()}
    if whole:
        total = float(sum(t for t, _ in have.values()))
    rate = rates([(s, t) for s, (t, _) in have.items()], goal, total)
    spark = sizes.sparkSession
    tasks = max(1, sum(max(1, -(-have[s][1] // block)) for s, r in rate.items() if s in have and r > 0))
    plan = spark.createDataFrame(
        [(s, float(r), max(1, -(-have[s][1] // block))) for s, r in rate.items() if s in have and r > 0], "source string, rate double, blocks int"
    )
    near = F.round("rate")  # a rate that is whole but for rounding must not leave a probability
    exact = F.when(F.abs(F.col("rate") - near) < 1e-7, near).otherwise(F.col("rate"))
    units = (
        named.join(F.broadcast(plan), "source")
        .withColumn("rate", exact)
        .select("source", "doc_id", "n_tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("bigint")).cast("int").alias("block"))
    )

    def fly(last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["doc_id", "n_tokens"], kind="stable")
            source, number = group["source"].iloc[0], int(group["block"].iloc[0])
            rng = seed_of(source, number, seed)
            group = group.iloc[flight_order(group["n_tokens"].to_numpy(), rng)]
            size = group["n_tokens"].to_numpy()
            p = flight(group["p"].to_numpy(), [int(v) for v in size], rng)
            if last:
                p = land(p, size.astype(float))
            return group.assign(p=p)[["source", "doc_id", "n_tokens", "whole", "p"]]

        return run

    # a task for each block: they are small in bytes, so that adaptive execution would run them all in one
    flown = checkpoint(units.repartition(tasks, "source", "block").groupBy("source", "block").applyInPandas(fly(False), UNITS))
    undecided = F.col("p").between(EPS, 1 - EPS)
    done, rest = flown.where(~undecided), flown.where(undecided)
    while (most := max((r["c"] for r in rest.groupBy("source").agg(F.count("*").alias("c")).collect()), default=0)) > block:
        again = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(most)), F.lit(-(-most // block))).cast("int"))
        flown = checkpoint(again.repartition(tasks, "source", "block").groupBy("source", "block").applyInPandas(fly(False), UNITS))
        done, rest = done.unionByName(flown.where(~undecided)), flown.where(undecided)
    landed = rest.withColumn("block", F.lit(-1)).groupBy("source", "block").applyInPandas(fly(True), UNITS)
    selection = (
        done.unionByName(landed)
        .select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies"))
        .where("copies > 0")
    )
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    whole = got.agg(F.sum("tokens").alias("total"))
    report = (
        wanted.join(got, "source", "left")
        .join(per.select("source", F.col("t").alias("available_tokens")), "source", "left")
        .join(F.broadcast(whole))  # one row
        .select(
            "source",
            F.round("target_share", 6).alias("target_share"),
            F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("reached_share"),
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "documents", "copies")],
            "max_repeats",
            F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        )
    )
    return selection, report
