"""Problem 6: fill containers of fixed capacity with whole items.

Pattern packing by non-negative least squares. Only the histogram of item lengths, which has at most
`capacity` rows, reaches the driver. There, patterns of a few length classes that fill a container
are enumerated, their repeat counts are fitted to the histogram, rounded down to what is there, and
the items that are left go best-fit into the room that remains. The result is a run-length plan (so
many containers with these lengths), again as small as the histogram allows. Items are numbered
within their length and look up their container in the plan, so no item is moved to the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import checkpoint

CLASSES, DEPTH = 64, 4


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write `classes` as a falling sum of at most `depth` parts."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(head)
        elif len(head) < depth:
            for part in range(min(rest, head[-1] if head else rest), 0, -1):
                if part * (depth - len(head)) >= rest:
                    grow((*head, part), rest - part)

    grow((), classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= tol:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many containers, lengths in each); every item of the histogram is placed exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0 and 0 < n <= capacity}
    if not left:
        return []
    width = -(-capacity // CLASSES)
    by_class: dict[int, list[list[int]]] = defaultdict(list)
    for n in sorted(left):
        by_class[-(-n // width)].append([n, left[n]])  # the longest of a class is last and goes first
    stock = np.array([sum(c for _, c in by_class[k]) for k in range(1, CLASSES + 1)], dtype=float)
    forms = [f for f in patterns() if max(f) * width <= capacity + width - 1 and sum(f) * width <= capacity]
    groups: list[tuple[int, list[int]]] = []
    if forms:
        matrix = np.zeros((CLASSES, len(forms)))
        for k, f in enumerate(forms):
            for part in f:
                matrix[part - 1, k] += 1
        # what is left of the short classes fills gaps later, so a misfit there costs little
        weight = np.sqrt(np.arange(1, CLASSES + 1) / CLASSES)
        repeat = nnls(matrix * weight[:, None], stock * weight)
        for k in np.argsort(-repeat, kind="stable"):
            need = matrix[:, k]
            times = int(min(np.rint(repeat[k]), np.min(stock[need > 0] // need[need > 0])))
            if times <= 0:
                continue
            stock -= times * need
            runs = [take(by_class[part], times) for part in forms[k]]
            groups.extend(refine(runs))
    rest = sorted(([n, c] for items in by_class.values() for n, c in items if c), reverse=True)
    return best_fit(groups, rest, capacity)


def take(items: list[list[int]], many: int) -> list[tuple[int, int]]:
    """Take `many` items from the end of a class: runs of (length, count)."""
    out = []
    while many:
        n, c = items[-1]
        m = min(c, many)
        out.append((n, m))
        many -= m
        items[-1][1] -= m
        if not items[-1][1]:
            items.pop()
    return out


def refine(runs: list[list[tuple[int, int]]]) -> list[tuple[int, list[int]]]:
    """Lay runs of equal total beside each other: groups of containers with the same lengths."""
    out, at = [], [0] * len(runs)
    left = [r[0][1] for r in runs]
    total = sum(c for _, c in runs[0])
    while total:
        m = min(left)
        out.append((m, [r[k][0] for r, k in zip(runs, at)]))
        total -= m
        for s, r in enumerate(runs):
            left[s] -= m
            if not left[s] and at[s] + 1 < len(r):
                at[s] += 1
                left[s] = r[at[s]][1]
    return out


def best_fit(groups: list[tuple[int, list[int]]], items: list[list[int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Place runs of (length, count), longest first, where the least room is left over."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for c, lengths in groups:
        room[capacity - sum(lengths)].append((c, lengths))
    keys = sorted(room)

    def put(free: int, group: tuple[int, list[int]]) -> None:
        if free not in room or not room[free]:
            if free not in room:
                insort(keys, free)
            room[free] = []
        room[free].append(group)

    for n, many in items:
        while many:
            at = bisect_left(keys, n)
            while at < len(keys) and not room[keys[at]]:
                del room[keys[at]]
                del keys[at]
            if at == len(keys):
                fit = capacity // n
                full, part = divmod(many, fit)
                if full:
                    put(capacity - fit * n, (full, [n] * fit))
                if part:
                    put(capacity - part * n, (1, [n] * part))
                break
            free = keys[at]
            c, lengths = room[free].pop()
            fit = free // n  # as many of this length as go into one container
            full = min(c, many // fit)
            if full:
                put(free - fit * n, (full, lengths + [n] * fit))
                many -= full * fit
                c -= full
            if c and many and many < fit:
                put(free - many * n, (1, lengths + [n] * many))
                many, c = 0, c - 1
            if c:
                put(free, (c, lengths))
    return [g for free in sorted(room) for g in room[free]]


def plan_rows(plan: list[tuple[int, list[int]]], first: int = 0) -> list[tuple[int, int, int, int]]:
    """(length, rank of the first item, first container, place in the container) of each run of the plan."""
    out, used, at = [], defaultdict(int), first
    for c, lengths in plan:
        place = 0
        for n in lengths:
            out.append((n, used[n], at, place))
            used[n] += c
            place += n
        at += c
    return out


def numbered(items: DataFrame, histogram: dict[int, int], per_salt: int) -> DataFrame:
    """Add `rank`, 0 and up within each length: ranks of salted groups plus the sizes of those before.

    A length has as many salts as it needs for groups of about `per_salt` rows, so that one length that holds
    a third of all items, as the full pieces of long texts may, is ranked by many tasks.
    """
    spark = items.sparkSession
    salts = spark.createDataFrame([(int(n), max(1, -(-int(c) // per_salt))) for n, c in histogram.items()], "n int, salts bigint")  # a row a length
    salted = items.join(F.broadcast(salts), "n").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("n", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("n", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("n", "salt").orderBy("doc_id", "piece_no")
    return salted.withColumn("r", F.row_number().over(inside)).join(base, ["n", "salt"]).withColumn("rank", F.col("base") + F.col("r") - 1).drop("salt", "r", "base")


def pack(sizes: DataFrame, capacity: int = 2048, per_salt: int = 50_000) -> DataFrame:
    """container_id, doc_id, piece_no, start_token, n_tokens, place for rows of (doc_id, n_tokens).

    An item over the capacity is cut into full containers and one rest, all others stay whole. An
    item of no tokens takes no room and stands in container 0. Repeated rows are items of their own.
    """
    spark = sizes.sparkSession
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)) - 1
    items = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no")).select(
        "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("n")
    )
    items = checkpoint(items)  # sizes are narrow and used twice; the tokenizer runs once
    histogram = {r["n"]: r["c"] for r in items.groupBy("n").agg(F.count("*").alias("c")).collect()}
    rows = sorted(plan_rows(plan_containers(histogram, capacity)))
    arrays = spark.sparkContext.broadcast(tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else None)
    high = np.int64(1) << 44

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = arrays.value
        for batch in batches:
            n = batch["n"].to_numpy(dtype=np.int64)
            rank = batch["rank"].to_numpy(dtype=np.int64)
            container, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            some = n > 0
            if runs is not None and some.any():
                at = np.searchsorted(runs[0] * high + runs[1], n[some] * high + rank[some], side="right") - 1
                container[some] = runs[2][at] + rank[some] - runs[1][at]
                offset[some] = runs[3][at]
            yield pd.DataFrame({"container_id": container, "doc_id": batch["doc_id"], "piece_no": batch["piece_no"], "start_token": batch["start_token"], "n_tokens": n, "place": offset})

    return numbered(items, histogram, per_salt).mapInPandas(place, "container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint, place bigint")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items, tokens, the share of room filled and cut documents."""
    return packed.agg(
        F.count_distinct("container_id").alias("containers"),
        F.count("*").alias("items"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
        F.round(F.sum("n_tokens") / (F.count_distinct("container_id") * capacity), 6).alias("filled"),
        F.count_if(F.col("piece_no") == 1).alias("cut_documents"),
    )
