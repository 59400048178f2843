"""Problem 4: the k most similar vectors of every vector, by a permutation index.

Every vector is represented by its ordered nearest pivots. It is posted in the inverted file of its
nearest pivot and looked up in the files of those of its pivots that are about as near. In each file the footrule
distance of the truncated permutations ranks the candidates, for the one that asks and for those
that are posted, and the best `keep` are reranked by the cosine in double precision.

Exact copies are one class: of each input batch one copy travels, with the k + 1 smallest ids it
stands for, and the result of a class is given to each of its members at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
SAMPLE_A_PIVOT = 16
MEANS = 4096  # so many pivots are means of the sample; the rest, which very large tables need, are rows of it


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite numbers that are not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def unit_rows(values: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Single precision forms as they are, and unit forms in double precision."""
    raw = np.array(values, dtype=np.float32).reshape(-1, dim)
    x = raw.astype(np.float64)
    return raw, x / np.sqrt((x * x).sum(axis=1))[:, None]


class Pivots:
    """Pivots in groups of near ones: the nearest pivots of a vector are looked for in its nearest groups.

    Up to MEANS pivots stand in one group, so the search is exact; beyond, the work for a vector grows with
    the root of their number.
    """

    def __init__(self, pivots: np.ndarray, reach: int = 12):
        self.pivots, self.reach = pivots, reach
        self.centres = fit_means(pivots, int(len(pivots) ** 0.5)) if len(pivots) > MEANS else pivots[:1]
        near = nearest_of(pivots, self.centres)
        self.members = [np.flatnonzero(near == g) for g in range(len(self.centres))]

    def ordered(self, x: np.ndarray, prefix: int) -> np.ndarray:
        """The `prefix` nearest pivots of each row, nearest first."""
        prefix = min(prefix, len(self.pivots))
        return np.concatenate([self._ordered(x[a : a + 1024], prefix) for a in range(0, len(x), 1024)] or [np.zeros((0, prefix), np.int32)])

    def _ordered(self, x: np.ndarray, prefix: int) -> np.ndarray:
        if len(self.centres) == 1:
            return best_columns(x @ self.pivots.T, prefix)
        groups = best_columns(x @ self.centres.T, min(self.reach, len(self.centres)))
        sim = np.full((len(x), prefix), -2, dtype=np.float32)
        who = np.zeros((len(x), prefix), dtype=np.int32)
        for g in np.unique(groups):
            rows = np.flatnonzero((groups == g).any(axis=1))
            mine = self.members[g]
            if len(mine):
                both = np.hstack([sim[rows], x[rows] @ self.pivots[mine].T])
                ids = np.hstack([who[rows], np.broadcast_to(mine.astype(np.int32), (len(rows), len(mine)))])
                top = best_columns(both, prefix)
                sim[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        return who


def closeness_to(x: np.ndarray, pivots: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """The cosine of each row to its ordered pivots."""
    return np.concatenate([np.einsum("ij,ikj->ik", x[a : a + 2048], pivots[perm[a : a + 2048]]) for a in range(0, len(x), 2048)] or [np.zeros(perm.shape, np.float32)])


def reach_of(sim: np.ndarray, probes: float) -> float:
    """How much farther than its nearest pivot others may be for a row to be looked up there, so that rows are
    looked up under `probes` pivots on average."""
    gaps = np.sort((sim[:, :1] - sim[:, 1:]).ravel())
    wanted = int(round((probes - 1) * len(sim)))
    return float(gaps[min(wanted, len(gaps)) - 1]) if wanted and len(gaps) else -1.0


def best_columns(sim: np.ndarray, many: int) -> np.ndarray:
    """Numbers of the `many` largest columns of each row, largest first."""
    top = np.argpartition(sim, sim.shape[1] - many, axis=1)[:, sim.shape[1] - many :]
    order = np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])


def fit_means(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Spherical means of a sample; a mean that loses all its rows stays where it was."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:count]]
    for _ in range(rounds):
        near = nearest_of(sample, pivots)
        order = np.argsort(near, kind="stable")
        cells, begin = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], begin, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        fine = norm[:, 0] > 1e-9
        pivots[cells[fine]] = total[fine] / norm[fine]
    return pivots


def pivot_count(rows: int, per_file: int) -> int:
    """One pivot for every `per_file` rows up to MEANS pivots; from there on their number grows with the root of the rows."""
    linear = max(rows // per_file, 1)
    return linear if linear <= MEANS else int(MEANS * (linear / MEANS) ** 0.5)


def sample_size(count: int) -> int:
    return min(count, MEANS) * SAMPLE_A_PIVOT + max(count - MEANS, 0) * 2


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots from unit rows: means of the first ones, and rows as they are for those beyond MEANS."""
    sample = sample.astype(np.float32)
    cut = MEANS * SAMPLE_A_PIVOT
    pivots = fit_means(sample[:cut], min(count, MEANS))
    return np.concatenate([pivots, np.unique(sample[cut:], axis=0)[: count - len(pivots)]]) if count > MEANS else pivots


def footrule_closeness(asking: np.ndarray, posted: np.ndarray, pivots: int) -> np.ndarray:
    """How small the footrule distance of truncated permutations is, for all pairs of two sets.

    With weight = prefix - position (0 where a pivot is missing) the distance is
    prefix * (prefix + 1) - 2 * sum of min(weight), and the sum of minima is returned.
    """
    prefix = posted.shape[1]
    used = np.unique(posted)
    local = np.full(pivots, len(used), dtype=np.int32)
    local[used] = np.arange(len(used))
    weight = np.zeros((len(used) + 1, len(posted)), dtype=np.uint8)  # the last row: pivots that none has
    for j in range(prefix):
        weight[local[posted[:, j]], np.arange(len(posted))] = prefix - j
    out = np.zeros((len(asking), len(posted)), dtype=np.uint8)
    for j in range(prefix):
        part = weight[local[asking[:, j]]]
        np.minimum(part, prefix - j, out=part)
        out += part
    return out


def best_of_rows(sim: np.ndarray, closeness: np.ndarray, keep: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the n largest cosines a row among its `keep` closest by footrule."""
    wide = sim.shape[1]
    if wide > keep:
        least = np.partition(closeness, wide - keep, axis=1)[:, wide - keep]
        sim = np.where(closeness < least[:, None], np.float32(-2), sim)
    n = min(n, wide)
    top = np.argpartition(sim, wide - n, axis=1)[:, wide - n :]
    rows = np.repeat(np.arange(len(sim)), n)
    return rows, top.ravel()


def search_file(x: np.ndarray, perm: np.ndarray, asks: np.ndarray, posts: np.ndarray, pivots: int, k: int, keep: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, cosine) of what the asking rows of one inverted file find among the posted ones and these among them."""
    x32 = x.astype(np.float32)
    asking, posted = np.flatnonzero(asks), np.flatnonzero(posts)
    left, right = [], []
    for a in range(0, len(asking), chunk):
        for b in range(0, len(posted), chunk):
            q, r = asking[a : a + chunk], posted[b : b + chunk]
            sim = x32[q] @ x32[r].T
            close = footrule_closeness(perm[q], perm[r], pivots)
            i, j = best_of_rows(sim, close, keep, k + 4)
            left.append(q[i])
            right.append(r[j])
            i, j = best_of_rows(np.ascontiguousarray(sim.T), np.ascontiguousarray(close.T), keep, k + 4)
            left.append(r[i])
            right.append(q[j])
    i, j = np.concatenate(left), np.concatenate(right)
    pair = np.unique(i.astype(np.int64) * len(x) + j)
    i, j = pair // len(x), pair % len(x)
    cosine = np.empty(len(i))
    for a in range(0, len(i), 65536):
        cosine[a : a + 65536] = np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]])
    return i, j, np.where(i == j, 1.0, np.round(cosine, 6))


def ranked_ids(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row i its k + 1 best (ids, cosines), ties by the smaller id; a row stands for all its ids."""
    length = np.fromiter((len(d) for d in ids), dtype=np.int64, count=len(ids))
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.concatenate(ids)
    many = length[j]
    at = np.repeat(begin[j] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    i, cosine, who = np.repeat(i, many), np.repeat(cosine, many), flat[at]
    order = np.lexsort((who, -cosine, i))
    i, cosine, who = i[order], cosine[order], who[order]
    cut = np.flatnonzero(np.diff(i, prepend=-1))
    for a, z in zip(cut, [*cut[1:], len(i)]):
        z = min(z, a + k + 1)
        yield int(i[a]), who[a:z], cosine[a:z]


ASKS, POSTS = 1, 2
ROUTED = "file int, a int, b int, role int, h1 bigint, h2 int, ids array<bigint>, payload binary"


def parts_of_files(file: np.ndarray, home: np.ndarray, h1: np.ndarray, asking: np.ndarray, posted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b, role) of where rows go: a file is searched in `asking[file]` times `posted[file]` parts.

    A row asks in all parts of its own asking block and, at home, is posted in all parts of its own posted block.
    """
    na, nb = asking[file], posted[file]
    own_a, own_b = h1 % na, (h1 >> 20) % nb
    one = (na == 1) & (nb == 1)
    rows, parts_a, parts_b, roles = [np.flatnonzero(one)], [own_a[one]], [own_b[one]], [np.where(home[one], ASKS | POSTS, ASKS)]
    for r in np.flatnonzero(~one):
        a = np.concatenate([np.full(nb[r], own_a[r]), np.arange(na[r])]) if home[r] else np.full(nb[r], own_a[r])
        b = np.concatenate([np.arange(nb[r]), np.full(na[r], own_b[r])]) if home[r] else np.arange(nb[r])
        role = np.repeat([ASKS, POSTS], [nb[r], len(a) - nb[r]])
        if home[r]:
            role[own_b[r]] = ASKS | POSTS  # the part where both meet gets the row once
            last = np.delete(np.arange(len(a)), nb[r] + own_a[r])
            a, b, role = a[last], b[last], role[last]
        rows.append(np.full(len(a), r))
        parts_a.append(a)
        parts_b.append(b)
        roles.append(role)
    return tuple(np.concatenate(p) for p in (rows, parts_a, parts_b, roles))


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, per_file: int = 240, probes: float = 3, keep: int = 64, block: int = 4096) -> DataFrame:
    """vec_id, near_id, rank, cosine: the k most similar other vectors of every usable vector.

    Unusable (null, wrong length, null or not finite element, all zero) vectors and null ids take no
    part. Ties of the cosine, rounded to 6 decimals, go to the smaller id; a row repeated with the
    same id and vector counts once. Pivots are fitted on a hash sample of the ids (`sample_size` rows, which
    grow with the root of the table beyond MEANS * per_file rows); every vector is indexed and looked up.
    A vector is posted under its nearest pivot and looked up under all of its first PREFIX that are not much
    farther than that, `probes` on average: more in dense regions, where many files are near.
    A file with more than `block` posted or asking rows, as the sample tells, is searched in parts.
    """
    spark = vectors.sparkSession
    keyed = vectors.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & usable(F.col("vector"), dim)).select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    rows = keyed.count()
    if not rows:
        return spark.createDataFrame([], "vec_id bigint, near_id bigint, rank int, cosine double")
    count = pivot_count(rows, per_file)
    wanted = sample_size(count)
    place = F.xxhash64("vec_id", F.lit(7))
    sample = keyed.select("vec_id", "vector", place.alias("place")).where(F.pmod(place, F.lit(1_000_000)) < min(1.0, wanted / rows) * 1_000_000)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"place": batch["place"], "v": [np.asarray(v, dtype=np.float32).tobytes() for v in batch["vector"]]})

    chosen = sample.mapInPandas(packed, "place bigint, v binary").toPandas().sort_values(["place", "v"], kind="stable")["v"].tolist()
    if not chosen:  # so few rows that the hash chose none: the first by the hash
        chosen = [np.asarray(r["vector"], dtype=np.float32).tobytes() for r in keyed.orderBy(place, "vec_id").limit(wanted).collect()]
    unit = np.frombuffer(b"".join(chosen), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    unit = (unit / np.sqrt((unit * unit).sum(axis=1))[:, None]).astype(np.float32)
    # the pivots lie nearer to the rows they are means of, so reach and sizes are measured on rows that were left out
    kept_out = len(unit) // 5
    pivots = Pivots(fit_pivots(unit[kept_out:], count))
    total = len(pivots.pivots)
    width = min(PREFIX, total)
    measured = unit[:kept_out] if kept_out > 100 else unit
    seen = pivots.ordered(measured, width)
    sim = closeness_to(measured, pivots.pivots, seen)
    reach = reach_of(sim, probes)
    looked = (sim >= sim[:, :1] - reach) & (np.arange(width) > 0) | (np.arange(width) == 0)
    scale = rows / len(measured) / block
    posted = np.maximum(1, np.ceil(np.bincount(seen[:, 0], minlength=total) * scale)).astype(np.int64)
    asking = np.maximum(1, np.ceil(np.bincount(seen[looked], minlength=total) * scale)).astype(np.int64)
    shared = spark.sparkContext.broadcast((pivots, asking, posted))
    number_type = np.uint16 if total <= 65_536 else np.int32

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pv, blocks_a, blocks_b = shared.value
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("vec_id", kind="stable")
            raw, x = unit_rows(batch["vector"].tolist(), dim)
            number = batch.groupby(["h1", "h2"], sort=False).ngroup().to_numpy()
            _, first = np.unique(number, return_index=True)
            ids: list[list[int]] = [[] for _ in first]
            for c, d in zip(number.tolist(), batch["vec_id"].tolist()):
                held = ids[c]
                if len(held) <= k and (not held or held[-1] != d):
                    held.append(d)
            perm = pv.ordered(x[first].astype(np.float32), PREFIX)
            payload = [p.tobytes() + v.tobytes() for p, v in zip(perm.astype(number_type), raw[first])]
            h1, h2 = batch["h1"].to_numpy()[first], batch["h2"].to_numpy()[first]
            sim = closeness_to(x[first].astype(np.float32), pv.pivots, perm)
            at, place = np.nonzero((sim >= sim[:, :1] - reach) | (np.arange(width) == 0))
            file = perm[at, place]
            row, a, b, role = parts_of_files(file, place == 0, h1[at] & 0x7FFFFFFFFFFFFFFF, blocks_a, blocks_b)
            c = at[row]
            yield pd.DataFrame({"file": file[row], "a": a, "b": b, "role": role, "h1": h1[c], "h2": h2[c], "ids": [ids[i] for i in c], "payload": [payload[i] for i in c]})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        number = group.groupby(["h1", "h2"], sort=False).ngroup().to_numpy()
        _, first = np.unique(number, return_index=True)
        if len(first) < len(group):
            together: list[set[int]] = [set() for _ in first]
            for c, d in zip(number.tolist(), group["ids"]):
                together[c].update(d.tolist())
            ids = [np.array(sorted(d)[: k + 1], dtype=np.int64) for d in together]
        else:
            ids = list(group["ids"])
        one = group.iloc[first]
        data = np.frombuffer(b"".join(one["payload"]), dtype=np.uint8).reshape(len(first), -1)
        wide = np.dtype(number_type).itemsize * width
        perm = np.ascontiguousarray(data[:, :wide]).view(number_type)
        x = np.ascontiguousarray(data[:, wide:]).view(np.float32).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        role = one["role"].to_numpy()
        asks, posts = (role & ASKS) > 0, (role & POSTS) > 0
        out = list(ranked_ids(*search_file(x, perm, asks, posts, total, k, keep), ids, k)) if asks.any() and posts.any() else []
        at = [r[0] for r in out]
        return pd.DataFrame({"h1": one["h1"].to_numpy()[at], "h2": one["h2"].to_numpy()[at], "near": [r[1] for r in out], "cosine": [r[2] for r in out]})

    # tasks of a fixed number of rows, whatever the session's setting is
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows * probes) // 24_000)
    routed = keyed.mapInPandas(route, ROUTED).repartition(tasks, "file", "a", "b")
    parts = routed.groupBy("file", "a", "b").applyInPandas(search, "h1 bigint, h2 int, near array<bigint>, cosine array<double>")
    lists = (
        parts.select("h1", "h2", F.expr("transform(arrays_zip(near, cosine), p -> struct(-p.cosine as s, p.near as d))").alias("p"))
        .groupBy("h1", "h2")
        .agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(p)))), 1, {k + 1})").alias("p"))
    )
    return (
        keyed.select("vec_id", "h1", "h2")
        .distinct()
        .join(lists, ["h1", "h2"])
        .select("vec_id", F.expr(f"slice(filter(p, q -> q.d <> vec_id), 1, {k})").alias("p"))
        .select("vec_id", F.posexplode("p").alias("rank", "q"))
        .select("vec_id", F.col("q.d").alias("near_id"), (F.col("rank") + 1).alias("rank"), (-F.col("q.s")).alias("cosine"))
    )


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """vec_id_a < vec_id_b of every pair of which one is among the most similar of the other."""
    return found.select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b")).distinct()
