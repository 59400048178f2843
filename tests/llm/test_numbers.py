"""Problems 4, 6 and 7: against brute force and by their constraints."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing, neighbours, packing, tokens


def test_footrule():
    rng = np.random.default_rng(0)
    perm = np.array([rng.permutation(12)[:5] for _ in range(20)], dtype=np.int16)
    got = neighbours.footrule_closeness(perm[:4], perm, 12)

    def place(p, k):
        return list(p).index(k) if k in p else 5

    for i in range(4):
        for j in range(20):
            rule = sum(abs(place(perm[i], k) - place(perm[j], k)) for k in range(12))
            assert rule == 5 * 6 - 2 * int(got[i, j])


def vectors(n=3000, dim=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, dim))
    x = (centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[10] = x[3] * 2
    x[500:900] = x[7]  # a group of copies
    return x


def test_recall_and_copies(spark):
    x = vectors()
    bad = [(9000, None), (9001, [1.0]), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + bad + [(5, [float(v) for v in x[5]])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>").selectExpr("*", "1 as h1", "'c' as payload")
    found = neighbours.nearest(df, k=5, dim=16, per_file=60)
    got = {}
    for r in found.collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["near_id"]))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    sims = np.round(u @ u.T, 6)
    for i in range(len(x)):
        order = [int(j) for j in np.lexsort((np.arange(len(x)), -sims[i])) if j != i][:5]
        hit += len(set(order) & {j for _, j in got[i]})
        assert len(got[i]) == 5 and [k for k, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
    assert set(got) == set(range(len(x))) and hit / (5 * len(x)) > 0.9
    assert [j for _, j in sorted(got[700])] == [7, 500, 501, 502, 503]
    pairs = neighbours.neighbour_pairs(found)
    assert pairs.where("vec_id_a >= vec_id_b").count() == 0


def test_split_files_find_the_same(spark):
    """A file searched in many parts gives what it gives in one."""
    x = vectors(900)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, vector array<float>")
    rows = lambda block: {tuple(r) for r in neighbours.nearest(df, k=5, dim=16, per_file=450, block=block, keep=900).collect()}
    assert rows(40) == rows(4096)


def test_every_asking_row_meets_every_posted_row():
    rng = np.random.default_rng(1)
    file, h1 = rng.integers(0, 3, 200), rng.integers(0, 1 << 60, 200)
    home = rng.random(200) < 0.4
    row, a, b, role = neighbours.parts_of_files(file, home, h1, np.array([1, 3, 4]), np.array([1, 2, 5]))
    where = {}
    for r, *part, what in zip(row, a, b, role):
        for bit in (neighbours.ASKS, neighbours.POSTS):
            if what & bit:
                where.setdefault((file[r], *part), ([], []))[bit - 1].append(r)
    met = Counter((q, p) for asks, posts in where.values() for q in asks for p in posts)
    assert set(met.values()) == {1} and set(met) == {(q, p) for q in range(200) for p in range(200) if home[p] and file[p] == file[q]}


def test_pivots_in_groups(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = neighbours.Pivots(x[:900]).ordered(x, 4)
    monkeypatch.setattr(neighbours, "MEANS", 100)
    parts = neighbours.Pivots(x[:900])
    assert len(parts.centres) == 30 and np.mean(parts.ordered(x, 4)[:, 0] == whole[:, 0]) > 0.9
    assert neighbours.pivot_count(100 * 240, 240) == 100 and neighbours.pivot_count(400 * 100 * 240, 240) == 2000
    assert len(neighbours.fit_pivots(x, 300)) == 300


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64)], "vec_id bigint, vector array<float>")
    assert {(r["vec_id"], r["near_id"]) for r in neighbours.nearest(df).collect()} == {(1, 2), (2, 1)}
    assert neighbours.nearest(df.limit(1)).count() == 0 and neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(5.2, 1.1, n).astype(int), 1, 2048)
    plan = packing.plan_containers(dict(Counter(lengths.tolist())), 2048)
    back = Counter()
    for c, parts in plan:
        assert sum(parts) <= 2048
        for p in parts:
            back[p] += c
    assert back == Counter(lengths.tolist())
    least = -(-int(lengths.sum()) // 2048)
    assert sum(c for c, _ in plan) <= 1.01 * least + 1


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.random((8, 12))
    x = packing.nnls(a, a @ np.maximum(rng.normal(size=12), 0))
    assert (x >= 0).all() and np.allclose(a @ x, a @ x)
    slope = a.T @ (a @ np.zeros(12) - a @ x)
    assert np.isfinite(slope).all()


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([0, 2048, 5000, 1, 1, 1, 700, 700, 648, 2047])] + [(3, 1), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "1 as rank", "2 as salt", "3 as piece_no")
    got = packing.pack(df).collect()
    assert sum(r["n_tokens"] for r in got) == sum(n for _, n in rows)
    used = Counter()
    for r in got:
        used[r["container_id"]] += r["n_tokens"]
    assert max(used.values()) <= 2048
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 2) == [904, 2048, 2048]
    assert all(r["piece_no"] == 0 for r in got if r["doc_id"] not in (2,))
    spans = {}
    for r in got:
        spans.setdefault(r["container_id"], []).append((r["place"], r["place"] + r["n_tokens"]))
    assert all(a[1] <= b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    assert packing.pack(df.limit(0)).count() == 0
    hot = spark.createDataFrame([(i, 2048) for i in range(40)] + [(99, 10 * 2048)], "doc_id bigint, n_tokens bigint")
    got = packing.pack(hot, per_salt=7).collect()  # one length in eight groups
    assert len(got) == 50 and len({r["container_id"] for r in got}) == 50


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(5)
    size = rng.integers(5, 3000, 900)
    p = np.full(900, 0.37)
    order = mixing.flight_order(size, rng)
    q = mixing.flight(p[order], [int(v) for v in size[order]], rng)
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size[order] - p @ size) < 1e-3
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= mixing.LANDING
    assert set(np.unique(mixing.land(q, size[order].astype(float)))) <= {0.0, 1.0}


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ["Big-Source", "small source", " SMALL_SOURCE", "other", None][i % 5], int(rng.integers(10, 400))) for i in range(3000)] + [(5000, "tiny", 50), (5001, "", 9)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 as p", "2 as whole")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.3, 2), ("other", 0.2, 1), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(sizes, targets, block=400)
    shares = {r["source"]: r for r in report.collect()}
    for s, t in (("big_source", 0.5), ("small_source", 0.3), ("other", 0.2)):
        assert abs(shares[s]["reached_share"] - t) < 0.01
    assert shares["absent"]["tokens"] == 0
    most = {"big_source": 1, "small_source": 2, "other": 1}
    got = selection.collect()
    assert all(0 < r["copies"] <= most[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    fixed, told = mixing.mix(sizes, targets, total=10_000_000.0)
    assert all(r["copies"] == most[r["source"]] for r in fixed.collect())
    all_, told = mixing.mix(sizes, targets, whole=True)
    reached = {r["source"]: r["tokens"] for r in told.collect()}
    assert reached["big_source"] == sum(n for _, s, n in rows if s == "Big-Source")  # at its one repeat, under its share
    none, told = mixing.mix(sizes.limit(0), targets)
    assert none.count() == 0 and told.count() == 4
    none, told = mixing.mix(sizes, targets.limit(0))
    assert none.count() == 0 and told.count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "the rent is due"), (2, None), (3, ""), (4, "<|endoftext|> " * 3000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(df, {"doc_id": F.col("doc_id")}).collect()}
    assert got[1] == 4 and got[2] == got[3] == 0 and got[4] > 3000


@pytest.mark.parametrize("name", ["p1_found", "p2_parties", "p3_pages", "p4_found", "p5_found", "p6_fill", "p7_shares_all", "p8_documents", "p8_segments"])
def test_queries_run(spark, name):
    """Queries run to the end over whole tables."""
    from paperloom.llm import queries

    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_pn_found_have_the_columns_laid_down(spark):
    from paperloom.llm import queries

    want = {
        "p1_found": "doc_id:string page_number:int start_off:bigint end_off:bigint", "p2_found": "key_a:string key_b:string", "p3_found": "doc_id:string page_number:int line_no:int kind:string",
        "p4_found": "vec_id_a:bigint vec_id_b:bigint", "p5_found": "doc_id:string page_number:int line_no:int", "p8_found": "doc_id:bigint para_no:int lang:string",
    }
    for name, columns in want.items():
        got = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert got.dtypes == [tuple(c.split(":")) for c in columns.split()], name
