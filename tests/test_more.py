"""Plans for groups of any size against their plain versions, and stores, limits and sessions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.functions import cleanup
from paperloom.functions import text as T
from paperloom.operators import answers as A
from paperloom.operators import bm25, extract, retrieval, vectors
from paperloom.operators import registry_ops as R
from paperloom.sources import cases, formats, samples, sinks
from paperloom.streaming import ingest


def test_distinct_texts_are_those_of_the_greedy_pass(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    rows = []
    for g in range(6):
        texts = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(40)]
        texts += [texts[3], texts[3] + " extra", "", "  ", ""]
        rng.shuffle(texts)
        rows += [(g, n, t) for n, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "g int, rank int, text string")
    got = {(r["g"], r["rank"]) for r in retrieval.distinct_texts(df, "g", 0.6).collect()}
    want = set()
    for g in range(6):
        own = sorted((n, t) for h, n, t in rows if h == g)
        want |= {(g, own[k][0]) for k in retrieval.drop_near_duplicates([t for _, t in own], 0.6)}
    assert got == want
    assert retrieval.distinct_texts(df.limit(0), "g", 0.6).count() == 0


def test_mmr_rounds_choose_as_mmr_does(spark):
    rng = np.random.default_rng(4)
    x, s = rng.normal(size=(90, 6)).round(3), rng.random(90).round(6)
    df = spark.createDataFrame([(int(i % 3), int(i), float(s[i]), [float(v) for v in x[i]]) for i in range(90)], "g int, id bigint, s double, v array<double>")
    got = {}
    for r in retrieval.mmr_rounds(df, "g", "id", "s", "v", 4, 0.6).collect():
        got[r["g"], r["place"]] = r["id"]
    for g in range(3):
        own = [i for i in range(90) if i % 3 == g]
        u = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
        want = retrieval.mmr([s[i] for i in own], u, 4, 0.6)
        assert [got[g, k] for k in range(1, 5)] == [own[i] for i in want]


def test_query_blocks_give_the_same(spark):
    """Many queries are joined in blocks; the result is that of one broadcast."""
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], [float(v) for v in rng.normal(size=8)]) for i in range(70)] + [(90, "a", None), (91, None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, g string, vector array<double>")
    few = df.where("vec_id % 3 = 0")
    for f in (lambda b: vectors.search(df, few, 5, dim=8, block=b), lambda b: vectors.similarities(df, few, dim=8, block=b)):
        assert {tuple(r) for r in f(6).collect()} == {tuple(r) for r in f(1000).collect()}
    best = lambda b: {tuple(r) for r in vectors.best_of_groups(df.where("g is not null"), few, "g", dim=8, block=b).collect()}
    assert best(6) == best(1000)


def test_saved_index_and_one_tokenisation(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rent rent due"), (2, "deposit due"), (3, None), (4, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(9, "rent", 1), (9, "due", 1), (9, "absent", 1)], "query_id bigint, term string, mult int")
    bm25.save_index(docs, str(tmp_path / "index"), buckets=4)
    fresh, saved = bm25.score(docs, asked), bm25.score(docs, asked, post=bm25.load_index(spark, str(tmp_path / "index"), asked))
    assert {tuple(r) for r in fresh.collect()} == {tuple(r) for r in saved.collect()} and fresh.count() == 2
    post = {(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in bm25.matched_postings(docs, asked).collect()}
    assert post == {(1, "rent"): (2, 3), (1, "due"): (1, 3), (2, "due"): (1, 2), **{(k, ""): (1, n) for k, n in ((1, 3), (2, 2), (3, 0), (4, 0))}}


def test_both_lists_rank_every_row(spark):
    rows = [(1, "rent due", [1.0] + [0.0] * 63), (2, "rent", None), (3, None, [0.0, 1.0] + [0.0] * 62)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "rent", 1, [1.0] + [0.0] * 63), (1, "due", 1, [1.0] + [0.0] * 63)], "query_id bigint, term string, mult int, vector array<double>")
    got = {r["doc_id"]: (r["b"], r["c"]) for r in retrieval.both_lists(corpus, asked).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3)}
    merged = retrieval.merge_variants(corpus, spark.createDataFrame([(1, 0, "rent", 1), (1, 1, "due", 1)], "query_id bigint, variant int, term string, mult int"))
    assert {r["doc_id"]: r["score"] for r in merged.collect()} == {1: round(1 / 62 + 1 / 61, 9), 2: round(1 / 61, 9)}  # the shorter text is first for rent
    route = lambda v: spark.range(1).select(retrieval.route(F.lit(v).cast("double"), {"quick": 0.2, "balanced": 0.15, "extended": 0.12})).first()[0]
    assert [route(v) for v in (0.3, 0.16, 0.13, 0.1, None)] == ["quick", "balanced", "extended", "not_found", "not_found"]


def test_made_up_names_and_strong_claims(spark):
    sources = spark.createDataFrame([("d", "The Superior Court of Orvan heard plaintiff Anna Doe in Case No. 7."), ("d", "The agreement is not binding before June.")], "doc_id string, text string")
    answers = spark.createDataFrame([("a", "d", "Superior Court of Orvan; District Court of Marlowe; County of Orvan; Case No. 8; plaintiff Anna Doe; defendant Carl Coe.", "x"), ("b", "d", "This agreement is irrevocable and purple elephants may never dance.", "x"), ("c", "e", "", "x")], "answer_id string, doc_id string, answer string, own string")
    got = {(r["kind"], r["name"]) for r in A.fabricated(answers, sources).collect()}
    assert got == {("court", "District Court of Marlowe"), ("county", "County of Orvan"), ("case number", "Case No. 8"), ("party", "Carl Coe")}
    held = sources.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"), F.md5(F.encode("text", "UTF-8")).alias("h")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    claims = A.strong_claims(answers, held).collect()
    assert [(r["answer_id"], r["kind"], r["supported"]) for r in claims] == [("b", "qualifier", False)]
    words = sources.select(F.lit("f.pdf").alias("cited_file"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).distinct()
    cited = spark.createDataFrame([("a", "The agreement is binding [f.pdf, p. 1]. Purple elephants dance [f.pdf, p. 2]. No file [g.pdf, p. 3].")], "answer_id string, answer string")
    assert {(r["n"], r["wrong"]) for r in A.attribution(cited, words).collect()} == {(1, False), (2, True)}


def test_fact_sheets(spark):
    text = "Lease between Anna Doe (the owner) and Carl Coe, dated 2024-05-03 and 2024-05-03.\nTenant: Carl Coe,\nSection 2. Payment of Rent\nTERM AND RENT\n$950 then $950 then $1,000.50"
    rows = spark.createDataFrame([("d", 1, text), ("e", 1, None), ("f", 1, "")], "doc_id string, page_number int, text string")
    got = {r["doc_id"]: r for r in extract.fact_sheets(rows).collect()}
    d = got["d"]
    assert d["parties"] == ["Anna Doe", "Tenant: Carl Coe"] and d["dates"] == ["2024-05-03"] and d["amounts"] == ["$950", "$1,000.50"] and d["key_clauses"] == ["Payment of Rent", "TERM AND RENT"]
    assert got["f"]["parties"] == [] and got["e"]["parties"] is None
    assert {r["name"] for r in extract.between_entities(rows).collect()} == {"Anna Doe", "Carl Coe"}


def test_limits_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n" + "\n".join(map(str, range(30))))
    (tmp_path / "b.csv").write_text("k\n1")
    got = {r["file_name"]: r for r in formats.load_files(spark, str(tmp_path), limits=formats.Limits(csv_rows=10)).collect()}
    assert got["a.csv"]["truncated"] and len(got["a.csv"]["text"].split("\n")) == 10 and not got["b.csv"]["truncated"]
    whole = {r["file_name"]: r for r in formats.load_files(spark, str(tmp_path)).collect()}
    assert not whole["a.csv"]["truncated"] and len(whole["a.csv"]["text"].split("\n")) == 30


def test_formats_round_trip(spark):
    rows = [("d", 1, "One line\nand <another> & more\n\n* a list mark"), ("d", 2, ""), ("d", 3, None), ("d", 4, "long " * 3000)]
    got = samples.round_trip(spark.createDataFrame(rows, "doc_id string, page_number int, text string")).collect()
    assert len(got) == 4 * len(samples.MAKERS) and all(r["whole"] for r in got)
    assert {r["pages"] for r in got if r["page_number"] in (2, 3)} <= {0, 1} and max(r["pages"] for r in got) > 1


def test_documents_are_replaced(spark, tmp_path):
    path = str(tmp_path / "store")
    put = lambda rows: sinks.replace_documents(spark.createDataFrame(rows, "doc_id string, text string"), path, buckets=3)
    put([(f"d{k}", "old") for k in range(20)])
    put([("d3", "new"), ("d3", "newer"), ("d99", "fresh")])
    got = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(path).select("doc_id", "text").collect())
    assert got == sorted([(f"d{k}", "old") for k in range(20) if k != 3] + [("d3", "new"), ("d3", "newer"), ("d99", "fresh")])


def test_changed_file_with_the_same_id(spark, tmp_path):
    store = str(tmp_path / "store")
    for n, text in enumerate(("old", "new")):
        batch = spark.createDataFrame([("d1", "/x", f"h{n}", 1, text)], "doc_id string, file_path string, content_hash string, page_number int, text string").withColumn("arrived_at", F.current_timestamp())
        ingest.merge_batch(store)(batch, n)
    assert [r["text"] for r in ingest.current(spark, store, "pages").collect()] == ["new"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ingest._read(spark, str(tmp_path / "broken"), "a int").count()
    assert ingest._read(spark, str(tmp_path / "absent"), "a int").count() == 0


def test_a_cluster_must_name_its_folder():
    class Master:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Master

        class getCheckpointDir:
            @staticmethod
            def isEmpty():
                return True

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Master

    with pytest.raises(ValueError):
        session.shared_folder(Session)


def test_answers_are_finished():
    rough = "The rent is 950 dollars.\nThe rent of the northern flat is due on the first.\nThe rent of the northern flat is due on the first.\nSee [a.pdf,\np. 1]. It rests on the"
    assert cleanup.finish(rough) == "The rent is 950 dollars.\nThe rent of the northern flat is due on the first.\nSee [a.pdf, p. 1]."
    assert cleanup.finish("The rent is 950 dollars. I hope this helps!") == "The rent is 950 dollars"
    cleaned = cleanup.clean_answer("The Marlowe Court decided it. The rent is due. See [lease, p. 2].", "", ["lease-2024.pdf"], ["Marlowe"])
    assert "Marlowe" not in cleaned and "[lease-2024.pdf, p. 2]" in cleaned


def test_sessions_and_paths(spark):
    s = spark.createDataFrame([(1, 7, "a"), (2, 7, ""), (3, 7, None), (4, 8, "b")], "session_id int, case_id int, summary string")
    shown = R.summaries(s, spark.createDataFrame([(7, None), (8, 4)], "case_id int, exclude int"))
    assert [r["session_id"] for r in shown.collect()] == [1] and R.without(s, "session_id", 2).count() == 3
    url = lambda u: spark.range(1).select(R.path_of_url(F.lit(u))).first()[0]
    assert url("/a%20b+c%25.pdf") == "/a b+c%.pdf" and url("/100%.pdf") == "/100%.pdf"


@pytest.mark.parametrize("text", ["", "plain", "größe über alles", "a\U0001f600b\U0001f600", "x\ufffdy\ufffd\ufffd", "é" * 40, None])
def test_prefixes_of_bytes_end_with_a_character(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    for most in range(0, 14):
        got = df.select(T.byte_prefix(F.col("text"), most)).first()[0]
        assert got == (None if text is None else text.encode()[:most].decode(errors="ignore"))


def test_cases_and_states(spark, tmp_path):
    (tmp_path / "eval.json").write_text('[{"pdf": "in/lease one.pdf", "query": "Who is the tenant of the northern flat?"}, {"pdf": "b.pdf", "query": "q", "expected": ["x"], "type": "adversarial", "top_k": 3}, {"pdf": null, "query": "q"}, {"pdf": "c.pdf", "query": "q", "type": "negative"}]')
    got = {r["pdf"]: r for r in cases.load_cases(spark, str(tmp_path / "eval.json")).collect()}
    assert len(got) == 3 and got["in/lease one.pdf"]["label"] == "lease one: Who is the tenant of the north" and got["in/lease one.pdf"]["top_k"] == 6
    assert [got[k]["negative"] for k in ("in/lease one.pdf", "b.pdf", "c.pdf")] == [False, False, True]
