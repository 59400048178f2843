"""Queries of forms, figures, grounding, greedy selection, caches and the rest of the bookkeeping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import forms, questions
from paperloom.functions import words as W
from paperloom.operators import answers as A
from paperloom.operators import jurisdiction, retrieval, vectors
from paperloom.operators import registry_ops as R
from paperloom.plans.answer_queries import _ANSWERS, _CHUNKS, _answers, _chunks
from paperloom.plans.registry import query
from paperloom.plans.text_queries import PAGES, _pages
from paperloom.session import read_table

_FIGURE = r"(\$[\d,]+(?:\.\d{2})?|\d+(?:\.\d+)? ?(?:%|percent))"
_VALUES = "select 'n' || c_custkey as key, c_name as v from customer union all select 'b' || c_custkey, cast(c_acctbal as varchar) from customer union all select 'f' || doc_id || ':' || party_no, party from (select doc_id, generate_subscripts(parties, 1) as party_no, unnest(parties) as party from (select doc_id, max_by(fact_sheet.parties, loaded_at) as parties from files group by doc_id)) union all select 'd' || doc_id, file_name from files"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "files")
    sheet = f.groupBy("doc_id").agg(F.max_by("fact_sheet.parties", "loaded_at").alias("parties")).select("doc_id", F.posexplode("parties").alias("n", "v"))
    key = lambda prefix, *cols: F.concat(F.lit(prefix), *[x.cast("string") for x in cols]).alias("key")
    return (
        c.select(key("n", F.col("c_custkey")), F.col("c_name").alias("v"))
        .unionByName(c.select(key("b", F.col("c_custkey")), F.col("c_acctbal").cast("string").alias("v")))
        .unionByName(sheet.select(key("f", F.col("doc_id"), F.lit(":"), F.col("n") + 1), "v"))
        .unionByName(f.select(key("d", F.col("doc_id")), F.col("file_name").alias("v")))
    )


@query(f"""
with x as ({_VALUES}), y as (select key, trim(v) as v, strlen(trim(v)) as size, replace(trim(v), '-', '') as bare, list_filter(regexp_split_to_array(trim(v), '\\s+'), lambda w: w <> '') as w from x where key not like 'b%')
select key, case when size <= 4 and regexp_matches(v, '^[0-9]*$') then 'ID Number' when size = 11 and length(v) - length(bare) = 2 and regexp_matches(bare, '^[0-9]*$') then 'Social Security Number' when size in (5, 10) and regexp_matches(v, '^[0-9]') and regexp_matches(bare, '^[0-9]*$') then 'ZIP Code'
 when regexp_matches(v, '^[A-Z]{{2}}$') then 'State' when length(v) - length(replace(v, ',', '')) = 1 and strlen(trim(split_part(v, ',', 2))) between 2 and 12 then 'City, State, ZIP' when regexp_matches(v, '^[0-9]') and contains(v, ' ') and size > 5 then 'Address'
 when len(w) between 2 and 3 and len(list_filter(w, lambda a: not regexp_matches(a, '^\\p{{Lu}}') or strlen(a) > 15)) = 0 then 'Name' when len(w) between 2 and 5 and len(list_filter(w, lambda a: not regexp_matches(a, '^\\p{{Lu}}'))) = 0 then 'Business/Entity Name' else 'Form Field' end as label from y""")
def form_field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where("key not like 'b%'").select("key", forms.inferred_label(F.col("v")).alias("label"))


@query(f"""
with f as (select doc_id, max_by(fact_sheet.parties, loaded_at) as parties from files group by doc_id), k as (select doc_id, list_filter(parties, lambda v: strlen(trim(v)) >= 2) as p from f), a as (select doc_id, page_number, text from {PAGES} where page_number = 1)
select doc_id, page_number, case when len(p) > 0 then 'FILLED FORM DATA:' || chr(10) || array_to_string(list_transform(p, lambda v: 'Party: ' || trim(v)), chr(10)) || chr(10) || chr(10) || text else text end as text from a join k using (doc_id)""")
def form_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages with the parties of the fact sheet in a block before them."""
    f = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("fact_sheet.parties", "loaded_at").alias("parties"))
    fields = F.transform("parties", lambda v: F.struct(F.lit("Party").alias("label"), v.alias("value")))
    return _pages(spark, sf_dir).where("page_number = 1").join(f, "doc_id").select("doc_id", "page_number", F.coalesce(forms.summary_block(fields, F.col("text")), F.col("text")).alias("text"))


@query(rf"""
with m as (select doc_id, page_number, text, unnest(regexp_extract_all(text, '[^\n.;]{{0,40}}{_FIGURE}')) as x, generate_subscripts(regexp_extract_all(text, '[^\n.;]{{0,40}}{_FIGURE}'), 1) as i from {PAGES}),
v as (select doc_id, page_number, text, i, regexp_extract(x, '{_FIGURE}$', 1) as figure, trim(regexp_extract(x, '^(.*?){_FIGURE}$', 1)) as label from m), d as (select *, row_number() over (partition by doc_id, page_number, text, figure order by i) as r from v), k as (select *, row_number() over (partition by doc_id, page_number, text order by i) as n from d where r = 1)
select doc_id, page_number, n, figure, label from k where n <= 8""", wide=("n",))
def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight different amounts and percentages of a page, each with the words before it."""
    p = _pages(spark, sf_dir).withColumn("page", F.monotonically_increasing_id())
    m = p.select("doc_id", "page_number", "page", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\n.;]{0,40}" + _FIGURE), F.lit(0))).alias("i", "x"))
    v = m.select("doc_id", "page_number", "page", "i", F.regexp_extract("x", _FIGURE + "$", 1).alias("figure"), F.trim(F.regexp_extract("x", "^(.*?)" + _FIGURE + "$", 1)).alias("label"))
    d = v.withColumn("r", F.row_number().over(Window.partitionBy("page", "figure").orderBy("i"))).where("r = 1")
    return d.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("i"))).where("n <= 8").select("doc_id", "page_number", "n", "figure", "label")


_STATUTE = r"\d+\s+(?:U\.?S\.?C\.?|C\.?F\.?R\.?)\s*§\s*\d+"


@query(rf"""with {_ANSWERS}, k as (select doc_id, x, count(distinct h) as n, min(h) as h from (select doc_id, md5(text) as h, lower(replace(unnest(regexp_extract_all(text, '{_STATUTE}')), ' ', '')) as x from c) group by doc_id, x),
b as (select answer_id, doc_id, md5(source) as own, unnest(regexp_extract_all(answer, '{_STATUTE}')) as x from a)
select distinct answer_id, b.x as statute from b left join k on k.doc_id = b.doc_id and k.x = lower(replace(b.x, ' ', '')) where k.n is null or (k.n = 1 and k.h = own)""")
def fabricated_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes in answers that no other chunk of their file has; the answer's own chunk is no source."""
    squeezed = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    found = lambda c: F.explode(F.regexp_extract_all(c, F.lit(_STATUTE), F.lit(0)))
    held = _chunks(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"), found("text").alias("x")).select("doc_id", "h", squeezed(F.col("x")).alias("k")).distinct()
    held = held.groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    b = _answers(spark, sf_dir).select("answer_id", "doc_id", F.md5(F.encode("source", "UTF-8")).alias("own"), found("answer").alias("statute")).withColumn("k", squeezed(F.col("statute")))
    made_up = F.col("n").isNull() | ((F.col("n") == 1) & (F.col("h") == F.col("own")))
    return b.join(held, ["doc_id", "k"], "left").where(made_up).select("answer_id", "statute").distinct()


@query(rf"""with {_ANSWERS}, k as (select doc_id, t, count(distinct h) as n, min(h) as h from (select doc_id, md5(text) as h, unnest(regexp_extract_all(text, '{A.TOKEN}')) as t from c) group by doc_id, t),
b as (select distinct answer_id, doc_id, own, claim from (select answer_id, doc_id, md5(source) as own, unnest(list_filter(list_transform(regexp_extract_all(answer, '{A.CLAIM}', 1), lambda x: trim(regexp_replace(x, '{A.NOTE}', '', 'g'))), lambda x: strlen(x) >= 15)) as claim from a)),
w as (select answer_id, doc_id, own, claim, unnest(regexp_extract_all(claim, '{A.TOKEN}')) as t from b)
select answer_id, claim, round(avg(case when k.n > 1 or k.h <> own then 1.0 else 0.0 end), 6) as share, avg(case when k.n > 1 or k.h <> own then 1.0 else 0.0 end) >= 0.6 as grounded from w left join k using (doc_id, t) group by answer_id, claim""")
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each claim's names and numbers that stand in another chunk of the file."""
    tokens = lambda c: F.explode(F.regexp_extract_all(c, F.lit(A.TOKEN), F.lit(0)))
    held = _chunks(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"), tokens("text").alias("t")).distinct().groupBy("doc_id", "t").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    b = _answers(spark, sf_dir).select("answer_id", "doc_id", F.md5(F.encode("source", "UTF-8")).alias("own"), F.explode(A.claims(F.col("answer"))).alias("claim")).distinct()
    w = b.select("answer_id", "doc_id", "own", "claim", tokens("claim").alias("t")).join(held, ["doc_id", "t"], "left")
    share = F.avg(F.when((F.col("n") > 1) | (F.col("h") != F.col("own")), 1.0).otherwise(0.0))
    return w.groupBy("answer_id", "claim").agg(F.round(share, 6).alias("share"), (share >= 0.6).alias("grounded"))


@query(f"""with recursive {_CHUNKS}, r as (select *, row_number() over (partition by doc_id order by length(text) desc, chunk_index, page_number, text) as rank from c), s as (select doc_id, chunk_index, page_number, rank, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as w from r), most as (select max(rank) as n from s),
p as (select a.doc_id, a.rank as early, b.rank as late from s a join s b on a.doc_id = b.doc_id and a.rank < b.rank where len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.7),
k(doc_id, pos, kept) as (select distinct doc_id, 0, [cast(0 as bigint)] from s union all select k.doc_id, pos + 1, case when exists (select 1 from s where s.doc_id = k.doc_id and s.rank = pos + 1) and not exists (select 1 from p where p.doc_id = k.doc_id and p.late = pos + 1 and list_contains(kept, p.early)) then list_append(kept, pos + 1) else kept end from k where pos < (select n from most))
select s.doc_id, chunk_index, page_number, s.rank from s join k on k.doc_id = s.doc_id and pos = (select n from most) and list_contains(kept, s.rank)""", wide=("rank",))
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a file, longest first, without those that share over 0.7 of their words with one kept before."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "chunk_index", "page_number", "text"))
    ranked = _chunks(spark, sf_dir).select("doc_id", "chunk_index", "page_number", "text", rank.alias("rank"))
    return retrieval.distinct_texts(ranked, "doc_id", 0.70).select("doc_id", "chunk_index", "page_number", "rank")


@query("""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
m as (select label, list(s order by i) as v from (select label, i, sum(x) as s from (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e) group by label, i) group by label),
s as (select e.label, vec_id, e.v, round(list_cosine_similarity(e.v, m.v), 6) as score from e join m using (label)),
p1 as (select label, vec_id, v from (select *, row_number() over (partition by label order by score desc, vec_id) as r from s) where r = 1),
t1 as (select s.label, s.vec_id, s.v, score, greatest(0, round(list_cosine_similarity(s.v, p1.v), 6)) as near from s join p1 on s.label = p1.label and s.vec_id <> p1.vec_id),
p2 as (select label, vec_id, v from (select *, row_number() over (partition by label order by round(0.7 * score - 0.3 * near, 9) desc, vec_id) as r from t1) where r = 1),
t2 as (select t1.label, t1.vec_id, t1.v, score, greatest(near, round(list_cosine_similarity(t1.v, p2.v), 6)) as near from t1 join p2 on t1.label = p2.label and t1.vec_id <> p2.vec_id),
p3 as (select label, vec_id, v from (select *, row_number() over (partition by label order by round(0.7 * score - 0.3 * near, 9) desc, vec_id) as r from t2) where r = 1)
select label, vec_id, 1 as place from p1 union all select label, vec_id, 2 from p2 union all select label, vec_id, 3 from p3""")
def mmr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors of each label, near its mean and unlike each other, out of all of them."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    sums = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    mean = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("m"))
    scored = e.join(mean, "label").select("label", "vec_id", "embedding", F.round(vectors.cosine(F.col("embedding"), F.col("m")), 6).alias("score"))
    return retrieval.mmr_rounds(scored, "label", "vec_id", "score", "embedding", 3, 0.7)


@query()
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms for a lexical ranking of every sentence of every document, taken as a question."""
    from collections.abc import Iterator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, s, n, t) for d, s, q in zip(batch["doc_id"], batch["s"], batch["q"]) for n, t in enumerate(questions.ranking_terms(q or ""), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "n", "term"])

    every = F.posexplode(F.split("text", r"[.?!]\s+"))
    return read_table(spark, sf_dir, "documents").select("doc_id", every.alias("s", "q")).mapInPandas(run, "doc_id bigint, sentence int, n int, term string")


@query("""with k as (select cache_key, count(*) as copies, min(vec_id) as first_id, min_by(vector, vec_id) as v from embed_cache group by cache_key) select cache_key, copies, first_id, coalesce(len(v), 0) as size from k""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each key of the vector cache: the first that was written."""
    k = read_table(spark, sf_dir, "embed_cache").groupBy("cache_key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.min_by(F.coalesce(F.size("vector"), F.lit(0)), "vec_id").alias("n"))
    return k.select("cache_key", "copies", "first_id", F.greatest(F.lit(0), F.col("n")).cast("bigint").alias("size"))


@query("""with f as (select doc_id, max_by(case_id, loaded_at) as case_id, max_by(jurisdiction, loaded_at) as j from files group by doc_id), g as (select case_id, count(distinct j.level || '|' || coalesce(j.state, '')) as n, min(j.level || '|' || coalesce(j.state, '')) as v from f where j.level is not null and case_id is not null group by case_id)
select case_id, coalesce(c.jurisdiction.level || '|' || coalesce(c.jurisdiction.state, ''), case when n = 1 then v end, 'federal|') as resolved from cases c left join g using (case_id)""")
def jurisdiction_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case's own jurisdiction, else what all its files agree on, else the setting (federal)."""
    f = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("case_id", "loaded_at").alias("case_id"), F.max_by("jurisdiction", "loaded_at").alias("j"))
    spelled = lambda c: F.concat(F.col(f"{c}.level"), F.lit("|"), F.coalesce(F.col(f"{c}.state"), F.lit("")))
    g = f.where("j.level is not null and case_id is not null").groupBy("case_id").agg(F.collect_set(spelled("j")).alias("found"))
    cases = read_table(spark, sf_dir, "cases").join(g, "case_id", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return cases.select("case_id", jurisdiction.resolve(spelled("jurisdiction"), found, F.lit("federal|")).alias("resolved"))


@query("select coalesce(role, 'ClientDocument') as role, count(*) as files, count(distinct doc_id) as documents, cast(sum(word_count) as bigint) as words from files group by 1")
def files_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "files")
    return f.groupBy(F.coalesce("role", F.lit("ClientDocument")).alias("role")).agg(F.count("*").alias("files"), F.count_distinct("doc_id").alias("documents"), F.sum("word_count").alias("words"))


@query("with w as (select distinct lower(word) as word from (select unnest(regexp_split_to_array(name, '[^A-Za-z]+')) as word from cases) where strlen(word) > 3) select word, count(*) as cases, min(case_id) as first_case from w join cases on contains(lower(name), word) group by word")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word that a case's name has, the cases a search for it gives; the search is for a part of the name."""
    cases = read_table(spark, sf_dir, "cases").select("case_id", "name")
    words = cases.select(F.explode(F.split(F.lower("name"), "[^a-z]+")).alias("word")).where(F.octet_length("word") > 3).distinct()
    # cases are a table of fixed size
    met = R.search_names(cases, words)
    return met.groupBy("word").agg(F.count("*").alias("cases"), F.min("case_id").alias("first_case"))


@query("select * from (values " + ", ".join(f"('{m}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, cast({v[4]} as double), cast({v[5]} as double), cast({v[6]} as double), cast({v[7]} as double))" for m, v in W.MODES.items()) + ") t(mode, top_k, pool, chars_with, chars_without, mmr_lambda, cosine_floor, jaccard, gap)")
def mode_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m, *v[:8]) for m, v in W.MODES.items()]
    return spark.createDataFrame(rows, "mode string, top_k int, pool int, chars_with int, chars_without int, mmr_lambda double, cosine_floor double, jaccard double, gap double")


@query("""with f as (select doc_id, min(file_name) as file_name, max_by(case_id, loaded_at) as case_id, max_by(fact_sheet, loaded_at) as s from files group by doc_id),
l as (select case_id, file_name, 'Parties (' || file_name || '): ' || array_to_string(s.parties, ', ') as line, 1 as k from f where len(s.parties) > 0 union all select case_id, file_name, 'Amounts (' || file_name || '): ' || array_to_string(s.amounts, ', '), 2 from f where len(s.amounts) > 0 union all select case_id, file_name, 'Key dates (' || file_name || '): ' || array_to_string(s.dates, ', '), 3 from f where len(s.dates) > 0)
select case_id, left(string_agg(line, chr(10) order by file_name, k), 800) as facts from l where case_id is not null group by case_id""")
def case_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a case's files for its context, at most 800 characters."""
    f = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.min("file_name").alias("file_name"), F.max_by("case_id", "loaded_at").alias("case_id"), F.max_by("fact_sheet", "loaded_at").alias("s")).where("case_id is not null")
    part = lambda name, c, k: F.struct("file_name", F.lit(k).alias("k"), F.when(F.size(F.col(f"s.{c}")) > 0, F.concat(F.lit(f"{name} ("), "file_name", F.lit("): "), F.array_join(F.col(f"s.{c}"), ", "))).alias("line"))
    lines = f.select("case_id", F.explode(F.array(part("Parties", "parties", 1), part("Amounts", "amounts", 2), part("Key dates", "dates", 3))).alias("p")).where("p.line is not null")
    return lines.groupBy("case_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "\n"), 1, 800).alias("facts"))


@query("""with c as (select distinct file_name, chunk_index, page_number, text from chunks), f as (select file_name, count(*) filter (where contains(text, 'Row 2 |')) as tables from c group by file_name)
select c.file_name, chunk_index, page_number from (select *, row_number() over (partition by file_name order by chunk_index, page_number, text) as r from c where contains(text, 'Row 2 |')) c join f using (file_name) where r <= 2""")
def form_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two table chunks of a file, to be put among its results."""
    c = read_table(spark, sf_dir, "chunks").select("file_name", "chunk_index", "page_number", "text").distinct().where(F.col("text").contains("Row 2 |"))
    rank = F.row_number().over(Window.partitionBy("file_name").orderBy("chunk_index", "page_number", "text"))
    return c.withColumn("r", rank).where("r <= 2").select("file_name", "chunk_index", "page_number")
