"""Queries of context, answer checks, grading, evaluation and bookkeeping.

Answers are formed from the data: the text of a chunk with a citation of its file, of a page that may be
beyond its end, or, for every fifth chunk, of another file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import words as W
from paperloom.functions.text import keyword_set
from paperloom.operators import answers as A
from paperloom.operators import bm25
from paperloom.operators import context as C
from paperloom.operators import evaluation as E
from paperloom.operators import registry_ops as R
from paperloom.plans.registry import query
from paperloom.plans.text_queries import _HEADER_SQL, PAGES, _pages, _quote, sql_any
from paperloom.session import read_table

_CHUNKS = "c as (select distinct doc_id, chunk_index, file_name, page_number, text from chunks)"
_ANSWERS = f"""{_CHUNKS}, nf as (select file_name, lead(file_name) over (partition by substr(md5(file_name), 1, 1) order by file_name) as following from (select distinct file_name from c)),
a as (select doc_id || ':' || chunk_index || ':' || page_number || ':' || md5(text) as answer_id, doc_id, chunk_index, c.file_name, page_number, text as source, text || ' [' || case when chunk_index % 5 = 0 then coalesce(following, c.file_name) else c.file_name end || ', p. ' || (page_number + chunk_index % 3) || ']' as answer from c join nf using (file_name))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "file_name", "page_number", "text").distinct()


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    names = c.select("file_name").distinct()
    # another file: the one that follows by name among those of the same hash digit
    digit = F.substring(F.md5(F.encode("file_name", "UTF-8")), 1, 1)
    following = names.withColumn("following", F.lead("file_name").over(Window.partitionBy(digit).orderBy("file_name")))
    cited = F.when(F.col("chunk_index") % 5 == 0, F.coalesce("following", "file_name")).otherwise(F.col("file_name"))
    page = (F.col("page_number") + F.col("chunk_index") % 3).cast("string")
    answer_id = F.concat_ws(":", "doc_id", F.col("chunk_index").cast("string"), F.col("page_number").cast("string"), F.md5(F.encode("text", "UTF-8")))
    return c.join(following, "file_name").select(
        answer_id.alias("answer_id"), "doc_id", "chunk_index", "file_name", "page_number", F.col("text").alias("source"), F.concat(F.col("text"), F.lit(" ["), cited, F.lit(", p. "), page, F.lit("]")).alias("answer")
    )


@query(rf"""with {_ANSWERS}, b as (select answer_id, unnest(regexp_extract_all(answer, '{A.BRACKET}')) as x from a)
select answer_id, count(*) as brackets, count(*) filter (where regexp_matches(x, '{A.CITED}')) as valid, count(*) filter (where regexp_matches(x, '{A.CITED}') and trim(regexp_extract(x, '{A.CITED}', 1)) in (select file_name from files)) as known from b group by answer_id""")
def assert_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    files = read_table(spark, sf_dir, "files").select(F.col("file_name").alias("cited")).distinct().withColumn("known", F.lit(True))
    one = a.select("answer_id", F.explode(A.brackets(F.col("answer"))).alias("x")).withColumn("valid", F.col("x").rlike(A.CITED)).withColumn("cited", F.trim(F.regexp_extract("x", A.CITED, 1)))
    return one.join(files, "cited", "left").groupBy("answer_id").agg(F.count("*").alias("brackets"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.coalesce("known", F.lit(False))).alias("known"))


@query(rf"""with {_ANSWERS}, b as (select answer_id, unnest(regexp_extract_all(answer, '{A.CITED}')) as x from a), d as (select answer_id, trim(regexp_extract(x, '{A.CITED}', 1)) as cited_file, cast(regexp_extract(x, '{A.CITED}', 2) as bigint) as cited_page from b),
f as (select file_name, cast(max(total_pages) as bigint) as total_pages from files group by file_name) select answer_id, cited_file, cited_page, total_pages from d join f on cited_file = file_name where cited_page > total_pages""")
def assert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_violations(_answers(spark, sf_dir), read_table(spark, sf_dir, "files"))


@query(rf"""with {_ANSWERS} select answer_id, {" + ".join(f"case when contains(lower(answer), {_quote(p)}) then 1 else 0 end" for p in W.QUALIFIERS)} as blocked from a""")
def assert_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the strong legal qualifiers an answer has."""
    return _answers(spark, sf_dir).select("answer_id", A.count_of(F.lower("answer"), W.QUALIFIERS).alias("blocked"))


@query(rf"""
with {_ANSWERS}, f as (select doc_id, min(file_name) as file_name, max_by(fact_sheet.amounts, loaded_at) as amounts from files group by doc_id), e as (select doc_id, unnest(amounts) as amount from f)
select answer_id, amount, contains(answer, amount) as exact from a join (select distinct doc_id, amount from e) using (doc_id)""")
def assert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each amount of the file's fact sheet stands verbatim in the answer."""
    sheet = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("fact_sheet.amounts", "loaded_at").alias("amounts"))
    amounts = sheet.select("doc_id", F.explode("amounts").alias("amount")).distinct()
    return _answers(spark, sf_dir).join(amounts, "doc_id").select("answer_id", "amount", F.col("answer").contains(F.col("amount")).alias("exact"))


_OTHER_SUBJECT = ", while a zoologist of the northern aquarium measured seventeen penguins, walruses, narwhals and albatrosses"


@query(rf"""with {_ANSWERS}, o as (select answer_id, case when chunk_index % 3 = 0 then regexp_extract(answer, '^\W*\w+') || '{_OTHER_SUBJECT}' || regexp_extract(answer, ' \[[^\[\]]*\]$') else answer end as answer from a),
s as (select answer_id, unnest(x) as sentence, generate_subscripts(x, 1) as n from (select answer_id, string_split(regexp_replace(answer, ', p\.\s+', ', p.', 'g'), '. ') as x from o)),
y as (select distinct answer_id, n, sentence, trim(regexp_extract(c, '{A.CITED}', 1)) as cited_file from (select *, unnest(regexp_extract_all(sentence, '{A.CITED}')) as c from s)),
w as (select answer_id, n, cited_file, unnest(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(sentence, '{A.NOTE}', '', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 4 and x not in ({", ".join(map(_quote, W.CLAIM_STOP))})))) as word from y),
k as (select distinct file_name as cited_file, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) as word from c), r as (select answer_id, w.n, w.cited_file, avg(case when k.word is null then 0.0 else 1.0 end) as share from w left join k using (cited_file, word) where w.cited_file in (select cited_file from k) group by all)
select answer_id, n, cited_file, round(share, 6) as share, share < 0.3 as wrong from r""", wide=("n",))
def misattribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third answer speaks of something that its file doesn't hold."""
    words = _chunks(spark, sf_dir).select(F.col("file_name").alias("cited_file"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).distinct()
    a = _answers(spark, sf_dir)
    other = F.concat(F.regexp_extract("answer", r"^\W*\w+", 0), F.lit(_OTHER_SUBJECT), F.regexp_extract("answer", r" \[[^\[\]]*\]$", 0))
    return A.attribution(a.select("answer_id", F.when(F.col("chunk_index") % 3 == 0, other).otherwise(F.col("answer")).alias("answer")), words)


def _count_sql(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"case when contains({text}, {_quote(p)}) then 1 else 0 end" for p in phrases) + ")"


@query(rf"""with {_ANSWERS}, b as (select *, lower(answer) as low, len(regexp_extract_all(answer, ', p\.')) as cites, string_split(answer, '. ') as sent, list_distinct(list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: strlen(x) > 3)) as long from a),
d as (select *, len(list_filter(sent, lambda x: contains(x, '[') and contains(x, ', p.'))) / len(sent) as share, len(list_filter(long, lambda x: contains(lower(source), x))) / len(long) as grounded from b)
select answer_id, round(cast(greatest(0, least(1, 1.0 - 0.05 * {_count_sql("low", W.HEDGES)} + case when cites = 0 then -0.25 when cites = 1 then -0.05 when cites <= 4 then 0.05 else 0.1 end + case when len(sent) > 2 then case when share < 0.3 then -0.15 when share > 0.6 then 0.05 else 0 end else 0 end
 - case when len(long) > 0 and grounded < 0.5 then 0.2 else 0 end - case when strlen(answer) < 50 then 0.1 else 0 end - case when {sql_any("low", ("not present in the provided", "not found in the"))} then 0.15 else 0 end)) as double), 6) as confidence from d""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.select("answer_id", F.round(A.confidence(F.col("answer"), F.col("source")), 6).alias("confidence"))


@query(rf"""with {_ANSWERS}, f as (select doc_id, max_by(fact_sheet.amounts, loaded_at) as amounts from files group by doc_id),
m as (select a.*, amounts, lower(answer) as low, list_filter(list_transform(regexp_extract_all(answer, '{A.CLAIM}', 1), lambda x: trim(regexp_replace(x, '{A.NOTE}', '', 'g'))), lambda x: strlen(x) >= 15 and len(regexp_extract_all(x, '{A.TOKEN}')) > 0) as claims, regexp_extract_all(answer, '{A.BRACKET}') as br from a left join f using (doc_id)),
g as (select answer_id, case when chunk_index = 0 then 100.0 when chunk_index = 1 then 75 when chunk_index = 2 then 50 when chunk_index = 3 then 25 else 10 end as retrieval,
 case when len(claims) = 0 then 100.0 else len(list_filter(claims, lambda c: len(list_filter(regexp_extract_all(c, '{A.TOKEN}'), lambda t: not contains(source, t))) = 0)) / len(claims) * 100 end as grounding,
 case when len(br) = 0 then 0.0 else len(list_filter(br, lambda x: regexp_matches(x, '{A.CITED}') and trim(regexp_extract(x, '{A.CITED}', 1)) = file_name)) / len(br) * 100 end as cited,
 case when amounts is null or len(amounts) = 0 then 100.0 else len(list_filter(amounts, lambda x: contains(low, lower(x)))) / len(amounts) * 100 end as complete,
 greatest(0.0, 100.0 - least(30, 5 * {_count_sql("low", W.GRADED_HEDGES)}) - least(30, 10 * {_count_sql("low", W.FILLERS)}) - case when len(list_filter(regexp_split_to_array(answer, '\s+'), lambda x: x <> '')) > 800 then 20 else 0 end) as efficient from m)
select answer_id, round(cast(retrieval as double), 4) as retrieval, round(grounding, 4) as grounding, round(cited, 4) as cited, round(complete, 4) as complete, round(cast(efficient as double), 4) as efficient, round(retrieval * 0.25 + grounding * 0.3 + cited * 0.15 + complete * 0.2 + efficient * 0.1, 4) as overall,
 case when round(retrieval * 0.25 + grounding * 0.3 + cited * 0.15 + complete * 0.2 + efficient * 0.1, 4) >= 90 then 'A' when round(retrieval * 0.25 + grounding * 0.3 + cited * 0.15 + complete * 0.2 + efficient * 0.1, 4) >= 80 then 'B' when round(retrieval * 0.25 + grounding * 0.3 + cited * 0.15 + complete * 0.2 + efficient * 0.1, 4) >= 70 then 'C' when round(retrieval * 0.25 + grounding * 0.3 + cited * 0.15 + complete * 0.2 + efficient * 0.1, 4) >= 60 then 'D' else 'F' end as letter from g""")
def grade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("fact_sheet.amounts", "loaded_at").alias("amounts"))
    a = _answers(spark, sf_dir).join(sheet, "doc_id", "left")
    found = A.brackets(F.col("answer"))
    good = F.filter(found, lambda x: x.rlike(A.CITED) & (F.trim(F.regexp_extract(x, A.CITED, 1)) == F.col("file_name")))
    g = a.select(
        "answer_id", A.grade_retrieval(F.col("chunk_index") + 1).alias("retrieval"), A.grade_grounding(F.col("answer"), F.col("source")).alias("grounding"),
        F.when(F.size(found) == 0, 0.0).otherwise(F.size(good) / F.size(found) * 100).alias("cited"),
        A.grade_completeness(F.col("answer"), F.col("amounts")).alias("complete"), A.grade_efficiency(F.col("answer"), "balanced").alias("efficient"),
    )
    five = ["retrieval", "grounding", "cited", "complete", "efficient"]
    total = F.round(A.overall(*[F.col(c) for c in five]), 4)
    return g.withColumn("overall", total).select("answer_id", *[F.round(c, 4).alias(c) for c in five], "overall", A.letter(F.col("overall")).alias("letter"))


# --- evaluation: every figure in dollars on a page is a case. It asks with the words before the figure and expects the
# figure among the chunks of the file; one more case of each file asks for what it can't hold and expects nothing. Two
# backends are compared: the lexical ranking of the file's chunks (rank), and their order in the file (place).


_FIGURE = r"([A-Za-z][^.$\n]{15,80})\$ ?(\d[\d,]{2,})"
_ABSENT = "which zoologist of the aquarium measured the rent of the penguins"
_STOP = ", ".join(map(_quote, W.QUESTION_STOP))
_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2)"
_EVAL = rf"""{_CHUNKS}, ck as (select *, chunk_index || ':' || page_number || ':' || md5(text) as k, row_number() over (partition by doc_id order by chunk_index, page_number, text) as place from c),
fi as (select doc_id, max_by(coalesce(role, 'ClientDocument'), loaded_at) as role, regexp_extract(lower(min(file_name)), '\.([a-z0-9]+)$', 1) as kind from files group by doc_id),
fg as (select doc_id, page_number, unnest(regexp_extract_all(text, '{_FIGURE}')) as x, generate_subscripts(regexp_extract_all(text, '{_FIGURE}'), 1) as i from {PAGES}),
f as (select distinct doc_id || ':' || page_number || ':' || i as case_id, doc_id, role, kind, [regexp_extract(x, '{_FIGURE}', 2)] as expected, lower(regexp_extract(x, '{_FIGURE}', 1)) as question from fg join fi using (doc_id) union all select doc_id || ':none', doc_id, role, kind, [], '{_ABSENT}' from fi),
q as (select distinct case_id, doc_id, term from (select case_id, doc_id, unnest(regexp_split_to_array(question, '[^\p{{L}}\p{{N}}]+')) as term from f) where strlen(term) >= 3 and term not in ({_STOP})),
bp as (select doc_id, k, term, count(*) as tf from (select doc_id, k, unnest({_TERMS}) as term from ck) group by all), bd as (select doc_id, k, coalesce(len({_TERMS}), 0) as dl from ck), bs as (select doc_id, count(*) as n_docs, avg(dl) as avg_dl from bd group by doc_id), bf as (select doc_id, term, count(*) as df from bp group by all),
b as (select case_id, doc_id, k, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl / avg_dl))), 6) as score from q join bf using (doc_id, term) join bp using (doc_id, term) join bd using (doc_id, k) join bs using (doc_id) group by all),
br as (select *, row_number() over (partition by case_id order by score desc, k) as rank from b), t6 as (select case_id, rank, score, lower(text) as t from br join ck using (doc_id, k) where rank <= 6), p6 as (select case_id, place, lower(text) as t from f join ck using (doc_id) where place <= 6),
h as (select f.case_id, min(rank) filter (where contains(t, expected[1])) as hit from f join t6 using (case_id) where len(expected) > 0 group by f.case_id), hp as (select f.case_id, min(place) filter (where contains(t, expected[1])) as hit_place from f join p6 using (case_id) where len(expected) > 0 group by f.case_id),
m as (select f.case_id, f.doc_id, role, kind, hit, hit_place, coalesce(1.0 / hit, 0) as mrr, coalesce(hit = 1, false) as p1, case when hit is null then 0.0 else 1.0 end as recall from f left join h using (case_id) left join hp using (case_id) where len(expected) > 0)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, doc_id, role, kind, expected, question."""
    f = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by(F.coalesce("role", F.lit("ClientDocument")), "loaded_at").alias("role"), F.regexp_extract(F.lower(F.min("file_name")), r"\.([a-z0-9]+)$", 1).alias("kind"))
    x = _pages(spark, sf_dir).select("doc_id", "page_number", F.posexplode(F.regexp_extract_all("text", F.lit(_FIGURE), F.lit(0))).alias("i", "x"))
    case_id = F.concat_ws(":", "doc_id", F.col("page_number").cast("string"), (F.col("i") + 1).cast("string"))
    asked = x.select(case_id.alias("case_id"), "doc_id", F.array(F.regexp_extract("x", _FIGURE, 2)).alias("expected"), F.lower(F.regexp_extract("x", _FIGURE, 1)).alias("question")).distinct()
    none = f.select(F.concat("doc_id", F.lit(":none")).alias("case_id"), "doc_id", F.array().cast("array<string>").alias("expected"), F.lit(_ABSENT).alias("question"))
    return asked.unionByName(none).join(f, "doc_id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.col("chunk_index").cast("string"), F.col("page_number").cast("string"), F.md5(F.encode("text", "UTF-8")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "page_number", "text"))
    return _chunks(spark, sf_dir).select("doc_id", key.alias("k"), "text", place.alias("place"))


def _asked(cases: DataFrame) -> DataFrame:
    return cases.select("doc_id", F.col("case_id").alias("query_id"), F.explode(keyword_set(F.col("question"), W.QUESTION_STOP, 3)).alias("term"), F.lit(1).alias("mult"))


def _top(spark: SparkSession, sf_dir: str, cases: DataFrame, top_k: int = 6) -> DataFrame:
    """case_id, rank, score, t: the results of each case."""
    chunks = _placed(spark, sf_dir)
    scored = bm25.score(chunks, _asked(cases), id_="k", group="doc_id")
    ranked = bm25.top(scored, top_k, id_="k")
    return ranked.join(chunks.select("doc_id", "k", F.lower("text").alias("t")), ["doc_id", "k"]).select(F.col("query_id").alias("case_id"), "rank", "score", "t")


def _metrics(spark: SparkSession, sf_dir: str, top_k: int = 6) -> DataFrame:
    cases = _cases(spark, sf_dir)
    k = cases.where(F.size("expected") > 0)
    has = F.col("t").contains(F.col("expected")[0])
    hit = _top(spark, sf_dir, cases, top_k).join(k, "case_id").where(has).groupBy("case_id").agg(F.min("rank").cast("bigint").alias("hit"))
    first = _placed(spark, sf_dir).where(F.col("place") <= top_k).select("doc_id", "place", F.lower("text").alias("t"))
    hit_place = first.join(k, "doc_id").where(has).groupBy("case_id").agg(F.min("place").cast("bigint").alias("hit_place"))
    m = k.join(hit, "case_id", "left").join(hit_place, "case_id", "left")
    return m.select("case_id", "doc_id", "role", "kind", "hit", "hit_place", F.coalesce(1.0 / F.col("hit"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("hit") == 1, F.lit(False)).alias("p1"), F.when(F.col("hit").isNull(), 0.0).otherwise(1.0).alias("recall"))


@query(f"""with {_EVAL}, mx as (select case_id, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1))) * 1.9, 6) as most from q join bf using (doc_id, term) join bs using (doc_id) group by case_id),
w as (select f.case_id, expected, rank, round(score / most, 4) as share, t from f left join t6 using (case_id) left join mx using (case_id)),
i as (select case_id, any_value(expected) as expected, min(rank) filter (where contains(t, expected[1])) as first_hit, max(share) as best, coalesce(bool_or(contains(t, 'arbitrat')), false) as anywhere from w group by case_id),
s as (select i.case_id, bool_or(contains(y, 'arbitrat')) as beside from i join (select case_id, rank, unnest(regexp_split_to_array(t, '[.!?]')) as y from w) z on i.case_id = z.case_id and rank = first_hit where contains(y, expected[1]) group by i.case_id)
select case_id, case when len(expected) = 0 then 'negative' else 'standard' end as case_type, case when len(expected) = 0 then anywhere else coalesce(beside, false) end as violated, case when len(expected) = 0 then coalesce(best, 0) < 0.65 and not anywhere else first_hit is not null and not coalesce(beside, false) end as passed from i left join s using (case_id)""")
def eval_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with what the answer must not say (here: arbitration). Standard cases pass with all that is expected and
    no such word in the sentences that answer; cases without anything expected pass with low scores and no such word
    in any result. Scores are shares of the most a chunk could reach."""
    cases = _cases(spark, sf_dir)
    chunks = _placed(spark, sf_dir)
    terms = bm25.term_stats(bm25.postings(chunks, "k", "doc_id"), "doc_id")
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_docs"))
    weight = bm25.idf(F.col("n_docs"), F.col("df"))
    most = _asked(cases).join(terms, ["doc_id", "term"]).join(n, "doc_id").groupBy(F.col("query_id").alias("case_id")).agg(F.round(F.sum(weight) * (bm25.K1 + 1), 6).alias("most"))
    got = E.judged(cases.select("case_id", "expected"), _top(spark, sf_dir, cases), most, ("arbitrat",))
    return got.select("case_id", "case_type", "violated", (F.when(F.col("case_type") == "negative", F.col("low")).otherwise(F.col("found")) & ~F.col("violated")).alias("passed"))


@query(f"with {_EVAL} select case_id, role, kind, cast(hit as double) as hit, round(mrr, 6) as mrr, p1, recall, recall = 1 as passed from m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("case_id", "role", "kind", F.col("hit").cast("double").alias("hit"), F.round("mrr", 6).alias("mrr"), "p1", "recall", (F.col("recall") == 1).alias("passed"))


@query(f"with {_EVAL} select role, kind, count(*) as cases, cast(sum(case when recall = 1 then 1 else 0 end) as bigint) as passed, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(case when p1 then 1.0 else 0 end), 6) as p1 from m group by grouping sets ((), (role), (kind))")
def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, by role and by kind of file, in one pass."""
    m = _metrics(spark, sf_dir)
    return m.groupingSets([[], ["role"], ["kind"]], "role", "kind").agg(
        F.count("*").alias("cases"), F.count_if(F.col("recall") == 1).alias("passed"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg(F.col("p1").cast("double")), 6).alias("p1")
    )


@query(f"with {_EVAL} select case_id, cast(hit_place as double) as before, cast(hit as double) as now, case when hit_place is null and hit is null then 'neither' when hit_place is null then 'gained' when hit is null then 'lost' when hit < hit_place then 'better' when hit > hit_place then 'worse' else 'same' end as change, abs(round(mrr - coalesce(1.0 / hit_place, 0), 6)) > 0.005 as moved from m")
def eval_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    b, n = F.col("hit_place"), F.col("hit")
    change = F.when(b.isNull() & n.isNull(), "neither").when(b.isNull(), "gained").when(n.isNull(), "lost").when(n < b, "better").when(n > b, "worse").otherwise("same")
    return m.select("case_id", b.cast("double").alias("before"), n.cast("double").alias("now"), change.alias("change"), (F.abs(F.round(F.col("mrr") - F.coalesce(1.0 / b, F.lit(0.0)), 6)) > 0.005).alias("moved"))


@query(f"""with {_EVAL}, y as (select m.kind, v.mode, case when hit <= v.k then 1 else 0 end as found from m, (values ('quick', 3), ('balanced', 6)) v(mode, k))
select kind, round(avg(found) filter (where mode = 'quick'), 6) as quick, round(avg(found) filter (where mode = 'balanced'), 6) as balanced from y group by kind""")
def eval_mode_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = spark.createDataFrame([("quick", 3), ("balanced", 6)], "mode string, k int")
    rows = _metrics(spark, sf_dir).join(F.broadcast(modes)).select("kind", "mode", F.when(F.col("hit") <= F.col("k"), 1).otherwise(0).alias("found"))  # two rows of modes
    return rows.groupBy("kind").pivot("mode", ["quick", "balanced"]).agg(F.round(F.avg("found"), 6))


# --- context


# Every file is asked the same question; its chunks are ranked for it.
_QUESTION = "what deposit and rent must the tenant or buyer pay under the agreement, and who keeps the premises in good repair"
_KEYWORDS = sorted({w for w in re.split(r"[^a-z]+", _QUESTION) if len(w) >= 3} - set(W.QUESTION_STOP))
_RANKED = f"""{_CHUNKS}, ck as (select *, chunk_index || ':' || page_number || ':' || md5(text) as k from c), q as (select distinct doc_id, unnest({_KEYWORDS}) as term from c),
bp as (select doc_id, k, term, count(*) as tf from (select doc_id, k, unnest({_TERMS}) as term from ck) group by all), bd as (select doc_id, k, coalesce(len({_TERMS}), 0) as dl from ck), bs as (select doc_id, count(*) as n_docs, avg(dl) as avg_dl from bd group by doc_id), bf as (select doc_id, term, count(*) as df from bp group by all),
b as (select doc_id, k, round(sum(greatest(0, ln((n_docs - df + 0.5) / (df + 0.5) + 1)) * tf * 1.9 / (tf + 0.9 * (0.5 + 0.5 * dl / avg_dl))), 6) as score from q join bf using (doc_id, term) join bp using (doc_id, term) join bd using (doc_id, k) join bs using (doc_id) group by all),
r as (select ck.*, score, row_number() over (partition by doc_id order by score desc, k) as rank from b join ck using (doc_id, k)), s as (select * from r where rank <= 6)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.col("chunk_index").cast("string"), F.col("page_number").cast("string"), F.md5(F.encode("text", "UTF-8")))
    chunks = _chunks(spark, sf_dir).withColumn("k", key)
    asked = chunks.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("query_id"), F.explode(F.array(*map(F.lit, _KEYWORDS))).alias("term"), F.lit(1).alias("mult"))
    ranked = bm25.top(bm25.score(chunks.select("doc_id", "k", "text"), asked, id_="k", group="doc_id"), 6, id_="k")
    return chunks.join(ranked.select("doc_id", "k", "rank", "score"), ["doc_id", "k"]).drop("k")


_BUDGET = f"""{_RANKED}, b1 as (select *, count(*) over w as n, sum(score) over w as total from s window w as (partition by doc_id)),
b2 as (select *, cast(least(200, floor(1000 / n)) as bigint) as floor_, greatest(cast(case when total <= 0 then floor(1000 / n) else floor(round(score / total * 1000, 6)) end as bigint), cast(least(200, floor(1000 / n)) as bigint)) as raw from b1),
b3 as (select *, greatest(0, sum(raw) over (partition by doc_id) - 1000) as over_, coalesce(sum(raw - floor_) over (partition by doc_id order by rank desc rows between unbounded preceding and 1 preceding), 0) as later from b2),
b4 as (select *, cast(raw - least(raw - floor_, greatest(0, over_ - later)) as bigint) as budget from b3)"""


@query(f"with {_BUDGET} select doc_id, rank, budget from b4", wide=("rank",))
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.budgets(_ranked(spark, sf_dir).select("doc_id", "rank", "score"), 1000, 200).select("doc_id", "rank", "budget")


@query(f"""with {_RANKED}, sel as (select distinct doc_id, chunk_index from s where rank <= 3), w as (select doc_id, chunk_index, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: strlen(x) > 4) as w from s where rank <= 3),
n as (select c.doc_id, c.chunk_index, c.text, w.w from c join w on c.doc_id = w.doc_id and (c.chunk_index = w.chunk_index - 1 or c.chunk_index = w.chunk_index + 1))
select distinct doc_id, chunk_index from n where not exists (select 1 from sel where sel.doc_id = n.doc_id and sel.chunk_index = n.chunk_index) and len(list_intersect(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: strlen(x) > 4)), list_distinct(w))) >= 5""")
def neighbor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.neighbours(_ranked(spark, sf_dir).where("rank <= 3").select("doc_id", "chunk_index", "text"), _chunks(spark, sf_dir).select("doc_id", "chunk_index", "text"))


@query(f"with {_RANKED}, n as (select *, count(*) over (partition by doc_id) as n from s) select doc_id, rank, case when n < 3 or rank = 1 then rank when rank = 2 then n else n - rank + 2 end as place from n", wide=("rank",))
def sandwich_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return _ranked(spark, sf_dir).select("doc_id", "rank", C.sandwich(F.col("rank"), n).cast("bigint").alias("place"))


@query(f"with {_RANKED}, m as (select *, max(score) over (partition by doc_id) as most from s) select doc_id, rank, case when most > 0 and score / most > 0.85 then 'high' when most > 0 and score / most > 0.60 then 'medium' else 'low' end as relevance, round(least(score / 0.035, 1), 6) as shown from m", wide=("rank",))
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = C.relevance(F.col("score"), F.max("score").over(Window.partitionBy("doc_id")))
    return _ranked(spark, sf_dir).select("doc_id", "rank", label.alias("relevance"), F.round(F.least(F.col("score") / 0.035, F.lit(1.0)), 6).alias("shown"))


_COMPRESS = r"(x <> '' and not regexp_matches(x, '^[_\-=.]+$') and not (regexp_matches(x, '^[Pp]age ') and strlen(x) < 15) and not (strlen(x) > 5 and not regexp_matches(x, '[\p{L}\p{N}]') and len(list_distinct(string_split(x, ''))) <= 2))"
_CONTEXT = f"""{_BUDGET.replace("1000", "5500")}, h as ({_HEADER_SQL.replace("from c)", "from b4)")}), mx as (select doc_id, max(score) as most from s group by doc_id),
ln as (select doc_id, rank, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from b4),
cl as (select doc_id, rank, coalesce(string_agg(x, chr(10) order by i) filter (where {_COMPRESS}), '') as body from ln group by doc_id, rank),
lb as (select h.*, body, '--- Source ' || rank || ': ' || file_name || ' | p. ' || page_number || case when header is null then '' else ' | §' || header end || ' | relevance: ' || case when most > 0 and score / most > 0.85 then 'high' when most > 0 and score / most > 0.60 then 'medium' else 'low' end || ' ---' || chr(10) as label, count(*) over (partition by doc_id) as cnt from h join mx using (doc_id) join cl using (doc_id, rank)),
pa as (select doc_id, label || case when length(body) <= greatest(0, budget - length(label)) then body else substring(body, 1, greatest(0, budget - length(label))) || '...' end as part, case when cnt < 3 or rank = 1 then rank when rank = 2 then cnt else cnt - rank + 2 end as place from lb),
tt as (select *, sum(length(part) + case when place > 1 then 7 else 0 end) over (partition by doc_id order by place rows unbounded preceding) as total from pa)"""


@query(f"with {_CONTEXT} select doc_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as context, count(*) as used from tt where total <= 5500 group by doc_id")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assemble(C.budgets(_ranked(spark, sf_dir), 5500, 200), 5500)


# --- bookkeeping


@query("select doc_id, min(file_name) as file_name, count(*) as chunk_count, max(page_number) as total_pages from chunks group by doc_id")
def registry_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rebuild_registry(read_table(spark, sf_dir, "chunks"))


@query("""with r as (select doc_id, min(file_name) as file_name, count(*) as chunk_count, max(page_number) as total_pages from chunks group by doc_id), s as (select doc_id, max_by(case_id, loaded_at) as case_id, max_by(role, loaded_at) as role from files group by doc_id)
select doc_id, file_name, chunk_count, total_pages, case_id, coalesce(role, 'ClientDocument') as role from r left join s using (doc_id)""")
def registry_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("case_id", "loaded_at").alias("case_id"), F.max_by("role", "loaded_at").alias("role"))
    fresh = R.rebuild_registry(read_table(spark, sf_dir, "chunks")).withColumn("role", F.lit("ClientDocument"))
    return R.restore(fresh, saved, ["case_id", "role"])


@query("select doc_id, case_id, loaded_at, total_pages from (select *, row_number() over (partition by doc_id order by loaded_at desc) as r from files) where r = 1")
def files_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(read_table(spark, sf_dir, "files"), "doc_id", "loaded_at").select("doc_id", "case_id", "loaded_at", "total_pages")


@query("with w as (select distinct doc_id from files where case_id in (select case_id from cases where jurisdiction.level = 'state')) select doc_id, count(*) as chunks from chunks where doc_id in (select doc_id from w) group by doc_id")
def case_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the files of state cases."""
    cases = read_table(spark, sf_dir, "cases").where("jurisdiction.level = 'state'").select("case_id")
    docs = read_table(spark, sf_dir, "files").join(cases, "case_id", "left_semi").select("doc_id").distinct()
    return read_table(spark, sf_dir, "chunks").join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("with k as (select distinct file_path, content_hash from files where loaded_at < (select median(loaded_at) from files)) select distinct doc_id, file_path from files f where not exists (select 1 from k where k.file_path = f.file_path and k.content_hash = f.content_hash)")
def hash_skip_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not in the earlier half of the ledger by path and hash."""
    files = read_table(spark, sf_dir, "files")
    half = files.agg(F.median("loaded_at").alias("m"))
    known = files.join(F.broadcast(half)).where("loaded_at < m")  # one row
    return R.changed(files, known).select("doc_id", "file_path").distinct()


@query("with gone as (select case_id from files where case_id is not null group by case_id order by count(*) desc, case_id limit 1), g as (select distinct doc_id from files where case_id in (select case_id from gone)) select doc_id, count(*) as chunks from chunks where doc_id not in (select doc_id from g) group by doc_id")
def delete_case_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "files")
    first = files.where("case_id is not null").groupBy("case_id").count().orderBy(F.desc("count"), "case_id").first()
    _, chunks = R.delete_case(files, read_table(spark, sf_dir, "chunks"), first["case_id"] if first else "", cascade=True)
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("""with f as (select distinct file_name, case_id from files), e as (select e.*, f.case_id from entities e join f on e.source_file = f.file_name)
select coalesce(case_id, '') as case_id, count(distinct entity_id) as entities, count(distinct name) as names from e group by 1""")
def entities_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "files").select(F.col("file_name").alias("source_file"), "case_id").distinct()
    e = read_table(spark, sf_dir, "entities").join(files, "source_file")
    return e.groupBy(F.coalesce("case_id", F.lit("")).alias("case_id")).agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("name").alias("names"))


@query("select name, entity_id, source_file from (select *, row_number() over (partition by name order by source_file, entity_id) as r from entities) where r = 1")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for each spelling; the first file's counts."""
    e = read_table(spark, sf_dir, "entities").select("name", "entity_id", "source_file")
    return R.add_entities(e.limit(0), e)


@query("with n as (select max(updated_at) as now from cases) select case_id, case when floor((now - updated_at) / 86400000) < 1 then 'today' when floor((now - updated_at) / 86400000) < 2 then 'yesterday' when floor((now - updated_at) / 86400000) < 7 then 'week' when floor((now - updated_at) / 86400000) < 30 then 'month' else 'older' end as bucket from cases, n")
def session_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read_table(spark, sf_dir, "cases")
    now = cases.agg(F.max("updated_at").alias("now"))
    return cases.join(F.broadcast(now)).select("case_id", R.age_bucket(F.col("updated_at"), F.col("now")).alias("bucket"))  # one row


_TURNS = "m as (select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as turn, case when event_id % 2 = 0 then 'user' else 'assistant' end as role, event_type || ' ' || event_id as content from events)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("session_id"), turn.alias("turn"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("content"))


@query(f"""with {_TURNS}, l as (select *, lead(role) over w as nr, lead(content) over w as na from m window w as (partition by session_id order by turn)), p as (select *, row_number() over (partition by session_id order by turn desc) as back from l where role = 'user' and nr = 'assistant')
select session_id, content as user, na as assistant, back from p where back <= 3""", wide=("back",))
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_turns(_turns(spark, sf_dir))


@query(f"with {_TURNS}, u as (select *, row_number() over (partition by session_id order by turn) as r from m where role = 'user') select session_id, string_agg(substr(content, 1, 80), '; ' order by r) as summary from u where r <= 3 group by session_id")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _turns(spark, sf_dir).where("role = 'user'")
    first = u.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))).where("r <= 3")
    return first.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("content", 1, 80).alias("c")))), lambda p: p["c"]), "; ").alias("summary"))


@query("select user_id as session_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def session_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("session_id", "e.event_id", "e.event_type")


@query("""with c as (select distinct file_name, page_number, chunk_index, doc_id, text from chunks), r as (select *, row_number() over (partition by file_name, page_number order by chunk_index, doc_id, text) as n from c where length(text) > 0)
select file_name, page_number, count(*) as pieces, cast(sum(length(text)) as double) as size, string_agg(substr(text, 1, 20), '|' order by n) as heads from r group by file_name, page_number""")
def page_chunks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "chunks").select("file_name", "page_number", "chunk_index", "doc_id", "text").distinct().where(F.length("text") > 0)
    heads = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "doc_id", "text"))), lambda p: F.substring(p["text"], 1, 20))
    return c.groupBy("file_name", "page_number").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).cast("double").alias("size"), F.array_join(heads, "|").alias("heads"))
