"""Queries of made-up entities, strong claims, fact sheets, sessions, and what else stands around answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import words as W
from paperloom.operators import answers as A
from paperloom.operators import bm25, extract, jurisdiction
from paperloom.operators import registry_ops as R
from paperloom.plans.answer_queries import _ANSWERS, _TURNS, _answers, _chunks, _turns
from paperloom.plans.registry import query
from paperloom.plans.text_queries import PAGES, _pages, _quote, sql_any
from paperloom.session import read_table, shared_folder
from paperloom.sources import cases, sinks
from paperloom.streaming import ingest

# Answers that name courts, counties, case numbers and parties: half of what they name stands in the file, half is made up.
_NAMES = f"""{_ANSWERS}, pt as (select doc_id, regexp_extract(coalesce(max_by(fact_sheet.parties, loaded_at)[1], ''), '([A-Z][a-z]+ [A-Z][a-z]+)', 1) as party from files group by doc_id),
x as (select answer_id, doc_id, source, case when chunk_index % 2 = 0 then 'Superior Court of Marlowe' else 'District Court of Orvan' end || '. County of Orvan. Case No. ' || (4700 + chunk_index) || '. The plaintiff ' || case when party = '' or chunk_index % 3 = 0 then 'Quillon Farrow' else party end || ' agreed. ' || answer as answer from a left join pt using (doc_id))"""


def _naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("fact_sheet.parties", "loaded_at").alias("p"))
    party = files.select("doc_id", F.regexp_extract(F.coalesce(F.get("p", F.lit(0)), F.lit("")), "([A-Z][a-z]+ [A-Z][a-z]+)", 1).alias("party"))
    court = F.when(F.col("chunk_index") % 2 == 0, "Superior Court of Marlowe").otherwise("District Court of Orvan")
    named = F.when((F.coalesce("party", F.lit("")) == "") | (F.col("chunk_index") % 3 == 0), "Quillon Farrow").otherwise(F.col("party"))
    a = _answers(spark, sf_dir).join(party, "doc_id", "left")
    text = F.concat(court, F.lit(". County of Orvan. Case No. "), (F.col("chunk_index") + 4700).cast("string"), F.lit(". The plaintiff "), named, F.lit(" agreed. "), "answer")
    return a.select("answer_id", "doc_id", "source", text.alias("answer"))


_FOUND = " union all ".join(f"select answer_id, doc_id, {_quote(kind)} as kind, unnest(regexp_extract_all(answer, {_quote(pattern)}{f', {group}' if group else ''})) as name from x" for kind, pattern, group in A.NAMED)


@query(rf"""with {_NAMES}, n as ({_FOUND}), w as (select distinct answer_id, doc_id, kind, name from n where strlen(name) >= 4),
y as (select distinct doc_id, name from w), h as (select distinct doc_id, name from y join c using (doc_id) where contains(lower(c.text), lower(name)))
select answer_id, kind, name from w where not exists (select 1 from h where h.doc_id = w.doc_id and h.name = w.name)""")
def fabricated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts, counties, case numbers and parties in answers that no chunk of their file names."""
    return A.fabricated(_naming(spark, sf_dir), _chunks(spark, sf_dir).select("doc_id", "text"))


_STRONG = f"""s as (select answer_id, doc_id, md5(source) as own, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '[^.!?\\n]+[.!?]'), lambda z: trim(regexp_replace(z, '{A.NOTE}', '', 'g'))), lambda z: strlen(z) >= 15))) as claim from a),
k as (select answer_id, doc_id, own, claim, case when {sql_any("lower(claim)", W.QUALIFIERS)} then 'qualifier' when regexp_matches(lower(claim), '{A.NEGATION}') and {sql_any("lower(claim)", W.LEGAL_TERMS)} then 'negation' end as kind from s),
w as (select answer_id, doc_id, own, claim, kind, unnest(list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^\\p{{L}}\\p{{N}}]+'), lambda z: strlen(z) >= 4 and z not in ({", ".join(map(_quote, W.CLAIM_STOP))})))) as word from k where kind is not null)"""


@query(rf"""with {_ANSWERS}, {_STRONG}, fw as (select doc_id, word, count(distinct h) as n, min(h) as h from (select doc_id, md5(text) as h, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) as word from c) group by all),
r as (select answer_id, claim, kind, avg(case when fw.n > 1 or fw.h <> w.own then 1.0 else 0.0 end) as share from w left join fw using (doc_id, word) group by all) select answer_id, claim, kind, round(share, 6) as share, share >= 0.5 as supported from r""")
def strong_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with strong qualifiers, or denials of legal matters, and the share of their key words in the other
    chunks of their file."""
    texts = _chunks(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).distinct()
    held = texts.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    return A.strong_claims(_answers(spark, sf_dir).withColumn("own", F.md5(F.encode("source", "UTF-8"))), held)


@query(rf"""with {_ANSWERS}, g as (select answer_id, source, answer, regexp_extract_all(answer, '{A.BRACKET}') as br, file_name from a)
select answer_id, round(0.6 * (case when len(br) = 0 then 0.0 else len(list_filter(br, lambda z: regexp_matches(z, '{A.CITED}') and trim(regexp_extract(z, '{A.CITED}', 1)) = file_name)) / len(br) end) + 0.4 * case when len(br) = 0 then 0.25 else 0.75 end, 6) as confidence from g""")
def graded_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of an answer's citations and a plain heuristic, weighed together."""
    found = A.brackets(F.col("answer"))
    good = F.filter(found, lambda z: z.rlike(A.CITED) & (F.trim(F.regexp_extract(z, A.CITED, 1)) == F.col("file_name")))
    grade = F.when(F.size(found) == 0, 0.0).otherwise(F.size(good) / F.size(found) * 100)
    return _answers(spark, sf_dir).select("answer_id", F.round(A.graded_confidence(F.when(F.size(found) == 0, 0.25).otherwise(0.75), grade), 6).alias("confidence"))


_TITLES = "p as (select doc_id, page_number, 'Lease between ' || coalesce(x, 'Marlowe Farrow') || ' (the owner) and Quillon Orvan, dated 2024-05-03.' || chr(10) || 'Landlord: ' || coalesce(x, 'Marlowe Farrow') || ',' || chr(10) || 'Section 2. Payment of Rent' || chr(10) || text as text from (select doc_id, page_number, text, nullif(regexp_extract(text, '([A-Z][a-z]+ [A-Z][a-z]+)', 1), '') as x from " + PAGES + "))"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a heading that names two parties, a role and a clause."""
    x = F.regexp_extract("text", "([A-Z][a-z]+ [A-Z][a-z]+)", 1)
    name = F.when(x == "", "Marlowe Farrow").otherwise(x)
    text = F.concat(F.lit("Lease between "), name, F.lit(" (the owner) and Quillon Orvan, dated 2024-05-03.\nLandlord: "), name, F.lit(",\nSection 2. Payment of Rent\n"), "text")
    return _pages(spark, sf_dir).select("doc_id", "page_number", text.alias("text"))


_EDGE = r"'^\s+|\s+$', '', 'g'"


@query(rf"""with {_TITLES}, m as (select doc_id, page_number, unnest(regexp_extract_all(text, '{extract.BETWEEN}')) as x from p), s as (select doc_id, page_number, unnest([regexp_replace(regexp_extract(x, '{extract.BETWEEN}', 1), {_EDGE}), regexp_replace(regexp_extract(x, '{extract.BETWEEN}', 2), {_EDGE})]) as name from m)
select distinct doc_id, page_number, name from s where strlen(name) between 3 and 59""")
def between_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.between_entities(_titled(spark, sf_dir))


@query(rf"""with {_TITLES}, m as (select doc_id, page_number, unnest(regexp_extract_all(text, '{extract.TITLED}')) as x from p),
e as (select doc_id, page_number, lower(regexp_extract(x, '{extract.TITLED}', 1)) as role, regexp_replace(regexp_extract(x, '{extract.TITLED}', 2), {_EDGE}) as name from m)
select doc_id, page_number, role, name, count(*) as mentions from e where strlen(name) > 2 and strlen(name) < 60 group by doc_id, page_number, role, name""")
def role_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.role_entities(_titled(spark, sf_dir))


_ONCE = "list_filter({0}, lambda z, i: i = 1 or z <> {0}[i - 1])"


@query(rf"""with {_TITLES}, b as (select doc_id, page_number, text, list_concat(list_transform(regexp_extract_all(text, '{extract.PARTY_BETWEEN}', 1), lambda z: regexp_replace(z, {_EDGE})), list_transform(list_zip(regexp_extract_all(text, '{extract.PARTY_TITLED}', 1), regexp_extract_all(text, '{extract.PARTY_TITLED}', 2)), lambda z: z[1] || ': ' || regexp_replace(z[2], {_EDGE}))) as ps,
 regexp_extract_all(text, '{extract.DATE}') as ds, regexp_extract_all(text, '{extract.AMOUNT}') as ms,
 list_concat(list_transform(regexp_extract_all(text, '{extract.CLAUSE_LINE}', 1), lambda z: regexp_replace(z, {_EDGE})), list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda z: regexp_replace(z, {_EDGE})), lambda z: strlen(z) between 4 and 79 and length(regexp_replace(z, '[^\p{{L}}]', '', 'g')) > 3 and not regexp_matches(regexp_replace(z, '[^\p{{L}}]', '', 'g'), '[^\p{{Lu}}]'))) as cs from p)
select doc_id, page_number, array_to_string({_ONCE.format("ps")}, '; ') as parties, array_to_string({_ONCE.format("ds")}, '; ') as dates, array_to_string({_ONCE.format("ms")}, '; ') as amounts, array_to_string(list_slice({_ONCE.format("cs")}, 1, 15), '; ') as key_clauses, regexp_replace(substring(text, 1, 200), {_EDGE}) as summary from b""")
def fact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = extract.fact_sheets(_titled(spark, sf_dir))
    return s.select("doc_id", "page_number", *[F.array_join(c, "; ").alias(c) for c in ("parties", "dates", "amounts", "key_clauses")], "summary")


_FIRST = "list_transform(list_sort(list_transform(list_distinct({0}), lambda z: {{'i': list_position({0}, z), 'v': z}})), lambda z: z.v)"


@query(rf"""with x as (select doc_id, text, coalesce(regexp_extract_all(text, '{extract.DATE}'), []) as d, coalesce(regexp_extract_all(text, '{extract.AMOUNT}'), []) as m from documents where text is not null)
select doc_id, array_to_string(list_slice({_FIRST.format("d")}, 1, 8), '; ') as dates, array_to_string(list_slice({_FIRST.format("m")}, 1, 8), '; ') as amounts, array_to_string(list_slice(list_filter({list(W.LEGAL_TERMS)}, lambda t: contains(lower(text), t)), 1, 10), '; ') as terms from x""")
def fact_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return extract.fact_lists(docs, W.LEGAL_TERMS).select("doc_id", *[F.array_join(c, "; ").alias(c) for c in ("dates", "amounts", "terms")])


@query("""with f as (select doc_id, max_by(jurisdiction, loaded_at) as j from files where jurisdiction is not null group by doc_id)
select doc_id, case j.level when 'federal' then 'Federal law: cite as [Title] U.S.C. § [Section]. Note Erie doctrine for state claims.' when 'county' then coalesce(j.county, 'the local county') || ', ' || coalesce(j.state, 'the state') || ': apply local and state law.'
 when 'state' then case j.state when 'California' then 'California: note CCPA/CPRA, tenant protections (Civ. Code §1940+).' when 'New York' then 'New York: note rent stabilization, General Business Law §349.' when 'Texas' then 'Texas: community property state, DTPA consumer claims.' when 'Illinois' then 'Illinois: note BIPA biometric privacy.' else coalesce(j.state, 'the relevant state') || ': apply state-specific law.' end end as note from f""")
def jurisdiction_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "files").where("jurisdiction is not null").groupBy("doc_id").agg(F.max_by("jurisdiction", "loaded_at").alias("j"))
    return f.select("doc_id", jurisdiction.note(F.col("j.level"), F.col("j.state"), F.col("j.county")).alias("note"))


_TERM = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda z: strlen(z) >= 2)"


@query(rf"""with c as (select distinct doc_id, file_name, text from chunks), f as (select file_name, min(doc_id) as doc_id, max_by(case_id, loaded_at) as case_id from files group by file_name),
w as (select case_id, unnest({_TERM}) as word, c.file_name from c join f using (file_name) where case_id is not null), q as (select case_id, lower(regexp_extract(name, '([A-Za-z]{{4,}})', 1)) as word from cases),
h as (select case_id, file_name, count(*) as n from w join q using (case_id, word) group by all), r as (select *, row_number() over (partition by case_id order by n desc, file_name) as rank from h),
a as (select case_id, string_agg('[' || rank || '] ' || file_name, ', ' order by rank) as listed from r where rank <= 6 group by case_id), m as (select f.case_id, string_agg(f.file_name, ', ' order by f.file_name) as missing from f left join (select * from r where rank <= 6) r using (case_id, file_name) where f.case_id is not null and r.rank is null group by f.case_id)
select case_id, listed, missing from a full join m using (case_id)""")
def document_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the first long word of a case's name as the question: the files found in it, and those loaded but not found."""
    files = read_table(spark, sf_dir, "files").groupBy("file_name").agg(F.max_by("case_id", "loaded_at").alias("case_id")).where("case_id is not null")
    word = read_table(spark, sf_dir, "cases").select("case_id", F.lower(F.regexp_extract("name", "([A-Za-z]{4,})", 1)).alias("word"))
    post = bm25.postings(read_table(spark, sf_dir, "chunks").select("doc_id", "file_name", "text").distinct(), "file_name")
    hits = post.join(files, "file_name").withColumnRenamed("term", "word").join(word, ["case_id", "word"]).select("case_id", "file_name", F.col("tf").alias("n"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "file_name"))
    found = hits.groupBy("case_id", "file_name").agg(F.sum("n").alias("n")).withColumn("rank", rank).where("rank <= 6")
    in_order = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda p: p["t"]), ", ")
    listed = found.groupBy("case_id").agg(in_order("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "file_name")).alias("listed"))
    missing = files.join(found.select("case_id", "file_name"), ["case_id", "file_name"], "left_anti").groupBy("case_id").agg(in_order("file_name", F.col("file_name")).alias("missing"))
    return listed.join(missing, "case_id", "full")


@query(f"""with {_TURNS}, u as (select session_id, max(turn) as turns, string_agg(substr(content, 1, 20), '; ' order by turn) filter (where role = 'user' and turn <= 3) as summary from m group by session_id), w as (select session_id, session_id % 7 as case_id, turns, coalesce(summary, '') as summary from u)
select case_id, count(*) as sessions, count(*) filter (where summary <> '' and session_id <> first_id) as summaries, max(turns) as longest from (select *, min(session_id) over (partition by case_id) as first_id from w) group by case_id""")
def case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a case, and how many others than its first one have a summary to show."""
    parts = F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") & (F.col("turn") <= 3), F.struct("turn", F.substring("content", 1, 20).alias("c"))))), lambda p: p["c"])
    s = _turns(spark, sf_dir).groupBy("session_id").agg(F.max("turn").cast("bigint").alias("turns"), F.array_join(parts, "; ").alias("summary")).withColumn("case_id", F.col("session_id") % 7)
    first = s.groupBy("case_id").agg(F.min("session_id").alias("first_id"), F.count("*").alias("sessions"), F.max("turns").alias("longest"))
    shown = R.summaries(s, first.select("case_id", F.col("first_id").alias("exclude"))).groupBy("case_id").agg(F.count("*").alias("summaries"))
    return first.join(shown, "case_id", "left").select("case_id", "sessions", F.coalesce("summaries", F.lit(0)).cast("bigint").alias("summaries"), "longest")


@query("with u as (select doc_id, file_path, replace(replace(file_path, '%', '%25'), ' ', '%20') as url from files) select distinct doc_id, url, url_decode(url) as path from u where file_path is not null")
def file_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of files as a file server names them, and decoded again."""
    url = F.replace(F.replace("file_path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return read_table(spark, sf_dir, "files").where("file_path is not null").select("doc_id", url.alias("url")).select("doc_id", "url", R.path_of_url(F.col("url")).alias("path")).distinct()


_PLACED = f"""p as (select doc_id, page_number, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as page from {PAGES}), k as (select distinct doc_id, chunk_index, page_number, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as excerpt from chunks),
x as (select k.*, page, instr(page, excerpt) as whole, instr(page, substr(excerpt, 1, cast(floor(length(excerpt) * 0.7) as int))) as most, instr(page, substr(excerpt, 1, cast(floor(length(excerpt) * 0.35) as int))) as half from k join p using (doc_id, page_number))"""


@query(f"with {_PLACED} select doc_id, chunk_index, page_number, case when whole > 0 then 'whole' when most > 0 then 'most' when half > 0 then 'half' else 'none' end as kind, case when whole > 0 then whole when most > 0 then most else half end as place, md5(excerpt) as excerpt from x", wide=("place",))
def excerpt_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a chunk stands on its page: in whole, else by its first 70 or 35 percent; blanks and case do not count."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    pages = _pages(spark, sf_dir).select("doc_id", "page_number", flat("text").alias("page"))
    chunks = read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "page_number", flat("text").alias("excerpt")).distinct()
    kind, place = R.excerpt_place(F.col("page"), F.col("excerpt"))
    return chunks.join(pages, ["doc_id", "page_number"]).select("doc_id", "chunk_index", "page_number", kind.alias("kind"), place.alias("place"), F.md5(F.encode("excerpt", "UTF-8")).alias("excerpt"))


@query()
def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of every format that can be written here, and what the parser reads from it: pages,
    signs, and whether all words came back in order."""
    from paperloom.sources import samples

    return samples.round_trip(_pages(spark, sf_dir))


_VERSION = "md5(case when doc_id like '%7' then replace(text, 'e', 'E') else text end)"


@query(f"select doc_id, page_number, {_VERSION} as text from {PAGES}")
def document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of pages in which the documents of one kind of id have been replaced by a new version."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    pages = _pages(spark, sf_dir).select("doc_id", "page_number", "text")
    sinks.replace_documents(pages, path)
    sinks.replace_documents(pages.where("doc_id like '%7'").withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), path)
    return spark.read.parquet(path).select("doc_id", "page_number", F.md5(F.encode("text", "UTF-8")).alias("text"))


@query(f"""with {_ANSWERS}, b as (select answer_id, (chunk_index % 10) / 10.0 as best, case when chunk_index % 11 = 0 then 'I could not find it. ' || answer else answer end as answer from a)
select answer_id, md5(case when starts_with(answer, 'This information is not present') or starts_with(answer, 'I could not find') or starts_with(answer, 'The provided documents do not') then answer when best < 0.30 then 'Based on limited matching in your documents: ' || answer when best < 0.55 then 'Based on the available document excerpts: ' || answer else answer end) as shown,
 (answer = '') or ({sql_any("lower(answer)", W.NOT_FOUND)} and strlen(answer) < 200) or (starts_with(lower(answer), 'this information is not') and strlen(answer) < 250) as not_found from b""")
def shown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers under the phrase their best match calls for; the tens of the chunk number stand for its cosine."""
    answer = F.when(F.col("chunk_index") % 11 == 0, F.concat(F.lit("I could not find it. "), "answer")).otherwise(F.col("answer"))
    rows = _answers(spark, sf_dir).select("answer_id", ((F.col("chunk_index") % 10) / 10.0).alias("best"), answer.alias("answer"))
    shown = A.confidence_prefix(F.col("answer"), F.col("best"))
    return rows.select("answer_id", F.md5(F.encode(shown, "UTF-8")).alias("shown"), A.not_found(F.col("answer")).alias("not_found"))


@query("select strftime(date_trunc('day', extracted_at), '%Y-%m-%d') as day, count(*) as pages from document_pages where extracted_at is not null group by 1")
def pages_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the stream of arriving pages counts, over the whole table."""
    days = ingest.arrivals(read_table(spark, sf_dir, "document_pages").where("extracted_at is not null"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "pages")


@query(f"""with {_TURNS}, l as (select *, lead(role) over w as nr, lead(content) over w as na from m window w as (partition by session_id order by turn)), p as (select session_id, row_number() over (partition by session_id order by turn) as n, content as q, na as r from l where role = 'user' and nr = 'assistant')
select session_id, md5(string_agg('## Question ' || n || chr(10) || chr(10) || q || chr(10) || chr(10) || '### Analysis' || chr(10) || chr(10) || r || chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || '- ' || left(q, 5), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n)) as memo from p group by session_id""")
def session_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memo of each session: its questions and answers in order."""
    w = Window.partitionBy("session_id").orderBy("turn")
    pairs = _turns(spark, sf_dir).withColumn("nr", F.lead("role").over(w)).withColumn("na", F.lead("content").over(w)).where("role = 'user' and nr = 'assistant'")
    turns = pairs.select("session_id", F.row_number().over(w).alias("turn"), F.col("content").alias("question"), F.col("na").alias("answer"), F.array(F.substring("content", 1, 5)).alias("sources"))
    return sinks.memo(turns).select("session_id", F.md5(F.encode("memo", "UTF-8")).alias("memo"))


@query("""with r as (select doc_id, chunk_index, file_name, page_number, text, row_number() over (partition by doc_id order by chunk_index, page_number, text) as n from (select distinct doc_id, chunk_index, file_name, page_number, text from chunks))
select doc_id, n, md5(n || ',"' || replace(file_name, '"', '""') || '",' || page_number || ',' || printf('%.3f', 1.0 / (60 + n)) || ',"' || replace(substring(text, 1, 200), '"', '""') || '"') as line from r""", wide=("n",))
def citation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each file as lines of a citation list."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "page_number", "text"))
    rows = _chunks(spark, sf_dir).withColumn("n", n).select("doc_id", "n", "file_name", "page_number", (1.0 / (60 + F.col("n"))).alias("score"), F.col("text").alias("excerpt"))
    return sinks.citation_lines(rows, keep=("doc_id",)).select("doc_id", "n", F.md5(F.encode("line", "UTF-8")).alias("line"))


@query("""with f as (select doc_id, min(file_name) as file_name from files group by doc_id), j as (select 'in/' || file_name as pdf, 'What is in ' || file_name || '?' as query, case when doc_id like '%3' then 'negative' end as type from f)
select pdf, query, regexp_replace(regexp_extract(pdf, '([^/]*)$', 1), '\\.[^.]*$', '') || ': ' || substring(query, 1, 30) as label, 6 as top_k, coalesce(type, 'standard') as type, 'medium' as difficulty, coalesce(type = 'negative', false) as negative from j""", wide=("top_k",))
def eval_case_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as JSON with most fields left out, and read with their defaults."""
    path = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    f = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.min("file_name").alias("file_name"))
    f.select(F.concat(F.lit("in/"), "file_name").alias("pdf"), F.concat(F.lit("What is in "), "file_name", F.lit("?")).alias("query"), F.when(F.col("doc_id").like("%3"), "negative").alias("type")).write.json(path)
    return cases.with_defaults(spark.read.schema(cases.SCHEMA).json(path)).select("pdf", "query", "label", "top_k", "type", "difficulty", "negative")


@query("select doc_id, text as wide, text as plain from documents where text is not null")
def pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the two kinds of byte strings that PDF files hold, and decoded again."""
    d = read_table(spark, sf_dir, "documents").where("text is not null")
    wide = F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE"))
    return d.select("doc_id", T.pdf_string(wide).alias("wide"), T.pdf_string(F.encode("text", "UTF-8")).alias("plain"))


@query("with t as (select case_id, name, description, created_at from cases) select 'cases' as name, count(*) as n, count(description) as filled from t union all select 'files', (select count(*) from (select distinct doc_id, file_name, case_id from files)), (select count(case_id) from (select distinct doc_id, file_name, case_id from files)) union all select 'settings', 0, 0")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables saved as JSON and loaded again, with one that was never saved."""
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    own = {"cases": read_table(spark, sf_dir, "cases").select("case_id", "name", "description", "created_at"), "files": read_table(spark, sf_dir, "files").select("doc_id", "file_name", "case_id").distinct()}
    cases.save_state(own, path)
    got = cases.load_state(spark, path, {**{k: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema) for k, v in own.items()}, "settings": "key string, value string"})
    row = lambda name, column: got[name].agg(F.count("*").alias("n"), F.count(column).alias("filled")).select(F.lit(name).alias("name"), "n", "filled")
    return row("cases", "description").unionByName(row("files", "case_id")).unionByName(row("settings", "value"))
