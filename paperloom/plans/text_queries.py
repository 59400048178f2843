"""Queries of the scalar text functions and the text predicates, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import words as W
from paperloom.operators import classify, extract, jurisdiction
from paperloom.plans.registry import query
from paperloom.session import read_table

PAGES = "(select distinct doc_id, page_number, text from document_pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "document_pages").select("doc_id", "page_number", "text").distinct()


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, {_quote(p)})" for p in phrases) + ")"


def sql_sum(text: str, weights: dict[int, tuple[str, ...]]) -> str:
    return "(" + " + ".join(f"case when contains({text}, {_quote(p)}) then {w} else 0 end" for w, ps in weights.items() for p in ps) + ")"


@query(f"select doc_id, page_number, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') as text from {PAGES}")
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.collapse_blank_lines(F.col("text")).alias("text"))


@query(f"select doc_id, page_number, regexp_replace(text, '-\\n(\\p{{L}})', '\\1', 'g') as text from {PAGES}")
def remove_hyphen_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.remove_hyphen_breaks(F.col("text")).alias("text"))


_PRIVATE = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x9F\\x{E000}-\\x{F8FF}\\x{FFF0}-\\x{10FFFF}]"


@query(f"""
with a as (select doc_id, page_number, translate(replace(text, chr(173), ''), '‘’“”‚„–' || chr(160), '''''"","- ') as t from {PAGES}),
b as (select doc_id, page_number, replace(replace(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st') as t from a),
c as (select doc_id, page_number, regexp_replace(regexp_replace(regexp_replace(t, '{_PRIVATE}', '', 'g'), '[ \\t\\x0B\\f]+', ' ', 'g'), '[\\r\\n]+ ?', chr(10), 'g') as t from b)
select doc_id, page_number, regexp_replace(regexp_replace(regexp_replace(t, '-\\n(\\p{{L}})', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as text from c""")
def clean_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.clean_pdf_text(F.col("text")).alias("text"))


@query(f"""
with a as (select doc_id, page_number, regexp_replace(regexp_replace(translate(text, chr(13) || chr(9), chr(10) || ' '), '[\\x00-\\x09\\x0B-\\x1F\\x7F-\\x9F\\x{{E000}}-\\x{{F8FF}}\\x{{FFF0}}-\\x{{10FFFF}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as t from {PAGES}),
l as (select doc_id, page_number, t, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as i from a),
m as (select *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as y from l),
n as (select *, lag(y, 1) over w as y1, lag(y, 2) over w as y2, lag(y, 3) over w as y3 from m window w as (partition by doc_id, page_number, t order by i)),
k as (select * from n where y = '' or y3 is null or not (y = y1 and y = y2 and y = y3))
select doc_id, page_number, regexp_replace(string_agg(y, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as text from k group by doc_id, page_number, t""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.normalize_text(F.col("text")).alias("text"))


@query(r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g'), '([^\s$])\$', '\1 $', 'g'), ',(\p{L})', ', \1', 'g') as text from documents""")
def recover_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.recover_spaces(F.col("text")).alias("text"))


@query(r"""
with a as (select doc_id, text, strlen(text) as size, length(text) - length(regexp_replace(text, '[\p{L}\p{N}\s!-/:-@\[-`{-~]', '', 'g')) as p, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as l,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as w from documents)
select doc_id, round(case when size = 0 then 0 else p / size * (case when w > 0 and size / w > 3 and size / w < 15 then 1.0 else 0.5 end) * (case when l / size < 0.15 then 0.2 when l / size < 0.25 then 0.6 else 1.0 end) end, 6) as quality from a""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 6).alias("quality"))


@query(f"""
with l as (select doc_id, page_number, text, unnest(string_split(replace(text, ' | ', chr(9)), chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {PAGES})
select doc_id, page_number, string_agg(case when length(x) - length(replace(x, chr(9), '')) >= 2 then '| ' || array_to_string(list_transform(string_split(x, chr(9)), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), ' | ') || ' |' else x end, chr(10) order by i) as text
from l group by doc_id, page_number, text""")
def format_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tabbed = F.replace(F.col("text"), F.lit(" | "), F.lit("\t"))
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.format_tables(tabbed).alias("text"))


@query(
    "select doc_id, page_number, "
    + "regexp_replace(" * len(T.MASKS)
    + "text"
    + "".join(f", '{p}', '{m}', 'g')" for p, m in T.MASKS)
    + f" as text from {PAGES}"
)
def redact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.redact_numbers(F.col("text")).alias("text"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '\s*\[[^\]]{0,200}\]', '', 'g')), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) as key from documents""")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.dedup_key(F.col("text")).alias("key"))


_HEADER_SQL = r"""
select *, case when strlen(line) > 3 and strlen(line) < 80 and ((length(regexp_replace(line, '[^\p{L}]', '', 'g')) > 3 and not regexp_matches(regexp_replace(line, '[^\p{L}]', '', 'g'), '[^\p{Lu}]'))
  or regexp_matches(line, '^(Section|SECTION|Article|ARTICLE) ') or regexp_matches(line, '^[0-9].*\.|^[0-9]\.')) then line end as header
from (select *, regexp_replace(trim(split_part(text, chr(10), 1)), '\r$', '') as line from c)"""


@query(f"with c as (select distinct doc_id, chunk_index, text from chunks), h as ({_HEADER_SQL}) select doc_id, chunk_index, header, text from h")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "text").distinct()
    return chunks.select("doc_id", "chunk_index", T.section_header(F.col("text")).alias("header"), "text")


@query(f"""with c as (select distinct doc_id, chunk_index, file_name, page_number, text from chunks), h as ({_HEADER_SQL})
select doc_id, chunk_index, 'From ' || file_name || ' page ' || page_number || case when header is null then '' else ', section: ' || header end || '. ' || text as text from h""")
def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "file_name", "page_number", "text").distinct()
    head = T.section_header(F.col("text"))
    named = F.concat(F.lit("From "), "file_name", F.lit(" page "), F.col("page_number").cast("string"), F.when(head.isNull(), "").otherwise(F.concat(F.lit(", section: "), head)), F.lit(". "), "text")
    return chunks.select("doc_id", "chunk_index", named.alias("text"))


@query(f"""
with l as (select doc_id, page_number, text, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {PAGES}),
k as (select *, (x <> '' and not regexp_matches(x, '^[_\\-=.]+$') and not (regexp_matches(x, '^[Pp]age ') and strlen(x) < 15) and not (strlen(x) > 5 and not regexp_matches(x, '[\\p{{L}}\\p{{N}}]') and len(list_distinct(string_split(x, ''))) <= 2)) as keep from l)
select doc_id, page_number, coalesce(string_agg(x, chr(10) order by i) filter (where keep), '') as text from k group by doc_id, page_number, text""")
def compress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "page_number", T.compress_lines(F.col("text")).alias("text"))


@query(r"""
select doc_id, case when length(text) <= 400 then text when contains(substr(text, 1, 400), '. ') then regexp_extract(substr(text, 1, 400), '(?s)^(.*)\. ', 1) || '.'
  when contains(substr(text, 1, 400), ' ') then regexp_extract(substr(text, 1, 400), '(?s)^(.*) ', 1) || '...' else substr(text, 1, 400) || '...' end as text from documents""")
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", T.truncate_to_budget(F.col("text"), 400).alias("text"))


@query(r"""
with c as (select distinct doc_id, chunk_index, text, length(text) as n, length(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FFF0}-\x{10FFFF}]', '', 'g')) as p, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as l from chunks)
select doc_id, chunk_index, n = 0 or (p / n >= 0.2 and not (l / n < 0.15 and n > 20)) as kept, round(l / n, 6) as letters from c""")
def chunk_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    letters = T.letter_ratio(text)
    good = (n == 0) | ((T.printable_ratio(text) >= 0.2) & ~((letters < 0.15) & (n > 20)))
    return read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "text").distinct().select("doc_id", "chunk_index", good.alias("kept"), F.round(letters, 6).alias("letters"))


@query(f"""
with p as (select doc_id, length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) as l, length(text) - length(regexp_replace(text, '\\S', '', 'g')) as s from {PAGES}),
f as (select distinct doc_id from files where lower(file_name) like '%.pdf')
select doc_id, cast(sum(l) as bigint) as letters, cast(sum(s) as bigint) as visible, sum(s) >= 20 and sum(l) / sum(s) < 0.4 as garbled from p where doc_id in (select doc_id from f) group by doc_id""")
def garbled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = read_table(spark, sf_dir, "files").where(F.lower("file_name").endswith(".pdf")).select("doc_id").distinct()
    sums = (
        _pages(spark, sf_dir)
        .join(pdf, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.sum(T.count_matches(F.col("text"), r"\p{L}")).cast("bigint").alias("letters"), F.sum(T.count_matches(F.col("text"), r"\S")).cast("bigint").alias("visible"))
    )
    return sums.select("doc_id", "letters", "visible", ((F.col("visible") >= 20) & (F.col("letters") / F.col("visible") < 0.4)).alias("garbled"))


# --- predicates -------------------------------------------------------------------------------


def _route_sql() -> str:
    clean = r"regexp_replace(q, '[!-/:-@\[-`{-~]+$', '')"
    greet = ", ".join(map(_quote, W.GREETINGS))
    prefix = " or ".join(f"starts_with(q, {_quote(p)})" for p in W.KNOWLEDGE_PREFIXES)
    return f"""
with s as (select doc_id, lower(trim(unnest(string_split(text, '. ')))) as q, generate_subscripts(string_split(text, '. '), 1) as n from documents)
select doc_id, n as sentence, {clean} = '' or (len(list_filter(regexp_split_to_array({clean}, '\\s+'), lambda x: x <> '')) <= 2 and {clean} in ({greet})) or {sql_any("q", W.GREETING_PHRASES)} or {sql_any("q", W.OFF_TOPIC)} as not_about_documents,
  ({prefix}) or (q like '%?' and not {sql_any("q", W.DOCUMENT_WORDS)}) as general_knowledge, {sql_any("q", W.FORM_WORDS)} as about_forms,
  ({sql_any("q", W.IDENTITY_SIGNALS)} and {sql_any("q", W.PARTY_ROLES)}) or {sql_any("q", W.ANY_PARTIES)} as about_parties
from s"""


@query(_route_sql())
def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document, routed as if it were a question."""
    docs = read_table(spark, sf_dir, "documents")
    s = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("n", "q")).select("doc_id", (F.col("n") + 1).cast("bigint").alias("sentence"), "q")
    q = F.col("q")
    return s.select(
        "doc_id", "sentence", classify.not_about_documents(q).alias("not_about_documents"), classify.general_knowledge(q).alias("general_knowledge"),
        classify.about_forms(q).alias("about_forms"), classify.about_parties(q).alias("about_parties"),
    )


@query(f"""
with c as (select distinct doc_id, chunk_index, text from chunks)
select doc_id, chunk_index, text, {sql_any("lower(text)", W.CAPTION_ROLES)} and len(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), lambda x: strlen(x) >= 3 and not regexp_matches(x, '[^\\p{{Lu}}]') and x not in ({", ".join(map(_quote, W.CAPTION_BOILERPLATE))}))) > 0 as caption from c""")
def caption_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select("doc_id", "chunk_index", "text").distinct()
    return chunks.select("doc_id", "chunk_index", "text", classify.caption(F.col("text")).alias("caption"))


_FIRST_PAGES = f"(select doc_id, string_agg(text, chr(10) order by page_number, text) as t from {PAGES} where page_number <= 3 group by doc_id)"


@query(f"""
with f as (select doc_id, min(file_name) as file_name from files group by doc_id),
s as (select doc_id, lower(t) as t, regexp_extract(lower(file_name), '\\.([^.]*)$', 1) as ext from {_FIRST_PAGES} join f using (doc_id)),
p as (select doc_id, {sql_sum("t", W.EVIDENCE)} + case when ext in ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif', 'gif') then 2 else 0 end as e, {sql_sum("t", W.AUTHORITY)} as a, {sql_sum("t", W.REFERENCE)} + case when ext in ('html', 'eml') then 1 else 0 end as r from s)
select doc_id, cast(e as int) as evidence, cast(a as int) as authority, cast(r as int) as reference, case when greatest(e, a, r) < 3 then 'ClientDocument' when r >= greatest(e, a) then 'Reference' when a >= e then 'LegalAuthority' else 'Evidence' end as role from p""")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.document_roles(_pages(spark, sf_dir), read_table(spark, sf_dir, "files"))


@query(jurisdiction.oracle(_FIRST_PAGES))
def jurisdiction_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jurisdiction.detect(_pages(spark, sf_dir).where("page_number <= 3"))


# --- extraction -------------------------------------------------------------------------------


@query(f"""select doc_id, page_number, unnest(regexp_extract_all(text, '{extract.DATE}')) as date, generate_subscripts(regexp_extract_all(text, '{extract.DATE}'), 1) as n from {PAGES}""")
def fact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.all_matches(_pages(spark, sf_dir), extract.DATE, "date")


@query(f"""select doc_id, page_number, unnest(regexp_extract_all(text, '{extract.AMOUNT}')) as amount, generate_subscripts(regexp_extract_all(text, '{extract.AMOUNT}'), 1) as n from {PAGES}""")
def fact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.all_matches(_pages(spark, sf_dir), extract.AMOUNT, "amount")


@query(f"""
with l as (select doc_id, page_number, text, unnest(regexp_extract_all(text, '{extract.AMOUNT}')) as x, generate_subscripts(regexp_extract_all(text, '{extract.AMOUNT}'), 1) as i from {PAGES}),
k as (select *, lag(x) over (partition by doc_id, page_number, text order by i) as before from l)
select doc_id, page_number, text, string_agg(x, '; ' order by i) as amounts from k where before is null or before <> x group by doc_id, page_number, text""")
def fact_sheet_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a page in order, without repeats that stand next to each other."""
    found = F.regexp_extract_all("text", F.lit(extract.AMOUNT), F.lit(0))
    kept = F.array_join(extract.without_adjacent_repeats(found), "; ")
    return _pages(spark, sf_dir).where(F.size(found) > 0).select("doc_id", "page_number", "text", kept.alias("amounts"))


@query(f"""
with l as (select doc_id, page_number, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), '')))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line from {PAGES})
select doc_id, page_number, line, x as clause from l where strlen(x) > 3 and strlen(x) < 80 and (regexp_matches(x, '{extract.CLAUSE}') or (length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) > 3 and not regexp_matches(regexp_replace(x, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Lu}}]')))""")
def key_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.clause_lines(_pages(spark, sf_dir))


@query(r"""
with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2)) as t from documents)
select doc_id, count(*) as tokens, count(distinct t) as distinct_tokens from w group by doc_id""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    out = read_table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"))
    return out.where("tokens > 0")


def _keyword_sql() -> str:
    stop = ", ".join(map(_quote, W.QUESTION_STOP))
    pairs = sorted({(k, v) for k, vs in W.SYNONYMS.items() for v in vs} | {(v, k) for k, vs in W.SYNONYMS.items() for v in vs})
    rows = ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in pairs)
    return f"""
with k as (select distinct doc_id, w from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as w from documents) where strlen(w) >= 3 and w not in ({stop})),
s(a, b) as (values {rows})
select doc_id, w from k union select doc_id, b as w from k join s on w = a"""


@query(_keyword_sql())
def expand_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of every document with their synonyms, in both directions, one hop."""
    docs = read_table(spark, sf_dir, "documents")
    base = docs.select("doc_id", F.explode(T.keyword_set(F.col("text"), W.QUESTION_STOP, 3)).alias("w"))
    return base.unionByName(base.join(F.broadcast(classify.synonym_table(spark)), F.col("w") == F.col("a")).select("doc_id", F.col("b").alias("w"))).distinct()


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: T.dedup_key(x)), lambda x: x != "")


@query(r"""
with l as (select doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(unnest(string_split(text, chr(10))), '\s*\[[^\]]{0,200}\]', '', 'g')), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) as x from documents)
select doc_id, round(1 - count(distinct x) / count(*), 6) as repetition from l where x <> '' group by doc_id""")
def repetition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's lines that repeat an earlier line."""
    lines = _lines(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").where(F.size(lines) > 0)
    return docs.select("doc_id", F.round(1 - F.size(F.array_distinct(lines)) / F.size(lines), 6).alias("repetition"))
