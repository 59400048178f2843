"""Queries of table functions and Arrow functions; they have no SQL and are tested against plain Python."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import cleanup, excerpts, questions
from paperloom.plans.answer_queries import _TURNS, _answers, _chunks, _turns
from paperloom.plans.registry import query
from paperloom.plans.text_queries import PAGES, _pages
from paperloom.session import read_table
from paperloom.sources import chunker, formats


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunk_documents(_pages(spark, sf_dir))


@query()
def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.sentences(_pages(spark, sf_dir))


@query()
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of at most 7,000 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, p) for d, t in zip(batch["doc_id"], batch["text"]) for n, p in enumerate(formats.paginate(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text"])

    return read_table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, page_number int, text string")


@query()
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "page_number", excerpts.summarize_udf("text").alias("summary"))


@query()
def best_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of each chunk that answers best what its file's fact sheet sums up."""
    asked = read_table(spark, sf_dir, "files").groupBy("doc_id").agg(F.max_by("fact_sheet.summary", "loaded_at").alias("question"))
    return _chunks(spark, sf_dir).join(asked, "doc_id").select("doc_id", "chunk_index", "page_number", excerpts.best_excerpt_udf("text", "question").alias("excerpt"))


@query()
def question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every sentence of the documents, taken as a question."""
    s = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("n", "q"))
    return s.select("doc_id", "n", F.posexplode(questions.variants_udf("q")).alias("variant_no", "variant"))


_WORDY = "len(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')) >= 2"
_CUTS = ", ".join(f"case when len(string_split(q, '{j}')) between 2 and 4 and len(list_filter(string_split(q, '{j}'), lambda p: not ({_WORDY}))) = 0 then len(string_split(q, '{j}')) else 0 end as n{k}" for k, j in enumerate(questions.JOINTS))


@query(f"""with s as (select doc_id, unnest(string_split(text, '. ')) as x, generate_subscripts(string_split(text, '. '), 1) - 1 as n from documents), t as (select doc_id, n, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\?+$', '') as q from s),
c as (select *, {_CUTS} from t), b as (select doc_id, n, case when greatest(n0, n1, n2) = 0 then [] when n0 = greatest(n0, n1, n2) then string_split(q, ' and ') when n1 = greatest(n0, n1, n2) then string_split(q, ' & ') else string_split(q, ' as well as ') end as parts from c),
f as (select doc_id, n, list_filter(list_transform(parts, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: strlen(p) > 5) as parts from b)
select doc_id, n, generate_subscripts(parts, 1) - 1 as part_no, unnest(parts) as part from f""", wide=("n", "part_no"))
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("n", "q"))
    return s.select("doc_id", "n", F.posexplode(questions.parts(F.col("q"))).alias("part_no", "part"))


@query()
def followup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    before = F.lag("content").over(Window.partitionBy("session_id").orderBy("turn"))
    rows = t.withColumn("before", before).where("role = 'user'")
    # every other question is one that stands by itself
    asked = F.when(F.col("turn") % 4 < 2, F.concat(F.lit("what about "), "content")).otherwise(F.col("content"))
    return rows.select("session_id", "turn", questions.follow_up_udf(asked, "before", "before").alias("question"))


@query(f"""with {_TURNS}, l as (select *, lead(role) over w as nr, lead(content) over w as na from m window w as (partition by session_id order by turn)), p as (select *, row_number() over (partition by session_id order by turn desc) as back from l where role = 'user' and nr = 'assistant')
select session_id, string_agg('<|im_start|>user' || chr(10) || substr(content, 1, 400) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || substr(na, 1, 600) || '<|im_end|>' || chr(10), '' order by turn) as markup from p where back <= 2 group by session_id""")
def history_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.registry_ops import paired_turns

    pairs = paired_turns(_turns(spark, sf_dir), 2)
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "user", "assistant"))), lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant")))
    return pairs.groupBy("session_id").agg(turns.alias("turns")).select("session_id", questions.history_markup(F.col("turns")).alias("markup"))


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a generator may leave them: with a line said twice, a made-up court, a cut file name, hedges, a
    citation over two lines, and a sign-off or an unfinished sentence."""
    a = _answers(spark, sf_dir)
    odd = F.col("chunk_index") % 2 == 0
    cut = F.expr("substring(file_name, 1, greatest(6, length(file_name) - 6))")
    parts = [
        F.lit("It appears that "), "answer", F.lit("\nThe notice must be given in writing within ten days.\nThe notice must be given in writing within ten days."),
        F.lit("\nThe Marlowe County Court decided this in 1999. See ["), cut, F.lit(", p. "), F.col("page_number").cast("string"), F.lit("].\nIt rests on [") , "file_name", F.lit(",\np. 1]."),
        F.when(odd, "\nI hope this helps! Let me know if you have questions.").otherwise("\nThe remaining part of the"),
    ]
    return a.select("answer_id", "source", "file_name", F.concat(*parts).alias("answer"))


@query()
def answer_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made_up, known = F.array(F.lit("Marlowe County")), F.array("file_name")
    return _rough(spark, sf_dir).select("answer_id", cleanup.clean_answer_udf("answer", "source", known, made_up).alias("answer"))


@query()
def answer_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-offs, repeated lines, broken citations and unfinished sentences alone."""
    return _rough(spark, sf_dir).select("answer_id", cleanup.finish_udf("answer").alias("answer"))


@query(f"select doc_id, count(*) as pages, cast(sum(length(text)) as bigint) as size from {PAGES} group by doc_id")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages taken in by a stream that runs until nothing new is there; the totals of what it stored."""
    from paperloom.session import shared_folder
    from paperloom.streaming import ingest

    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    pages = _pages(spark, sf_dir)
    rows = pages.select("doc_id", F.concat(F.lit("/in/"), "doc_id").alias("file_path"), F.sha2("doc_id", 256).alias("content_hash"), "page_number", "text", F.current_timestamp().alias("arrived_at"))
    rows.write.parquet(f"{base}/source")
    ingest.start(spark, f"{base}/source", f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return ingest.current(spark, f"{base}/store", "pages").groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).cast("bigint").alias("size"))
