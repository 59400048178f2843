"""Text functions on seed strings and against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import cleanup, excerpts, questions
from paperloom.functions import text as T
from paperloom.operators import classify, jurisdiction
from paperloom.sources import chunker


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_cleaning(spark):
    assert one(spark, T.remove_hyphen_breaks, "agree-\nment", "-\n - item", None, "") == ["agreement", "-\n - item", None, ""]
    assert one(spark, T.collapse_blank_lines, "a\n\n\n\nb") == ["a\n\nb"]
    assert one(spark, T.clean_pdf_text, "ﬁrst – “x” y") == ['first - "x" y']
    assert one(spark, T.normalize_text, "a\r\nb\tc\n\n\n\n d ", "x\nx\nx\nx\nx\ny") == ["a\n\nb c\n\nd", "x\nx\nx\ny"]
    assert one(spark, T.recover_spaces, "EagleRow18Oak,x a$5") == ["Eagle Row18 Oak, x a $5"]
    assert one(spark, T.format_tables, "a\tb\tc\nd\te") == ["| a | b | c |\nd\te"]
    assert one(spark, T.redact_numbers, "123-45-6789 12-3456789 4111 1111 1111 1111 123456789") == ["***-**-**** **-******* **** **** **** **** *********"]


def test_tokens_count_bytes(spark):
    assert one(spark, T.tokens, "É a bb, C3-PO", "", None) == [["é", "bb", "c3", "po"], [], None]


def test_headers_and_budget(spark):
    assert one(spark, T.section_header, "RECITALS\nx", "Section 4\n", "1.2 Term", "The rent", "") == ["RECITALS", "Section 4", "1.2 Term", None, None]
    assert one(spark, lambda c: T.truncate_to_budget(c, 12), "One. Two three", "abc def ghijk", "abcdefghijklmnop", "short") == ["One.", "abc def...", "abcdefghijkl...", "short"]
    assert one(spark, T.compress_lines, "a  b\n\n-----\nPage 3\n*=*=*=*\n10101") == ["a b\n10101"]
    assert one(spark, T.text_quality, "", "plain words of a text")[0] == 0.0


def test_routing(spark):
    q = ("hello", "hiring", "notice", "test", "Summarize this", "What's the weather today?", "")
    assert one(spark, classify.not_about_documents, *q) == [True, False, False, True, False, True, True]
    assert one(spark, classify.simple_greeting, "Hi!", "hi there friend") == [True, False]
    assert one(spark, classify.general_knowledge, "what is a tort?", "Does the lease end?", "rent") == [True, False, False]
    assert one(spark, classify.about_parties, "Who is the landlord?", "the landlord", "parties to the deal") == [True, False, True]
    assert one(spark, classify.caption, "Plaintiff ACME sues", "the plaintiff sues", "COURT of the plaintiff") == [True, False, False]


def test_jurisdiction(spark):
    found, _ = jurisdiction.detect_columns(F.col("t"))
    df = spark.createDataFrame([("42 U.S.C. § 2000e",), ("The EEOC investigates",), ("Cal. Civ. Code § 1942.5",), ("x" * 10_001 + " 42 U.S.C. § 1",), ("",)], "t string")
    got = [r["level"] for r in df.select(found["level"].alias("level")).collect()]
    assert got == ["federal", None, "state", None, None]


def test_questions():
    assert questions.variants("hello there")[:1] == ["hello there"]
    assert any("lessor" in v for v in questions.variants("Who is the landlord?"))
    assert questions.parts_of("what are the terms and who are the parties?") == ["what are the terms", "who are the parties"]
    assert questions.parts_of("rent and fee") == []
    assert questions.follow_up("What about the penalty?", "What is the rent?", "The rent is due.").startswith("What about the penalty? (regarding: rent")
    assert questions.follow_up("What is the rent?", None, None) == "What is the rent?"
    assert len(questions.variants("contract and tenant and landlord and buyer and seller ok")) <= 6
    assert questions.ranking_terms("rent rent")[:2] == ["rent", "rent"]


def test_cleanup():
    assert cleanup.repair_citations("see [a.pdf, p. 3 and [b.pdf, p. 12]") == "see [a.pdf, p. 3] and [b.pdf, p. 12]"
    assert cleanup.repair_citations(cleanup.repair_citations("[[a, p. 1]]")) == "[a, p. 1]"
    assert cleanup.drop_hedges("It appears that rent is due.") == "Rent is due."
    assert cleanup.drop_echoed_labels("Conclusion: the rent is due.") == "The rent is due."
    assert cleanup.drop_empty_bullets("- Age:\n- Rent: 5") == "- Rent: 5"
    assert cleanup.right_file_names("[Lease Agr, p. 2]", ["Lease Agreement.pdf"]) == "[Lease Agreement.pdf, p. 2]"
    assert cleanup.whole_sentences("A long enough first sentence here. tail [x") == "A long enough first sentence here."
    assert cleanup.keep_grounded("Rent is 1,850 due. Paid to Zorblax Quux.", "the rent is 1,850") == "Rent is 1,850 due."
    assert cleanup.keep_grounded("Zorblax Quux.", "nothing") == "Zorblax Quux."
    assert cleanup.join_citations("text [Offer\npdf, p.\n1].") == "text [Offer pdf, p. 1]."
    assert cleanup.drop_sign_off("The rent is 5. I hope this helps!") == "The rent is 5"
    line = "The monthly rent of the premises is one thousand dollars"
    assert cleanup.collapse_repetitions(f"{line} [a, p. 1]\n{line} [b, p. 2]") == f"{line} [a, p. 1]"


def test_excerpts():
    assert excerpts.summarize("a|b|c\nd|e|f").startswith("Table (2 rows)")
    assert excerpts.summarize("TERM AND TERMINATION\nThe term is long.") == "Term And Termination"
    assert excerpts.summarize("") == ""
    text = "The weather was fine that day. The monthly rent is 1,850 dollars. Pets are not allowed here."
    assert "monthly rent" in excerpts.best_excerpt(text, "What is the rent?")
    assert excerpts.sentences("Mr. Smith paid Inc. No. 5 today. Then left the place.") == ["Mr. Smith paid Inc. No. 5 today.", "Then left the place."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \nA1é", max_size=400), st.integers(20, 90))
def test_chunks_hold_everything(text, most):
    chunks = chunker.page_chunks(text, most, most // 4)
    assert "".join(text.split()) in "".join("".join(c[0].split()) for c in chunks) or all(re.sub(r"\s", "", p) in re.sub(r"\s", "", "".join(c[0] for c in chunks)) for p, _ in chunker.fragments(text))
    assert chunks == chunker.page_chunks(text, most, most // 4)


def test_chunk_headers_and_runts(spark):
    assert chunker.is_heading("1. Term") and chunker.is_heading("ARTICLE 5") and not chunker.is_heading("The rent is due.")
    pages = spark.createDataFrame([("d", 1, "RECITALS\n" + "The tenant pays the rent every month without delay. " * 30), ("d", 2, "short"), ("e", 1, None), ("f", 1, "tiny")], "doc_id string, page_number int, text string")
    rows = {(r["doc_id"], r["chunk_index"]): r for r in chunker.chunk_documents(pages).collect()}
    assert rows["d", 0]["text"].startswith("RECITALS\n The tenant")
    assert rows["d", max(k[1] for k in rows if k[0] == "d")]["text"].endswith(" short")
    assert [k for k in rows if k[0] == "f"] == [("f", 0)] and not [k for k in rows if k[0] == "e"]
    assert all(r["token_count"] == max(1, len(r["text"].encode()) // 3) for r in rows.values())


@pytest.mark.parametrize("text", ["", "é" * 7001, "line\n" * 4000])
def test_pages_are_small_and_whole(text):
    from paperloom.sources.formats import paginate

    pages = paginate(text)
    assert all(len(p.encode()) <= 7000 for p in pages)
    assert "".join("".join(p.split()) for p in pages) == "".join(text.split())
