"""Checks, confidence and grades of answers with citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import words as W
from paperloom.functions.text import any_of, keyword_set

# The forms of a citation, a claim and its tokens.
CITED = r"\[([^,\[\]]+),\s*p\.\s*(\d+)\]"
BRACKET = r"\[[^\[\]]{2,}\]"
CLAIM = r"(?:^|[.!?]\s+)([A-Z][^.!?]*(?:\d[\d,./%$]+|[A-Z][a-z]{2,})[^.!?]*[.!?])"
TOKEN = r"\d[\d,./%$]+|[A-Z][a-z]{2,}"
NOTE = r"\s*\[[^\]]*\]"
NEGATION = r"\b(no|not|never|none|cannot|shall not|must not|may not)\b"
STATUTE = r"\d+\s+(?:U\.?S\.?C\.?|C\.?F\.?R\.?)\s*§\s*\d+"
# What answers may make up, as (kind, form, group of the name).
NAMED = (
    ("court", r"(?i)(?:Superior|District|Circuit|Supreme|Municipal|Family|Probate|Bankruptcy|Appellate|County)\s+Court\s+of\s+(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})", 0),
    ("county", r"County\s+of\s+(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})", 0),
    ("case number", r"(?i)(?:Case|Docket|Civil Action)\s+No\.\s*[\w-]+", 0),
    ("party", r"(?i)(?:the\s+)?(?:plaintiff|defendant|petitioner|respondent|appellant|appellee)(?:'s?\s+|\s+)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 1),
)


def brackets(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(BRACKET), F.lit(0))


def citations(answers: DataFrame) -> DataFrame:
    """answer_id, cited_file, cited_page of every well-formed citation."""
    one = answers.select("answer_id", F.explode(F.regexp_extract_all("answer", F.lit(CITED), F.lit(0))).alias("c"))
    return one.select("answer_id", F.trim(F.regexp_extract("c", CITED, 1)).alias("cited_file"), F.regexp_extract("c", CITED, 2).cast("bigint").alias("cited_page"))


def page_violations(answers: DataFrame, files: DataFrame) -> DataFrame:
    """Citations of a page beyond the last of a known file."""
    pages = files.groupBy("file_name").agg(F.max("total_pages").cast("bigint").alias("total_pages"))
    return citations(answers).join(pages, F.col("cited_file") == F.col("file_name")).where("cited_page > total_pages").select("answer_id", "cited_file", "cited_page", "total_pages")


def count_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.contains(p), 1).otherwise(0) for p in phrases])


def confidence(answer: Column, source: Column) -> Column:
    """0 to 1 by hedging, citations, grounding in the sources and length."""
    low = F.lower(answer)
    cites = F.size(F.regexp_extract_all(answer, F.lit(r"(, p\.)"), F.lit(1)))
    sentences = F.split(answer, r"\. ")
    cited = F.size(F.filter(sentences, lambda x: x.contains("[") & x.contains(", p.")))
    share = cited / F.size(sentences)
    long = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda x: F.octet_length(x) > 3))
    grounded = F.size(F.filter(long, lambda x: F.lower(source).contains(x))) / F.size(long)
    value = (
        F.lit(1.0)
        - 0.05 * count_of(low, W.HEDGES)
        + F.when(cites == 0, -0.25).when(cites == 1, -0.05).when(cites <= 4, 0.05).otherwise(0.10)
        + F.when(F.size(sentences) > 2, F.when(share < 0.3, -0.15).when(share > 0.6, 0.05).otherwise(0.0)).otherwise(0.0)
        - F.when((F.size(long) > 0) & source.isNotNull() & (grounded < 0.5), 0.20).otherwise(0.0)
        - F.when(F.octet_length(answer) < 50, 0.1).otherwise(0.0)
        - F.when(any_of(low, ("not present in the provided", "not found in the")), 0.15).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def claims(answer: Column) -> Column:
    """Sentences with a number or a name, without their citations, of 15 bytes or more."""
    found = F.regexp_extract_all(answer, F.lit(CLAIM), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, NOTE, ""))), lambda x: F.octet_length(x) >= 15)


def grounded_share(claim: Column, source: Column) -> Column:
    found = F.regexp_extract_all(claim, F.lit(TOKEN), F.lit(0))
    return F.size(F.filter(found, lambda t: source.contains(t))) / F.size(found)


def grade_grounding(answer: Column, source: Column) -> Column:
    """Percent of claims of which all tokens stand in the sources; 100 without claims."""
    made = F.filter(claims(answer), lambda c: F.size(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))) > 0)
    good = F.filter(made, lambda c: F.forall(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: source.contains(t)))
    return F.when(F.size(made) == 0, 100.0).otherwise(F.size(good) / F.size(made) * 100)


def grade_retrieval(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).when(rank == 1, 100.0).when(rank == 2, 75.0).when(rank == 3, 50.0).when(rank == 4, 25.0).otherwise(10.0)


def grade_completeness(answer: Column, expected: Column) -> Column:
    low = F.lower(answer)
    found = F.size(F.filter(expected, lambda t: low.contains(F.lower(t))))
    return F.when(expected.isNull() | (F.size(expected) == 0), 100.0).otherwise(found / F.size(expected) * 100)


def grade_efficiency(answer: Column, mode: str) -> Column:
    low = F.lower(answer)
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda x: x != ""))
    score = 100.0 - F.least(F.lit(30), 5 * count_of(low, W.GRADED_HEDGES)) - F.least(F.lit(30), 10 * count_of(low, W.FILLERS))
    if mode == "extended":
        score = score - F.least(F.lit(30), 10 * (4 - count_of(low, ("answer", "key provisions", "analysis", "caveats"))))
    return F.greatest(F.lit(0.0), score - F.when(words > (300 if mode == "quick" else 800), 20).otherwise(0))


def overall(retrieval: Column, grounding: Column, cites: Column, complete: Column, efficient: Column) -> Column:
    return retrieval * 0.25 + grounding * 0.30 + cites * 0.15 + complete * 0.20 + efficient * 0.10


def letter(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def attribution(answers: DataFrame, source_words: DataFrame, threshold: float = 0.30) -> DataFrame:
    """answer_id, n, cited_file, share, wrong: for each sentence and file it cites, the share of its key words that
    the file holds; a citation is wrong if that is less than the threshold.

    source_words: cited_file, word, distinct, lower case. Words are joined by file and word, so no file's text is
    gathered. Sentences without key words and files without words are not judged.
    """
    sentences = answers.select("answer_id", F.posexplode(F.split(F.regexp_replace("answer", r", p\.\s+", ", p."), r"\. ")).alias("n", "sentence"))
    cited = sentences.select("answer_id", (F.col("n") + 1).alias("n"), "sentence", F.explode(F.regexp_extract_all("sentence", F.lit(CITED), F.lit(0))).alias("c"))
    cited = cited.select("answer_id", "n", "sentence", F.trim(F.regexp_extract("c", CITED, 1)).alias("cited_file")).distinct()
    words = cited.select("answer_id", "n", "cited_file", F.explode(keyword_set(F.regexp_replace("sentence", NOTE, ""), W.CLAIM_STOP, 4)).alias("word"))
    words = words.join(source_words.select("cited_file").distinct(), "cited_file", "left_semi")
    share = F.avg(F.col("held").isNotNull().cast("double"))
    met = words.join(source_words.select("cited_file", "word", F.lit(1).alias("held")), ["cited_file", "word"], "left")
    return met.groupBy("answer_id", "n", "cited_file").agg(share.alias("s")).select("answer_id", "n", "cited_file", F.round("s", 6).alias("share"), (F.col("s") < threshold).alias("wrong"))


def fabricated(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, kind, name of the courts, counties, case numbers and parties in answers that no source of their
    document names, in any case.

    answers: answer_id, doc_id, answer. sources: doc_id, text. Names are few and short; they meet the texts of
    their document one by one, so no text is gathered.
    """
    found = None
    for kind, pattern, group in NAMED:
        one = answers.select("answer_id", "doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("answer", F.lit(pattern), F.lit(group))).alias("name"))
        found = one if found is None else found.unionByName(one)
    found = found.where(F.octet_length("name") >= 4).distinct()
    held = found.select("doc_id", "name").distinct().join(sources, "doc_id").where(F.lower("text").contains(F.lower("name"))).select("doc_id", "name").distinct()
    return found.join(held, ["doc_id", "name"], "left_anti").select("answer_id", "kind", "name")


def strong_claims(answers: DataFrame, held: DataFrame, threshold: float = 0.5) -> DataFrame:
    """answer_id, claim, kind, share, supported of sentences with a strong qualifier, or with a denial of a legal
    matter, and the share of their key words that the sources have.

    answers: answer_id, doc_id, own (hash of the text the answer is made from, which is no source), answer. held:
    doc_id, word, n (texts that have it), h (hash of one of them).
    """
    made = F.filter(F.transform(F.regexp_extract_all("answer", F.lit(r"[^.!?\n]+[.!?]"), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, NOTE, ""))), lambda x: F.octet_length(x) >= 15)
    rows = answers.select("answer_id", "doc_id", "own", F.explode(F.array_distinct(made)).alias("claim"))
    low = F.lower("claim")
    kind = F.when(any_of(low, W.QUALIFIERS), "qualifier").when(low.rlike(NEGATION) & any_of(low, W.LEGAL_TERMS), "negation")
    words = rows.withColumn("kind", kind).where("kind is not null").withColumn("word", F.explode(keyword_set(F.col("claim"), W.CLAIM_STOP, 4)))
    met = words.join(held, ["doc_id", "word"], "left")
    share = F.avg(F.when((F.col("n") > 1) | (F.col("h") != F.col("own")), 1.0).otherwise(0.0))
    return met.groupBy("answer_id", "claim", "kind").agg(F.round(share, 6).alias("share"), (share >= threshold).alias("supported"))


def not_found(answer: Column) -> Column:
    low, size = F.lower(answer), F.octet_length(answer)
    return (answer == "") | (any_of(low, W.NOT_FOUND) & (size < 200)) | (low.startswith("this information is not") & (size < 250))


def confidence_prefix(answer: Column, best_cosine: Column) -> Column:
    """A qualifying phrase before answers that rest on weak matches, unless they say that nothing was found."""
    given_up = answer.startswith("This information is not present") | answer.startswith("I could not find") | answer.startswith("The provided documents do not")
    weak, fair = "Based on limited matching in your documents: ", "Based on the available document excerpts: "
    return F.when(given_up, answer).when(best_cosine < 0.30, F.concat(F.lit(weak), answer)).when(best_cosine < 0.55, F.concat(F.lit(fair), answer)).otherwise(answer)


def graded_confidence(confidence: Column, grade: Column) -> Column:
    """0.6 of the grade (0 to 100) and 0.4 of the heuristic confidence."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * grade / 100 + 0.4 * confidence))
