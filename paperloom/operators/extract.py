"""Extraction of facts from pages by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of dates, amounts, clause headings and named parties.
DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
AMOUNT = r"\$[\d,]+(?:\.\d{2})?"
CLAUSE = r"^(?:Section\s+\d+[.:]\s*|Article\s+[IVX\d]+[.:]\s*|ARTICLE\s+[IVX\d]+[.:]\s*|\d+\.\d+\s+).{5,80}$"
TITLED = r"(?i)(landlord|tenant|buyer|seller|employer|employee|plaintiff|defendant|licensor|licensee|borrower|lender|lessor|lessee)\s*:\s*([A-Z][a-zA-Z\s.]+?)(?:\n|,|\()"
BETWEEN = r"(?i)between\s+([A-Z][a-zA-Z\s.]+?)\s+(?:\(.*?\)\s+)?and\s+([A-Z][a-zA-Z\s.]+?)(?:\s*\(|\s*,|\s*\.)"
PARTY_BETWEEN = r"(?i)(?:between|by and between)\s+([A-Z][a-zA-Z\s,.]+?)(?:\s+\(|,\s+a\s+|,\s+an\s+|\s+and\s+)"
PARTY_TITLED = r"(?i)(landlord|tenant|buyer|seller|employer|employee|licensor|licensee|borrower|lender|plaintiff|defendant|lessor|lessee)\s*:\s*([A-Z][a-zA-Z\s.]+)"
CLAUSE_LINE = r"(?m)^(?:Section\s+\d+[.:]\s*|Article\s+[IVX\d]+[.:]\s*|ARTICLE\s+[IVX\d]+[.:]\s*|\d+\.\d+\s+)(.{5,80})$"


def all_matches(pages: DataFrame, pattern: str, name: str) -> DataFrame:
    """doc_id, page_number, the matches of a pattern and their numbers on the page from 1."""
    found = pages.select("doc_id", "page_number", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n", name))
    return found.select("doc_id", "page_number", name, (F.col("n") + 1).cast("bigint").alias("n"))


def without_adjacent_repeats(values: Column) -> Column:
    return F.transform(F.array(values), lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))[0]


def clause_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line, clause: headings of clauses and lines in capitals."""
    line = F.transform(F.split("text", "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))))
    rows = pages.select("doc_id", "page_number", F.posexplode(line).alias("n", "clause"))
    c = F.col("clause")
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    kept = (F.octet_length(c) > 3) & (F.octet_length(c) < 80) & (c.rlike(CLAUSE) | ((F.length(letters) > 3) & ~letters.rlike(r"[^\p{Lu}]")))
    return rows.where(kept).select("doc_id", "page_number", (F.col("n") + 1).cast("bigint").alias("line"), "clause")


def tidy(name: Column) -> Column:
    """A name without the blanks around it."""
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def role_entities(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, role, name, mentions of "role: name" on a page; a name ends at a comma, bracket or line end."""
    found = pages.select("doc_id", "page_number", F.explode(F.regexp_extract_all("text", F.lit(TITLED), F.lit(0))).alias("x"))
    named = found.select("doc_id", "page_number", F.lower(F.regexp_extract("x", TITLED, 1)).alias("role"), tidy(F.regexp_extract("x", TITLED, 2)).alias("name"))
    return named.where(F.octet_length("name").between(3, 59)).groupBy("doc_id", "page_number", "role", "name").agg(F.count("*").alias("mentions"))


def between_entities(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, name of the two sides of each "between X and Y" on a page."""
    found = pages.select("doc_id", "page_number", F.explode(F.regexp_extract_all("text", F.lit(BETWEEN), F.lit(0))).alias("x"))
    sides = found.select("doc_id", "page_number", F.explode(F.array(*[tidy(F.regexp_extract("x", BETWEEN, k)) for k in (1, 2)])).alias("name"))
    return sides.where(F.octet_length("name").between(3, 59)).distinct()


def fact_sheets(pages: DataFrame, most_clauses: int = 15, summary: int = 200) -> DataFrame:
    """doc_id, page_number, parties, dates, amounts, key_clauses, summary of each page's text.

    Repeats that follow each other directly count once; of the clauses the first `most_clauses` are kept, headings
    before lines in capitals. A document's sheet is that of its pages, one after the other.
    """
    matched = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    named = F.zip_with(matched(PARTY_TITLED, 1), matched(PARTY_TITLED, 2), lambda role, name: F.concat(role, F.lit(": "), tidy(name)))
    parties = F.concat(F.transform(matched(PARTY_BETWEEN, 1), tidy), named)
    lines = F.transform(F.split("text", r"\r?\n"), tidy)
    letters = lambda x: F.regexp_replace(x, r"[^\p{L}]", "")
    capitals = F.filter(lines, lambda x: F.octet_length(x).between(4, 79) & (F.length(letters(x)) > 3) & ~letters(x).rlike(r"[^\p{Lu}]"))
    clauses = F.concat(F.transform(matched(CLAUSE_LINE, 1), tidy), capitals)
    once = lambda values: F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))
    rows = pages.select("doc_id", "page_number", "text", parties.alias("p"), matched(DATE, 0).alias("d"), matched(AMOUNT, 0).alias("a"), clauses.alias("c"))
    return rows.select("doc_id", "page_number", once(F.col("p")).alias("parties"), once(F.col("d")).alias("dates"), once(F.col("a")).alias("amounts"), F.slice(once(F.col("c")), 1, most_clauses).alias("key_clauses"), tidy(F.substring("text", 1, summary)).alias("summary"))


def fact_lists(texts: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """doc_id, dates, amounts, terms: the first 8 different dates and amounts, and the first 10 legal terms, of a text."""
    first = lambda pattern: F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), 1, 8)
    held = F.filter(F.array(*map(F.lit, terms)), lambda t: F.lower("text").contains(t))
    return texts.select("doc_id", first(DATE).alias("dates"), first(AMOUNT).alias("amounts"), F.slice(held, 1, 10).alias("terms"))
