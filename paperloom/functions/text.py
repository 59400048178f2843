"""Scalar text functions as column expressions: cleaning, predicates, headers, masks.

All are null for a null text. Limits that the semantics state in bytes are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that PDF fonts put in place of plain ones.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SINGLES = {"‘": "'", "’": "'", "“": '"', "”": '"', "‚": ",", "„": '"', "–": "-", " ": " "}
UNPRINTABLE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\x{E000}-\x{F8FF}\x{FFF0}-\x{10FFFF}]"
CITATION = r"\s*\[[^\]]{0,200}\]"
EDGE = r"^\s+|\s+$"


def collapse_blank_lines(text: Column) -> Column:
    """Runs of three line ends or more become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def remove_hyphen_breaks(text: Column) -> Column:
    """Join words that a hyphen and a line end divide; only before a letter."""
    return F.regexp_replace(text, r"-\n(\p{L})", "$1")


def strip_edges(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def clean_pdf_text(text: Column) -> Column:
    """Plain spelling of ligatures, quotes, dashes and blanks; control and private characters are dropped."""
    out = F.replace(text, F.lit("­"), F.lit(""))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "".join(SINGLES), "".join(SINGLES.values()))
    out = F.regexp_replace(out, UNPRINTABLE.replace(r"\x0B-\x1F", r"\x0E-\x1F"), "")
    out = F.regexp_replace(out, r"[ \t\x0B\f]+", " ")
    out = F.regexp_replace(out, r"[\r\n]+ ?", "\n")
    return strip_edges(collapse_blank_lines(remove_hyphen_breaks(out)))


def normalize_text(text: Column, most: int = 2_000_000) -> Column:
    """Line ends and tabs made plain, unprintable characters dropped, at most two line ends in a run,
    lines trimmed, and of equal lines in a row no more than three kept."""
    out = F.translate(F.substring(text, 1, most), "\r\t", "\n ")
    out = F.regexp_replace(out, UNPRINTABLE.replace(r"\x00-\x08\x0B-\x1F", r"\x00-\x09\x0B-\x1F"), "")
    lines = F.transform(F.split(collapse_blank_lines(out), "\n"), strip_edges)
    # a lambda's variable is evaluated once; the expression itself would be for every line
    keep = lambda ls: F.filter(ls, lambda x, i: (x == "") | (i < 3) | ~((x == F.get(ls, i - 1)) & (x == F.get(ls, i - 2)) & (x == F.get(ls, i - 3))))
    kept = F.transform(F.array(lines), keep)[0]
    return strip_edges(F.array_join(kept, "\n"))


def recover_spaces(text: Column) -> Column:
    """A blank between aA, 1a, x$ and comma-letter."""
    out = F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")
    out = F.regexp_replace(out, r"([0-9])(\p{L})", "$1 $2")
    out = F.regexp_replace(out, r"([^\s$])\$", r"$1 \$")
    return F.regexp_replace(out, r",(\p{L})", ", $1")


def count_matches(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_quality(text: Column) -> Column:
    """0 to 1: share of printable characters, weighed by word length and share of letters (per byte)."""
    size = F.octet_length(text)
    printable = count_matches(text, r"[\p{L}\p{N}\s!-/:-@\[-`{-~]") / size
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    mean = F.when(words > 0, size / words).otherwise(0.0)
    by_word = F.when((mean > 3) & (mean < 15), 1.0).otherwise(0.5)
    letters = count_matches(text, r"\p{L}") / size
    by_letter = F.when(letters < 0.15, 0.2).when(letters < 0.25, 0.6).otherwise(1.0)
    return F.when(size == 0, 0.0).otherwise(printable * by_word * by_letter)


def format_tables(text: Column) -> Column:
    """Lines with two tabs or more become rows between bars."""
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(F.split(x, "\t"), strip_edges), " | "), F.lit(" |"))
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) - F.length(F.replace(x, F.lit("\t"), F.lit(""))) >= 2, row(x)).otherwise(x)), "\n")


# Personal numbers and their masks, in this order.
MASKS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"),
    (r"\b[1-8]\d{8}\b", "*********"),
    (r"\b\d{2}-\d{7}\b", "**-*******"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "**** **** **** ****"),
    (r"\b[0-3]\d{8}\b", "*********"),
)


def redact_numbers(text: Column) -> Column:
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def dedup_key(text: Column) -> Column:
    """A text as it is compared: without citations, lower case, letters, digits and single blanks only."""
    bare = F.regexp_replace(F.lower(strip_citations(text)), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def section_header(text: Column) -> Column:
    """The first line if it is a heading: all capitals, Section or Article, or numbered; else null."""
    line = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    line = F.regexp_replace(line, r"\r$", "")
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    capitals = (F.length(letters) > 3) & ~letters.rlike(r"[^\p{Lu}]")
    named = line.rlike(r"^(Section|SECTION|Article|ARTICLE) ")
    numbered = line.rlike(r"^[0-9].*\.|^[0-9]\.")
    size = F.octet_length(line)
    return F.when((size > 3) & (size < 80) & (capitals | named | numbered), line)


def compress_lines(text: Column) -> Column:
    """Without blank lines, rules, page marks and ornaments; blanks squeezed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & ~x.rlike(r"^[_\-=.]+$")
        & ~(x.rlike("^[Pp]age ") & (F.octet_length(x) < 15))
        & ~((F.octet_length(x) > 5) & ~x.rlike(r"[\p{L}\p{N}]") & (F.size(F.array_distinct(F.split(x, ""))) <= 2)),
    )
    return F.array_join(kept, "\n")


def truncate_to_budget(text: Column, budget: int) -> Column:
    """At most `budget` characters: to the last sentence end, else the last blank and three dots."""
    head = F.substring(text, 1, budget)
    sentence = F.regexp_extract(head, r"(?s)^(.*)\. ", 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return (
        F.when(F.length(text) <= budget, text)
        .when(head.contains(". "), F.concat(sentence, F.lit(".")))
        .when(head.contains(" "), F.concat(word, F.lit("...")))
        .otherwise(F.concat(head, F.lit("...")))
    )


def printable_ratio(text: Column) -> Column:
    return 1 - count_matches(text, UNPRINTABLE) / F.length(text)


def letter_ratio(text: Column) -> Column:
    return count_matches(text, r"\p{L}") / F.length(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: F.octet_length(x) >= 2)


def keyword_set(text: Column, stop: tuple[str, ...], least: int) -> Column:
    """Distinct lower-case words of `least` bytes or more that are no stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_except(F.filter(words, lambda x: F.octet_length(x) >= least), F.array(*[F.lit(s) for s in stop]))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text contains one of the phrases; the phrases are plain text."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def pdf_string(data: Column) -> Column:
    """Text of the bytes of a PDF string: UTF-16BE behind its mark, else UTF-8 with what is no text replaced."""
    wide = F.decode(F.substring(data, 3, 1_000_000_000), "UTF-16BE")
    return F.when(F.substring(data, 1, 2) == F.lit(b"\xfe\xff"), wide).otherwise(F.make_valid_utf8(data.cast("string")))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest beginning of a text of at most `most` bytes that ends with a whole character."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    # the half of a character at the end has become one or more replacement signs; those of the text itself have three bytes
    whole = F.regexp_replace(cut, "\ufffd+$", "")
    kept = F.length(whole) + F.floor((most - F.octet_length(whole)) / 3)
    own = F.substring(text, F.lit(1), kept.cast("int"))
    return F.when(F.octet_length(text) <= most, text).when(own.endswith("\ufffd") & (F.octet_length(own) <= most), own).otherwise(whole)
