"""Excerpts, summaries and figures of chunks for display."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.words import CLAIM_STOP

# Abbreviations after which no sentence of an excerpt ends, and openings of headings.
SHORT = tuple("U.S u.s Inc Corp Ltd Co Jr Sr Dr Mr Mrs Ms Prof Rev Gen Gov Sgt No Nos Art Sec Dept Div Ch Vol Fig App Exh Cl Par Sub Amdt Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec St Ave Blvd Ct Rd v vs et al e.g i.e cf".split())
OPENINGS = ("Section ", "Article ", "Clause ", "Part ", "SECTION ", "ARTICLE ", "CLAUSE ", "PART ")
STOP = frozenset(CLAIM_STOP[: CLAIM_STOP.index("hereof") + 1]) | {"aforesaid", "foregoing", "witnesseth", "provided"}


def sentences(text: str) -> list[str]:
    """Sentences over 15 bytes; not cut after abbreviations, initials and within decimals."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]", text):
        i = m.start()
        if text[i] == ".":
            word = re.split(r"[\s(\"]", text[:i])[-1]
            if word.endswith(SHORT) or (len(word) == 1 and word.isupper()) or text[i + 1 : i + 2].isdigit():
                continue
        out.append(text[start : i + 1].strip())
        start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if len(s.encode()) > 15]


def best_excerpt(text: str, question: str) -> str:
    """The sentence that answers best, with its neighbours, at most 500 characters."""
    clean = re.sub("[\x00-\x08\x0b-\x1f\x7f-\x9f\ue000-\uf8ff\ufff0-\uffff]", "", text)
    found = sentences(clean)
    if not found:
        return clean[:450]
    asked = {w for w in re.split(r"[\W\d_]+", question.lower()) if len(w.encode()) > 2}
    best, most = 0, -1.0
    for i, s in enumerate(found):
        words = [w for w in re.split(r"[\W\d_]+", s.lower()) if w]
        if words:
            score = (sum(w in asked for w in words) + 0.5 * min(len(s.encode()) / 100, 1)) / len(words) ** 0.5
            if score > most:
                best, most = i, score
    out = ". ".join(found[max(0, best - 1) : best + 2])
    return out if len(out) <= 500 else out[:500] + "…"


def shorten(text: str, most: int = 80) -> str:
    return text if len(text) <= most else text[:most] + "…"


def summarize(text: str) -> str:
    """What a chunk is: a table, a form, its heading, its first sentence, or its most frequent words."""
    lines = text.split("\n")
    rows = sum(line.count("\t") >= 2 or line.count("|") >= 2 for line in lines)
    if rows >= 2:
        return f"Table ({rows} rows): {lines[0].strip()[:60]}"
    fields = sum(bool(re.match(r"\s*\S[^:]{1,39}:\s*\S", line)) for line in lines)
    if fields >= 3:
        return f"Form data ({fields} fields): {', '.join(x.strip() for x in lines[:2])}"
    for line in lines[:3]:
        s = line.strip()
        if not 3 <= len(s.encode()) <= 60:
            continue
        letters = [c for c in s if c.isalpha()]
        if not s.endswith(".") and letters and all(c.isupper() for c in letters):
            return shorten(" ".join(w[:1].upper() + w[1:].lower() for w in s.split()))
        if s.startswith(OPENINGS) or (s[0].isdigit() and " " in s and letters):
            return shorten(s)
    whole = text.strip()
    if len(whole.encode()) < 150:
        end = re.search(r"[.!?]", whole)
        return shorten(whole[: end.end()] if end else whole)
    count = Counter(w for w in re.split(r"[\W_]+", whole.lower()) if len(w.encode()) > 2 and w not in STOP)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:4]]
    if not top:
        return shorten(whole)
    return "Covers: " + (", ".join(top) if len(top) <= 2 else f"{', '.join(top[:-1])}, and {top[-1]}")


@F.pandas_udf(StringType())
def summarize_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else summarize(t))


@F.pandas_udf(StringType())
def best_excerpt_udf(text: pd.Series, question: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else best_excerpt(t, q or "") for t, q in zip(text, question)])
