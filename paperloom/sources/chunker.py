"""Sentences and chunks as the retrieval pipeline cuts them; sizes are in bytes of UTF-8."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words whose full stop ends no sentence, and openings of headings.
SHORT = frozenset("mr mrs ms dr prof sr jr vs etc inc corp ltd co no sec art fig est approx jan feb mar apr jun jul aug sep oct nov dec".split())
OPENINGS = ("SECTION", "ARTICLE", "WHEREAS", "NOW THEREFORE", "SCHEDULE", "EXHIBIT", "ANNEX")


def size(text: str) -> int:
    return len(text.encode())


def is_heading(line: str) -> bool:
    t = line.strip()
    if not t or size(t) >= 80:
        return False
    numbered = re.match(r"(\d+)\.(.*)$", t, re.S)
    if numbered:
        rest = numbered[2].strip()
        if rest[:1].isdigit() or (size(rest) <= 40 and not rest.endswith((".", "!", "?"))):
            return True
    if t.endswith((".", "!", "?")):
        return False
    if t.upper().startswith(OPENINGS):
        return True
    letters = [c for c in t if c.isalpha()]
    if size(t) >= 6 and letters and all(c.isupper() for c in letters) and len(t.split()) <= 8:
        return True
    bracket = re.match(r"\(([A-Za-z]+)\)(.*)$", t, re.S)
    return bool(bracket) and size(bracket[2].strip()) <= 40


def is_list_item(line: str) -> bool:
    return bool(re.match(r"\s*(\(([a-z]+|\d+)\)|\d{1,4}\.|[a-z]{1,2}\.)", line))


def fragments(text: str) -> list[tuple[str, bool]]:
    """(sentence or line, whether it begins a paragraph) of a page."""
    out: list[tuple[str, bool]] = []
    start, fresh = 0, False

    def add(piece: str, always: bool) -> None:
        nonlocal fresh
        s = piece.strip()
        if s:
            breaks = fresh or is_heading(s)
            out.append((s, breaks))
            if always or breaks:
                fresh = False

    i = 0
    while i < len(text):
        c = text[i]
        if c in ".!?" and i + 1 < len(text) and text[i + 1] in " \t\n\r\f\v":
            word = re.split(r"[ \t\n\r\f\v]", text[start:i])[-1] if c == "." else "xx"
            if c != "." or (word and not (len(word) == 1 and word.isascii() and word.isalpha()) and word.lower() not in SHORT):
                add(text[start : i + 1], False)
                j = i + 1
                while j < len(text) and text[j] in " \t\n\r\f\v":
                    j += 1
                fresh = fresh or text.count("\n", i + 1, j) >= 2
                start = i = j
                continue
            i += 1
        elif c == "\n":
            j = i
            while j < len(text) and text[j] == "\n":
                j += 1
            add(text[start:i], True)
            fresh = fresh or j - i >= 2
            start = i = j
        else:
            i += 1
    add(text[start:], True)
    return out


def hard_split(text: str, most: int) -> list[str]:
    data, at, out = text.encode(), 0, []
    while at < len(data):
        end = min(at + most, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        piece = data[at:end].decode().strip()
        if piece:
            out.append(piece)
        at = end
    return out


def paragraph_runs(text: str) -> list[tuple[str, bool, list[str]]]:
    """(headings above it, whether a gap or heading opens it, its sentences) of each paragraph of a page; headings
    without a paragraph stand alone."""
    runs: list[tuple[str, bool, list[str]]] = []
    for piece, breaks in fragments(text):
        above = runs[-1] if runs else None
        waiting = above is not None and not above[2]  # headings that wait for their paragraph
        if breaks and is_heading(piece):
            runs.append((f"{runs.pop()[0]}\n{piece}" if waiting else piece, breaks, []))
        elif waiting:
            runs[-1] = (above[0], breaks, [piece])
        elif above is None or breaks:
            runs.append(("", breaks, [piece]))
        else:
            above[2].append(piece)
    return runs


def last_whole(parts: list[str], most: int) -> list[str]:
    """The last parts that, a blank after each, are no longer than `most` together."""
    room, k = most, len(parts)
    while k and size(parts[k - 1]) + 1 <= room:
        k -= 1
        room -= size(parts[k]) + 1
    return parts[k:]


def packed_run(heading: str, opens: bool, pieces: list[str], chunk_size: int, overlap: int) -> list[str]:
    """A paragraph in chunks of whole sentences. What is cut out of the sentence that opens it repeats nothing."""
    parts = [(n, part) for n, piece in enumerate(pieces) for part in (hard_split(piece, chunk_size) if size(piece) > chunk_size else [piece])]
    held, fresh = ([heading + "\n"] if heading else []), []
    out: list[str] = []
    for n, part in parts:
        if held and size(" ".join([*held, part])) > chunk_size:
            out.append(" ".join(held))
            held, fresh = [] if opens and n == 0 else last_whole(fresh, overlap), []
        held.append(part)
        fresh.append(part)
    return [*out, " ".join(held)]


def page_chunks(text: str, chunk_size: int = 1000, overlap: int = 150) -> list[tuple[str, int, int]]:
    """(text, start, end) of a page's chunks: whole sentences up to `chunk_size`, headings kept with what
    follows, whole sentences repeated up to `overlap` within a paragraph. Offsets add up chunk lengths."""
    bodies = [b.strip() for run in paragraph_runs(text or "") for b in packed_run(*run, chunk_size, overlap)]
    bodies = [b for b in bodies if b]
    ends = list(accumulate(map(size, bodies)))
    return [(b, end - size(b), end) for b, end in zip(bodies, ends)]


def chunk_documents(pages: DataFrame, chunk_size: int = 1000, overlap: int = 150, runt: int = 100) -> DataFrame:
    """doc_id, page_number, chunk_index, text, token_count, start_off, end_off of each document's chunks.

    Pages are cut each for itself; chunks are then numbered through the document, and those under
    `runt` bytes join the last longer one before them, also across pages (leaving gaps in the numbers).
    Null and blank pages give no chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, n, *c) for d, p, t in zip(batch["doc_id"], batch["page_number"], batch["text"]) for n, c in enumerate(page_chunks(t, chunk_size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "n", "text", "start_off", "end_off"])

    cut = pages.select("doc_id", "page_number", "text").mapInPandas(run, "doc_id string, page_number int, n int, text string, start_off bigint, end_off bigint")
    order = Window.partitionBy("doc_id").orderBy("page_number", "n", "text")
    numbered = cut.withColumn("i", F.row_number().over(order) - 1).withColumn("g", F.sum((F.octet_length("text") >= runt).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("i", "page_number", "text", "start_off", "end_off"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    first = F.col("p")[0]
    return parts.select(
        "doc_id", first["page_number"].alias("page_number"), first["i"].cast("bigint").alias("chunk_index"), whole.alias("text"), F.greatest(F.lit(1), F.floor(F.octet_length(whole) / 3)).cast("bigint").alias("token_count"),
        first["start_off"].alias("start_off"), first["end_off"].alias("end_off"),
    )


def sentences(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, n, sentence, breaks of each page's fragments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p, n, s, b) for d, p, t in zip(batch["doc_id"], batch["page_number"], batch["text"]) for n, (s, b) in enumerate(fragments(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "n", "sentence", "breaks"])

    return pages.select("doc_id", "page_number", "text").mapInPandas(run, "doc_id string, page_number int, n int, sentence string, breaks boolean")
