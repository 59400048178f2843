"""Problem 1: cut over-long texts into overlapping pieces at natural boundaries.

Agglomerative merging. The text begins as atomic segments between all candidate boundaries (blanks,
sentence ends, paragraph ends). For each piece the segments that can still belong to it lie in a
heap of adjacent pairs, keyed by the strength of the boundary between them; the two at the weakest
boundary become one segment (of equal ones the earliest first) while their joint size, repeated text
included, fits. Boundaries that would leave a piece under the minimum are the weakest of all. The
boundary that survives is the strongest and, among equals, the last one inside the limit.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from paperloom.llm.sentences import BLANKS, paragraphs, sentence_spans

BLANK, SENTENCE, PARAGRAPH = 1, 2, 3
WORD = re.compile(r"[^ \t\r\n]+")


class Boundaries:
    """Candidate cuts of one text, with the strength of each."""

    def __init__(self, text: str):
        self.strength: dict[int, int] = {}
        self.words: list[int] = []
        self.sentences: list[int] = []
        self.paragraph_starts: list[int] = []
        for m in WORD.finditer(text):
            self.words.append(m.start())
            if m.end() < len(text):
                self.strength[m.end()] = BLANK
        for start, end in paragraphs(text):
            self.paragraph_starts.append(start)
            for a, b in sentence_spans(text, start, end):
                self.sentences.append(a)
                self.strength[b] = SENTENCE
            self.strength[end] = PARAGRAPH
        self.cuts = sorted(self.strength)


def merge_segments(b: Boundaries, start: int, least: int, most: int) -> tuple[int, int] | None:
    """Merge the segments that begin at `start` until one boundary is left; its place and strength.

    The segments are those between all boundaries of the next `most` code points (which hold what the piece
    repeats of the one before it), and what crosses the limit. The weakest boundary between two segments goes
    first, the earliest of equal ones, as long as the two together are no longer than `most`: so the head and
    what crosses the limit are never joined. None if no boundary leaves a piece of `least`.
    """
    cuts = b.cuts[bisect_right(b.cuts, start) : bisect_right(b.cuts, start + most)]
    edges = [start, *cuts, start + most + 1]
    end_of = dict(zip(edges, edges[1:]))
    start_of = dict(zip(edges[1:], edges))
    heap = [(b.strength[c] if c - start >= least else 0, c) for c in cuts]
    heapq.heapify(heap)
    kept = None
    while heap:
        strength, place = heapq.heappop(heap)
        left, right = start_of[place], end_of[place]
        if right - left > most:
            kept = (place, strength)  # no merge fits any more: this boundary survives
            continue
        end_of[left], start_of[right] = right, left
        del start_of[place], end_of[place]
    return kept if kept and kept[1] else None


def split_text(text: str, most: int = 1000, least: int = 400, overlap: int = 150) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of at most `most` code points; [] for a blank text.

    After a paragraph end nothing is repeated, after a sentence end whole sentences of the same
    paragraph within the last `overlap`, after a blank whole words, after a hard cut `overlap`.
    """
    if not 0 <= overlap < least <= most:
        raise ValueError("needs 0 <= overlap < least <= most")
    b = Boundaries(text)
    end = len(text.rstrip(BLANKS))
    out: list[tuple[int, int]] = []
    at = 0

    def skip(k: int) -> int:
        j = bisect_left(b.words, k)
        inside = k < end and text[k] not in BLANKS
        return k if inside else (b.words[j] if j < len(b.words) else end)

    at = skip(0)
    while at < end:
        if end - at <= most:
            out.append((at, end))
            break
        cut, strength = merge_segments(b, at, least, most) or (at + most, 0)
        out.append((at, cut))
        if strength == PARAGRAPH:
            follow = cut
        elif strength == SENTENCE:
            opened = b.paragraph_starts[bisect_left(b.paragraph_starts, cut) - 1]
            j = bisect_left(b.sentences, max(cut - overlap, opened))
            follow = b.sentences[j] if j < len(b.sentences) and b.sentences[j] < cut else cut
        elif strength == BLANK:
            j = bisect_left(b.words, cut - overlap)
            follow = b.words[j] if j < len(b.words) and b.words[j] < cut else cut
        else:
            follow = cut - overlap
        at = skip(follow)
    return out


def split_pages(pages: DataFrame, most: int = 1000, least: int = 400, overlap: int = 150) -> DataFrame:
    """doc_id, page_number, chunk_index, start_off, end_off, text of the pieces of each page.

    Null and blank texts give no piece; a text within the limit gives one. Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, n, k, a, z, t[a:z])
                for d, n, t in zip(batch["doc_id"], batch["page_number"], batch["text"])
                if t
                for k, (a, z) in enumerate(split_text(t, most, least, overlap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "chunk_index", "start_off", "end_off", "text"])

    schema = "doc_id string, page_number int, chunk_index bigint, start_off bigint, end_off bigint, text string"
    return pages.select("doc_id", "page_number", "text").mapInPandas(run, schema)
