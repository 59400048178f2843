"""Sentence and paragraph boundaries of plain text, as offsets in code points."""

from __future__ import annotations

import re

# Words that carry a full stop without ending a sentence.
ABBREVIATIONS = frozenset(
    """mr mrs ms dr prof hon st rev gen col sgt capt lt messrs mme mlle sr jr esq sra srta dott avv ing
    inc corp ltd co bros mfg assoc dept
    sec art arts no nos para paras cl ch fig figs ex exh vol ed pp p cf al ca approx etc vs v viz ibid op
    jan feb mar apr jun jul aug sep sept oct nov dec
    nr abs bzw ggf usw vgl ziff str inkl núm pág sig""".split()
)
PARAGRAPH_GAP = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")
TERMINATOR = re.compile(r"[.?!]+[\"'”’»)\]}]*(?=[ \t\r\n]|$)")
LIST_ITEM = re.compile(r"[ \t]*(?:[-*•–▪◦·]|\(?(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,5})[.)])[ \t]+\S")
ENUMERATOR = re.compile(r"\(?(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcIVXLC]+)$")
BLANKS = " \t\r\n"


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph, without the blanks around it; blank ones are left out."""
    out, at = [], 0
    for gap in [*PARAGRAPH_GAP.finditer(text), None]:
        start, end = at, gap.start() if gap else len(text)
        while start < end and text[start] in BLANKS:
            start += 1
        while end > start and text[end - 1] in BLANKS:
            end -= 1
        if end > start:
            out.append((start, end))
        if gap:
            at = gap.end()
    return out


def list_regions(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a paragraph that are a list (two items or more) or table rows."""
    lines, at = [], start
    for line in text[start:end].split("\n"):
        row = line.count("|") >= 2 or line.count("\t") >= 2
        lines.append([at, at + len(line), row, bool(LIST_ITEM.match(line))])
        at += len(line) + 1
    out, k = [], 0
    while k < len(lines):
        if not (lines[k][2] or lines[k][3]):
            k += 1
            continue
        j, items = k, 0
        while j < len(lines) and (lines[j][2] or lines[j][3]):
            items += 1
            j += 1
        if lines[k][2] or items > 1:
            stop = lines[j - 1][1]
            while stop > lines[k][0] and text[stop - 1] in BLANKS:
                stop -= 1
            out.append((lines[k][0], stop))
        k = max(j, k + 1)
    return out


def ends_sentence(text: str, sentence_start: int, dot: int, after: int, end: int) -> bool:
    """Whether the terminator at text[dot:after] ends the sentence begun at sentence_start."""
    follow = after
    while follow < end and text[follow] in BLANKS:
        follow += 1
    if follow >= end:
        return True
    probe = follow
    while probe < end and text[probe] in "\"'“‘«([{":
        probe += 1
    if probe < end and text[probe].islower():
        return False
    if text[dot] != "." or text[dot : dot + 2] == "..":
        return True
    left = dot
    while left > sentence_start and text[left - 1] not in BLANKS:
        left -= 1
    word = text[left:dot].lstrip("\"'“‘«([{")
    if after > dot + 1:  # a closing quote or bracket follows the full stop
        return True
    if left == sentence_start and ENUMERATOR.match(word):
        return False
    if word.lower() in ABBREVIATIONS or (len(word) == 1 and word.isalpha() and word.isupper()):
        return False
    return not re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", word)


def sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of each sentence of the paragraph text[start:end]."""
    regions = list_regions(text, start, end)
    out, begun, r = [], start, 0
    for m in TERMINATOR.finditer(text, start, end):
        while r < len(regions) and regions[r][1] <= m.end():
            r += 1
        if r < len(regions) and regions[r][0] <= m.start():
            continue
        if not ends_sentence(text, begun, m.start(), m.end(), end):
            continue
        out.append((begun, m.end()))
        begun = m.end()
        while begun < end and text[begun] in BLANKS:
            begun += 1
    if begun < end:
        out.append((begun, end))
    return out
