"""Problem 3, first part: tell running headers, footers, page numbers, stamps and fax lines from the text.

An averaged perceptron reads for each line its place on the page, its form, its size, its neighbours and
how often the document has it at the edge of a page. It is trained here without labels. Seeds of furniture
are lines whose form (words and numbers reduced to classes) stands nearly always at the edges of pages, and
titles that come back at the edges of a document's pages. Seeds of text are full lines, sentence ends,
numbered headings, figures after their label, and the title on top of a document. The perceptron then
decides on all lines, wherever they stand, misread ones and forms without a seed included.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict

from paperloom.llm.perceptron import AveragedPerceptron

FURNITURE, TEXT = "F", "T"
NUMBERED = re.compile(r"^\(?\d+(\.\d+)*[.)]\s+\S")
ROMAN = re.compile(r"[ivxlc1]{1,7}")
EDGES = "()[].,:;-–—_"
NUMBER_LIKE = re.compile(r"[\dOoIlSsBbgZzQ|/.:\-+(]+")
LOWER = re.compile(r"(?<!\S)[a-z]{4,}")
SENTENCE_END = re.compile(r"[.!?:;,][\"'”’»)\]]*$")
# Pairs and signs that scanners confuse, both sides of which become one sign.
SAME_PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("in", "m"), ("li", "h"), ("ni", "m"))
SAME_SIGNS = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "4": "a", "6": "b", "9": "g", "+": "t", "f": "t", "c": "e", "(": "e", "á": "a", "ó": "o", "é": "e", "í": "l", "ú": "u", "h": "b", "y": "v", "q": "g", "8": "b", "2": "z"})


def folded(line: str) -> str:
    """A key under which a line and its misread copies agree; numbers at its ends are left out."""
    s = re.sub(r"(\s*[-–—]?\s*(?i:page)?\s+\d+$)|(^\d+\s{2,})", "", line.strip()).lower()
    for a, b in SAME_PAIRS:
        s = s.replace(a, b)
    return re.sub(r"\s+", "", s.translate(SAME_SIGNS))


def token_form(t: str) -> str:
    core = t.strip(EDGES)
    if not core:
        return t[:1]
    real = sum(c.isdigit() for c in core)
    if real and (2 * real >= len(core) or NUMBER_LIKE.fullmatch(core)):
        form = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d(?:[\dOoIlSsBbgZzQ|]*\d)?", "9", core))
    elif ROMAN.fullmatch(core.lower()):
        form = "i"
    elif core.upper() == core and len(core) > 1:
        form = "A"
    else:
        form = "a"
    at = t.index(core)
    return t[:at][:1] + form + t[at + len(core) :][:1]


def line_form(line: str) -> str:
    """The form of a line: classes of its tokens, runs of words and of blanks as one."""
    out: list[str] = []
    for gap, t in re.findall(r"(\s*)(\S+)", line.strip()):
        f = token_form(t)
        if len(gap) > 1:
            out.append("_")
        if f in ("a", "A") and out and out[-1] in ("a+", "A+"):
            out[-1] = "A+" if f == "A" and out[-1] == "A+" else "a+"
            continue
        out.append({"a": "a+", "A": "A+"}.get(f, f))
    return " ".join(out)[:60]


class Page:
    """The filled lines of a page with what is around them."""

    def __init__(self, text: str, number: int):
        self.lines = [line.rstrip("\r") for line in text.split("\n")]
        self.number = number
        self.filled = [k for k, line in enumerate(self.lines) if line.strip()]
        self.width = max((len(self.lines[k].rstrip()) for k in self.filled), default=0)

    def edge(self, n: int) -> bool:
        """Whether the n-th filled line is the first or the last, or stands by itself next to it."""
        if n in (0, len(self.filled) - 1):
            return True
        a, b = self.filled[n - 1], self.filled[n]
        if n == 1:
            return b - a == 1 and len(self.lines[b].strip()) < 70 and self.gap_after(n)
        return n == len(self.filled) - 2 and self.gap_before(n) and len(self.lines[b].strip()) < 70

    def gap_before(self, n: int) -> bool:
        return n == 0 or self.filled[n] - self.filled[n - 1] > 1

    def gap_after(self, n: int) -> bool:
        return n == len(self.filled) - 1 or self.filled[n + 1] - self.filled[n] > 1

    def title_like(self, n: int) -> bool:
        s = self.lines[self.filled[n]].strip()
        # titles set most words in capitals
        return 3 <= len(s) < 70 and len(LOWER.findall(s)) <= 3 and not SENTENCE_END.search(s) and s[-1] not in "-‐‑¬­" and not NUMBERED.match(s) and bool(re.search(r"[^\W\d_]{3}", s)) and s[0] not in "\"'("

    def heads_number(self, n: int) -> bool:
        """Whether a line is one word with a number right under it, as a total has."""
        if self.gap_after(n) or len(self.lines[self.filled[n]].split()) > 1:
            return False
        below = self.lines[self.filled[n + 1]].split()
        return len(below) == 1 and bool(re.fullmatch(r"[\d.,$€£]+", below[0]))

    def top_title(self, n: int) -> bool:
        """The place of a document's own title: on top of its first page, with a blank line under it."""
        return self.number == 1 and n <= 1 and self.gap_after(n)

    def keys(self) -> list[tuple[int, str, bool]]:
        """(n, folded key, at an edge) of the lines that may be running titles."""
        out = []
        for n in range(len(self.filled)):
            if self.title_like(n) and not self.heads_number(n):
                key = folded(self.lines[self.filled[n]])
                if len(key) > 3:
                    out.append((n, key, n < 3 or n >= len(self.filled) - 3))
        return out

    def inside(self, n: int) -> bool:
        """Whether the lines around go on across this one."""
        if n == 0 or n == len(self.filled) - 1 or self.gap_before(n) or self.gap_after(n):
            return False
        before, after = self.lines[self.filled[n - 1]].strip(), self.lines[self.filled[n + 1]].strip()
        return not SENTENCE_END.search(before) and after[:1].islower()

    def mark(self, titles: dict[str, int]) -> Page:
        """Take over how many pages of the document have each running title at an edge."""
        found = {n: titles.get(key, 0) for n, key, _ in self.keys()}
        self.repeats = [found.get(n, 0) for n in range(len(self.filled))]
        self.figures = [self.figure(n) for n in range(len(self.filled))] + [False]
        return self

    def figure(self, n: int) -> bool:
        """Whether a line of one number stands right under the label it belongs to."""
        s = self.lines[self.filled[n]].strip()
        if n == 0 or self.gap_before(n) or len(s.split()) > 1 or not re.search(r"\d", s):
            return False
        before = self.lines[self.filled[n - 1]].strip()
        short = len(before) < 0.4 * self.width and bool(re.search(r"[^\W\d_]{3}", before)) and not re.search(r"\d", before) and not NUMBERED.match(before)
        return short and (before.endswith(":") or not SENTENCE_END.search(before)) and (before.endswith(":") or not self.repeats[n - 1] or len(before.split()) == 1)

    def features(self, n: int, form: str) -> list[str]:
        k, repeats = self.filled[n], self.repeats[n]
        s = self.lines[k].strip()
        words = s.split()
        last = len(self.filled) - 1 - n
        place = f"{min(n, 3)}{min(last, 3)}"
        gaps = f"{int(self.gap_before(n))}{int(self.gap_after(n))}"
        r = min(repeats, 3)
        size = "s" if len(s) < 0.5 * self.width else "l"
        length = min(len(s) // 8, 8)
        digits = round(4 * sum(c.isdigit() for c in s) / len(s))
        upper = round(4 * sum(c.isupper() for c in s) / max(1, sum(c.isalpha() for c in s)))
        end = "." if SENTENCE_END.search(s) else "-" if s[-1] in "-‐‑¬­" else "9" if s[-1].isdigit() else "a"
        inside, figure = int(self.inside(n)), int(self.figures[n]) + 2 * int(self.figures[n + 1])
        first, tail = folded(words[0])[:12], token_form(words[-1])
        return [
            "b", f"f{form}", f"fs{form}{size}", f"p{place}", f"g{gaps}", f"pg{place}{gaps}", f"r{r}", f"rp{r}{int(self.edge(n))}", f"rg{r}{gaps}", f"t{int(self.top_title(n))}{r}", f"tf{int(self.top_title(n))}{form}", f"z{size}{end}", f"l{length}",
            f"d{digits}", f"u{upper}", f"e{end}", f"i{inside}{size}", f"if{inside}{form}", f"x{figure}{form}", f"y{figure}", f"zl{size}{length}{inside}{words[0][:1].isdigit()}", f"t1{int(self.top_title(n))}{first}", f"1{first}", f"1f{first}{form}", f"9{tail}", f"w{min(len(words), 9)}", f"n{int(bool(NUMBERED.match(s)))}",
            f"pe{int(min(n, last) < 2)}{form}", f"ru{r}{upper}", f"v{int(any(folded(w).strip('.') in ('v', 'vs') for w in words[1:-1]))}{upper}", f"sp{int('   ' in s)}{tail}{words[0][:1].isdigit()}",
        ]


class FurnitureModel:
    """The perceptron, and the forms that the training pages taught."""

    def __init__(self) -> None:
        self.perceptron = AveragedPerceptron()
        self.w: dict[str, float] = {}
        self.lower = 0  # long words in lower case that furniture may have, as its seeds have no more

    def seed(self, page: Page, n: int, form: str, rate: dict[str, tuple[int, int]]) -> str | None:
        s = page.lines[page.filled[n]].strip()
        if page.figures[n] or page.figures[n + 1] or NUMBERED.match(s) or (page.top_title(n) and page.title_like(n) and form in ("a+", "A+")):
            return TEXT
        edge, body = rate.get(form, (0, 0))
        if (edge >= 4 and edge >= 3 * body and form not in ("a+", "A+")) or (page.repeats[n] >= 2 and page.title_like(n)):
            return FURNITURE
        if SENTENCE_END.search(s) or len(s) > 0.7 * page.width or not page.edge(n):
            return TEXT
        return None

    def train(self, pages: list[Page], rounds: int = 6, seed: int = 3) -> FurnitureModel:
        """Fit on marked pages; see the module for the seeds."""
        rate: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        forms = [[line_form(page.lines[k]) for k in page.filled] for page in pages]
        for page, own in zip(pages, forms):
            for n, form in enumerate(own):
                if not page.figures[n]:
                    rate[form][0 if page.edge(n) else 1] += 1
        fixed = {f: (a, b) for f, (a, b) in rate.items()}
        samples, lower = [], [0]
        for page, own in zip(pages, forms):
            for n, form in enumerate(own):
                label = self.seed(page, n, form, fixed)
                if label:
                    samples.append((page.features(n, form), label))
                    if label == FURNITURE:
                        lower.append(len(LOWER.findall(page.lines[page.filled[n]])))
        self.lower = sorted(lower)[int(0.999 * (len(lower) - 1))] + 1
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(samples)
            for features, label in samples:
                self.perceptron.learn(features, [TEXT, FURNITURE], label)
        self.perceptron.average()
        self.w = {f: round(row.get(FURNITURE, 0.0) - row.get(TEXT, 0.0), 4) for f, row in self.perceptron.w.items()}
        return self

    def lines(self, page: Page) -> set[int]:
        """Numbers (from 0) of the lines of a marked page that are furniture."""
        out = set()
        for n, k in enumerate(page.filled):
            if len(LOWER.findall(page.lines[k])) > self.lower:
                continue
            if sum(self.w.get(f, 0.0) for f in page.features(n, line_form(page.lines[k]))) > 0:
                out.add(k)
        return out
