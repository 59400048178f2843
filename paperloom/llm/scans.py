"""Problem 3: repair text that was recognised on scanned pages.

An averaged-perceptron character editor predicts for each character of a word keep, replace, delete or
insert, and for each hyphen at a line end whether the lines join. It is trained here, on frequent words of
the corpus's clean pages with noise from a table of usual confusions. It runs over the distinct words that
the clean pages do not know, once for each. Its forms are ranked by its own score and kept within a margin
of the best one that held-out words have shown to be enough; the first that is a much more frequent word of
the corpus, or a name the document uses more often, is the repair. Running headers, footers, page numbers,
stamps and fax lines are told by a second perceptron (see `furniture`).

Word counts, known words and repairs are tables that are joined to the words of each page. Only the
`COMMON` most frequent words are broadcast, so that the bulk of the words needs no join; the result does not
depend on their number.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.furniture import NUMBERED, FurnitureModel, Page
from paperloom.llm.perceptron import AveragedPerceptron
from paperloom.session import checkpoint

SCANNED, CLEAN = ("pdf", "tif", "tiff", "png"), ("docx", "txt", "md", "eml")
COMMON = 20_000  # words in the broadcast that spares known words the join
TRAINING_PAGES = 1200  # pages, chosen by hash, that the furniture perceptron is fitted on
BEAM = 48  # edited forms of a word that are held at once, best first
# Right form and the form it is often misread as.
CONFUSIONS = (
    ("e", "c"), ("a", "á"), ("t", "f"), ("t", "+"), ("i", "1"), ("l", "1"), ("n", "ri"), ("o", "0"), ("s", "5"), ("d", "cl"), ("u", "ii"),
    ("c", "("), ("m", "rn"), ("g", "9"), ("in", "m"), ("h", "b"), ("b", "6"), ("w", "vv"), ("y", "v"), ("li", "h"), ("rn", "m"), ("cl", "d"),
    ("a", "4"), ("i", "l"), ("l", "i"), ("o", "ó"), ("e", "é"), ("i", "í"), ("u", "ú"), ("z", "2"), ("q", "9"), ("b", "8"), ("nn", "m"), ("h", "li"), ("f", "t"), ("c", "e"), ("ni", "m"), ("v", "y"),
)
WRONG = {c: [(a, b) for a, b in CONFUSIONS if b[0] == c] for c in {b[0] for _, b in CONFUSIONS}}
MARKS = "-‐‑¬­"
STRIP = "\"'“”‘’«».,;:?!)]}*_|"
TOKEN = re.compile(r"\S+")
KEEP, DELETE, JOIN = "K", "D", "J"


def char_features(w: str, k: int) -> list[str]:
    p = f"^^^{w}$$$"
    j = k + 3
    return [
        f"0{p[j]}", f"a{p[j-1:j+1]}", f"b{p[j:j+2]}", f"c{p[j-1:j+2]}", f"d{p[j-2:j+1]}", f"e{p[j:j+3]}",
        f"f{p[j-2:j+3]}", f"g{p[j-3:j+1]}", f"h{p[j:j+4]}", f"i{p[j-3:j+4]}",
    ]


def noisy(word: str, rng: random.Random, errors: int) -> tuple[str, list[str]] | None:
    """A misread form of a word and the operation at each of its characters that repairs it."""
    ops, at, out = [], 0, []
    places = [(k, right, wrong) for right, wrong in CONFUSIONS for k in range(len(word)) if word.startswith(right, k)]
    if not places:
        return None
    chosen: dict[int, tuple[str, str]] = {}
    for _ in range(errors):
        k, right, wrong = rng.choice(places)
        if all(abs(k - o) > 2 for o in chosen):
            chosen[k] = (right, wrong)
    while at < len(word):
        if at in chosen:
            right, wrong = chosen[at]
            out.append(wrong)
            ops.append("R" + right)
            ops.extend([DELETE] * (len(wrong) - 1))
            at += len(right)
        elif rng.random() < 0.002 and 0 < at < len(word) - 1:  # a lost character is inserted after the one before it
            ops[-1] = "I" + word[at] if ops[-1] == KEEP else ops[-1]
            if ops[-1][0] != "I":
                out.append(word[at])
                ops.append(KEEP)
            at += 1
        else:
            out.append(word[at])
            ops.append(KEEP)
            at += 1
    return "".join(out), ops


class Words:
    """What is known of words: counts on clean and on all pages, and repairs of misread ones.

    `common` are known words; `own` holds the facts on other words: (known, form, edits).
    """

    def __init__(self, common: set[str] | dict[str, int], own: dict[str, tuple[bool, str | None, list[int]]] | None = None, seen: dict[str, bool] | None = None):
        self.common, self.own = common, own or {}
        self.seen = {} if seen is None else seen  # what `plain` has found, which pages may share

    def plain(self, token: str) -> bool:
        """Whether a token, as it stands between blanks, is a common word whatever stands before it."""
        known = self.seen.get(token)
        if known is None:
            known = self.seen[token] = all(core.lower() in self.common for x in ("x " + token, "x. " + token) for _, core in list(tokens_of(x))[1:])
        return known

    def known(self, w: str) -> bool:
        return w in self.common or self.own.get(w, (False,))[0]

    def repair(self, w: str) -> tuple[str, list[int]] | None:
        if w in self.common:
            return None
        known, form, edits = self.own.get(w, (False, None, []))
        return (form, list(edits)) if form is not None and not known else None


def join_features(left: str, mark: str, right: str, words: Words) -> list[str]:
    joined, compound = words.known((left + right).lower()), words.known(f"{left}-{right}".lower())
    shape = "A" if right[:1].isupper() else "a" if right[:1].islower() else "9" if right[:1].isdigit() else "-"
    end = left[-1:].isalpha()
    both = f"{words.known(left.lower())}{words.known(right.lower())}"
    return [f"m{'-' if mark == '-' else '~'}", f"j{joined}{compound}", f"s{shape}{end}", f"x{joined}{compound}{shape}", f"w{both}{joined}{compound}", f"y{mark == '-'}{shape}{joined}{compound}"]


class Editor:
    """The trained character editor."""

    def __init__(self) -> None:
        self.edit, self.join = AveragedPerceptron(), AveragedPerceptron()
        self.ops: dict[str, list[str]] = {}
        self.bigrams: set[str] = set()
        self.margin = 0.0

    def train(self, common: dict[str, int], words: int = 2500, seed: int = 5) -> Editor:
        """Fit on the `words` most frequent of the common words (a bounded sample), each clean and misread.

        A tenth of them is held out; the margin is what all of their single misreadings need.
        """
        rng = random.Random(seed)
        clean = sorted((w for w in common if len(w) >= 3 and w.isalpha()), key=lambda w: (-common[w], w))[:words]
        samples, held = [], []
        for n, w in enumerate(clean):
            if n % 10 == 9:
                held.extend((made, w) for made in (noisy(w, rng, 1) for _ in range(12)) if made and made[0] not in common and made[0] != w)
                continue
            samples.append((w, [KEEP] * len(w)))
            for errors in (1, 1, 1, 2):
                made = noisy(w, rng, errors)
                if made and made[0] not in common:
                    samples.append(made)
        ops: dict[str, set[str]] = defaultdict(lambda: {KEEP})
        for right, wrong in CONFUSIONS:
            ops[wrong[0]].add("R" + right)
        for w, good in samples:
            for c, op in zip(w, good):
                ops[c] |= {op} - {DELETE}
        self.ops = {c: sorted(o) for c, o in ops.items()}
        for _ in range(4):
            rng.shuffle(samples)
            for w, good in samples:
                for k, op in enumerate(good):
                    if len(self.ops[w[k]]) > 1 and op != DELETE:  # deletions follow from what is replaced
                        self.edit.learn(char_features(w, k), self.ops[w[k]], op)
        self.edit.average()
        self.margin = max((self.shortfall(w, good) for (w, good), _ in held), default=0.0)
        compounds = sorted(w for w in common if re.fullmatch(r"[^\W\d_]{2,}-[^\W\d_]{2,}", w))[:words]
        breaks = []
        for w in clean:
            if len(w) > 4:
                k = rng.randint(2, len(w) - 2)
                breaks.append((w[:k], w[k:], JOIN))
        breaks.extend((*w.split("-"), KEEP) for w in compounds for _ in range(3))
        breaks.extend((a, str(rng.randint(1, 99)), KEEP) for a in clean[:100])
        breaks.extend((a.title(), b.title(), KEEP) for a, b in zip(clean[:200], clean[1:201]))
        unknown = [("".join(rng.sample(w, len(w)))) for w in clean if len(w) > 5]  # words the corpus does not hold
        breaks.extend((w[:3], w[3:], JOIN) for w in unknown)
        lexicon = Words(common)
        for _ in range(3):
            rng.shuffle(breaks)
            for a, b, op in breaks:
                for mark in ("-", "¬"):
                    self.join.learn(join_features(a, mark, b, lexicon), [JOIN, KEEP], op)
        self.join.average()
        self.bigrams = {w[k : k + 2] for w in common for k in range(len(w) - 1)}
        return self

    def shortfall(self, word: str, good: list[str]) -> float:
        """How much less than the best operations at each place the right ones score."""
        out = 0.0
        for k, op in enumerate(good):
            ops = self.ops.get(word[k], [KEEP])
            if len(ops) > 1 and op in ops and op != DELETE:
                s = self.edit.scores(char_features(word, k), ops)
                out += max(s) - s[ops.index(op)]
        return out

    def joins(self, left: str, mark: str, right: str, words: Words) -> bool:
        if not right:
            return mark != "-" or not words.known(left.lower())
        s = self.join.scores(join_features(left, mark, right, words), [JOIN, KEEP])
        return s[0] > s[1]

    def candidates(self, w: str) -> list[tuple[float, str, list[int]]]:
        """Edited forms within the margin by falling score, each with the places that are edited.

        A sign is replaced only where the misread form stands in whole; its other signs are then deleted. A lost
        sign is inserted only where the editor wants it, into a word without another error.
        """
        ops_at = [self.ops.get(c, [KEEP]) for c in w]
        score_at = [dict(zip(ops, self.edit.scores(char_features(w, k), ops))) if len(ops) > 1 else {KEEP: 0.0} for k, ops in enumerate(ops_at)]
        best_at = [max(s.values()) for s in score_at]
        paths: list[list[tuple[float, str, list[int]]]] = [[] for _ in range(len(w) + 1)]
        paths[0] = [(0.0, "", [])]
        lost: list[tuple[float, str, list[int]]] = []
        whole = sum(s[KEEP] - b for s, b in zip(score_at, best_at))
        for k, c in enumerate(w):
            here = sorted(paths[k], key=lambda p: (-p[0], len(p[2])))[:BEAM]
            steps = [(score_at[k][KEEP] - best_at[k], c, 1)]
            for right, wrong in WRONG.get(c, ()):
                if w.startswith(wrong, k) and "R" + right in score_at[k]:
                    total = score_at[k]["R" + right] - best_at[k]
                    steps.append((total, right, len(wrong)))
            for s, t, e in here:
                for v, form, size in steps:
                    if s + v >= -self.margin - 1e-9:
                        paths[k + size].append((s + v, t + form, e if form == c and size == 1 else [*e, *range(k, k + size)]))
            for op in ops_at[k]:
                if op[0] == "I":
                    total = whole - score_at[k][KEEP] + score_at[k][op]
                    if score_at[k][op] >= score_at[k][KEEP]:
                        lost.append((total, w[: k + 1] + op[1:] + w[k + 1 :], [k]))
        return sorted(paths[len(w)] + lost, key=lambda p: (-p[0], len(p[2])))[:BEAM]

    def suspicious(self, word: str, forms: list[tuple[float, str, list[int]]]) -> tuple[str, list[int]] | None:
        """Misread characters of a word that no known word explains, as in names: digits or signs between
        letters, or pairs of letters that no word has, where the editor wants a change."""
        if len(word) < 5 or sum(c.isalpha() for c in word) < 4 or re.search(r"\d\d|[@/\\=&%$#~]", word):
            return None
        odd = bool(re.search(r"(?<=[^\W\d_])[\d+(](?=[^\W\d_]|$)|^[\d+(](?=[^\W\d_]{4})|[áóíú]", word))
        if odd or any(word[k : k + 2] in ("vv", "ii") and word[k : k + 2] not in self.bigrams for k in range(len(word) - 1)):
            return next(((form, edits) for _, form, edits in forms if edits and form.isalpha() and form != word), None)
        return None


def tokens_of(line: str) -> Iterator[tuple[int, str]]:
    """(offset, core) of each word of a line, without the punctuation around it."""
    for m in TOKEN.finditer(line):
        core = m.group()
        start = m.start()
        while core and (core[0] in STRIP or (core[0] == "(" and not core[1:2].islower()) or (core[0] == "(" and ")" in core) or core[0] in "([{" and m.start() == start and line[: m.start()].rstrip()[-1:] in ".?!"):
            core, start = core[1:], start + 1
        while core and core[-1] in STRIP:
            core = core[:-1]
        if core:
            yield start, core


def like_case(form: str, model: str) -> str:
    return form.upper() if model.isupper() and len(model) > 1 else form[:1].upper() + form[1:] if model[:1].isupper() else form


def stem_of(word: str) -> str:
    return re.sub(r"'s?$", "", word.lower().replace("’", "'"))


def break_at(line: str) -> tuple[str, str, int] | None:
    """(word part, mark, its offset) if a line ends in a hyphen-like mark after a word."""
    line = line.rstrip()
    if len(line) < 2 or line[-1] not in MARKS or not (line[-2].isalnum() or line[-2] in "+(áóéíú"):
        return None
    left_at = max(line.rfind(" "), line.rfind("\t")) + 1
    left = line[left_at:-1].lstrip(STRIP + "([{")
    return (left, line[-1], len(line) - 1 - len(left)) if left else None


def first_word(line: str) -> tuple[str, int]:
    m = TOKEN.search(line)
    return (m.group().rstrip(STRIP + ")]}"), m.start()) if m else ("", 0)


def parts_of(whole: str) -> list[str]:
    """The stems under which a word, and each part of a compound, is looked up."""
    pieces = re.split(r"-", whole)
    return [whole.lower(), *(stem_of(x) for x in ([whole] if len(pieces) == 1 else pieces))]


def broken_terms(left: str, right: str) -> list[str]:
    """What must be known of a word that is broken over two lines."""
    tail = left.rsplit("-", 1)[-1]
    return [tail.lower(), right.lower(), (tail + right).lower(), f"{tail}-{right}".lower(), f"{left}-{right}".lower(), *parts_of(left + right), *parts_of(left), *parts_of(right)]


def page_terms(lines: list[str], body: list[int], common: set[str], cache: dict[str, tuple[str, ...]]) -> set[str]:
    """All words of a page that a repair may have to look up, without the common ones."""
    out: set[str] = set()
    for t in {t for k in body for t in lines[k].split()}:
        terms = cache.get(t)
        if terms is None:
            # what stands before a word may decide whether its bracket belongs to it
            cores = {core for x in ("x " + t, "x. " + t) for _, core in list(tokens_of(x))[1:]}
            terms = cache[t] = tuple({w for core in cores for w in parts_of(core)} - common - {""})
        out.update(terms)
    for n, k in enumerate(body):
        broken = break_at(lines[k])
        if broken:
            out.update(set(broken_terms(broken[0], first_word(lines[body[n + 1]])[0] if n + 1 < len(body) else "")) - common)
    out.discard("")
    return out


def inspect_page(text: str, page_number: int, furniture: set[int], words: Words, editor: Editor, before: str = "", after: str = "") -> tuple[dict[int, set[str]], str, bool]:
    """Kinds of repair of each line (from 1), the repaired text as paragraphs, and whether it continues the page before.

    furniture: numbers (from 0) of lines to drop. before: the last line of the text of the page before; after:
    the first line of that of the next page. A word broken over two pages is put together at the end of the first.
    """
    lines = [line.rstrip("\r") for line in text.split("\n")]
    kinds: dict[int, set[str]] = defaultdict(set)
    for k in furniture:
        kinds[k + 1] = {"furniture"}
    body = [k for k, line in enumerate(lines) if line.strip() and k not in furniture]
    fixed = {k: lines[k].rstrip() for k in body}
    glued: dict[int, bool] = {}
    taken: set[tuple[int, int]] = set()
    fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)

    def check(parts: list[tuple[int, int, str]]) -> None:
        """Correct the word that the parts (line, offset, text) make together; hyphenated ones part by part.

        Parts on other pages have line -1.
        """
        whole = "".join(p[2] for p in parts)
        if re.fullmatch(r"[\W\d_]+", whole) or words.known(whole.lower()):
            return
        pieces = re.split(r"(-)", whole)
        at = 0
        for piece in pieces:
            stem = stem_of(piece)
            if len(stem) >= (2 if len(pieces) == 1 else 4):
                found = words.repair(stem)
                if found:
                    form, edits = found
                    for line, _ in {(where(parts, at + e)) for e in edits}:
                        if line >= 0:
                            kinds[line + 1].add("misread")
                    if len(parts) == 1:
                        line, offset, _ = parts[0]
                        now = lines[line][offset + at : offset + at + len(stem)]
                        fixes[line].append((offset + at, len(stem), like_case(form, now)))
            at += len(piece)

    def where(parts: list[tuple[int, int, str]], at: int) -> tuple[int, int]:
        for line, offset, t in parts:
            if at < len(t):
                return line, offset + at
            at -= len(t)
        return parts[-1][0], parts[-1][1]

    start = 0  # offset in the first line of the text behind the rest of a word that began on the page before
    if body:
        broken = break_at(before)
        right, right_at = first_word(lines[body[0]])
        if broken and right:
            left, mark, _ = broken
            if editor.joins(left.rsplit("-", 1)[-1], mark, right, words):
                check([(-1, 0, left), (body[0], right_at, right)])
                taken.add((body[0], right_at))
                start = len(TOKEN.match(lines[body[0]], right_at).group()) + right_at
    rest = ""
    for n, k in enumerate(body):
        broken = break_at(lines[k])
        if broken is None:
            continue
        left, mark, left_at = broken
        nxt = body[n + 1] if n + 1 < len(body) else None
        line_after = lines[nxt] if nxt is not None else after
        right, right_at = first_word(line_after)
        glued[k] = editor.joins(left.rsplit("-", 1)[-1], mark, right, words)
        if glued[k]:
            kinds[k + 1].add("hyphen")
            if nxt is None and right:
                rest = TOKEN.match(line_after, right_at).group()
        taken.add((k, left_at))
        if right:
            if nxt is not None:
                taken.add((nxt, right_at))
            if glued[k]:
                check([(k, left_at, left), (nxt if nxt is not None else -1, right_at, right)])
            elif not words.known(f"{left}-{right}".lower()):
                check([(k, left_at, left)])
                if nxt is not None:
                    check([(nxt, right_at, right)])
    for k in body:
        if all(map(words.plain, lines[k].split())):  # most lines have known words only
            continue
        for offset, core in tokens_of(lines[k]):
            if words.known(core.lower()):
                continue
            if (k, offset) not in taken and not any(k == a and offset <= b < offset + len(core) for a, b in taken):
                check([(k, offset, core)])
    for k, todo in fixes.items():
        s = fixed[k]
        for offset, length, form in sorted(todo, reverse=True):
            s = s[:offset] + form + s[offset + length :]
        fixed[k] = s
    continues = bool(body) and bool(before) and (start > 0 or (not re.search(r"[.!?:;][\"'”’»)\]]*$", before.rstrip()) and lines[body[0]].strip()[:1].islower()))
    if start:
        fixed[body[0]] = fixed[body[0]][start:]
    out: list[str] = []
    last = None
    for k in body:
        s = fixed[k].strip()
        between = lines[last + 1 : k] if last is not None else []
        gap = any(not line.strip() for line in between) and not any(j in furniture for j in range((last or 0) + 1, k))
        if last is None or (last not in glued and (gap or lines[k].startswith(("    ", "\t")) or heading(lines[last]) or NUMBERED.match(s))):
            out.append(s)
        elif glued.get(last):
            out[-1] = out[-1].rstrip(MARKS + " ") + s
        elif last in glued:
            out[-1] += s
        else:
            out[-1] += " " + s
        last = k
    if rest:
        out[-1] = out[-1].rstrip(MARKS + " ") + rest
    return kinds, "\n\n".join(p for p in out if p), continues


def heading(line: str) -> bool:
    s = line.strip()
    return 3 <= len(s) < 64 and s[-1] not in ".,;:!?-" + MARKS and len(s.split()) <= 9 and not NUMBERED.match(s)


def flagged_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, page_number, text, scanned of the pages of scanned and of clean files.

    A page delivered twice counts once, with the text that arrived last (ties: the larger text). Pages without
    text or key, and files without a name or of other formats, take no part.
    """
    suffix = F.lower(F.regexp_extract("file_name", r"\.([A-Za-z0-9]+)\s*$", 1))
    kind = files.where(suffix.isin(*SCANNED, *CLEAN)).groupBy("doc_id").agg(F.max(suffix.isin(*SCANNED)).alias("scanned"))
    return (
        pages.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("page_number").isNotNull())
        .select("doc_id", "page_number", "text", "arrived_at")
        .join(kind, "doc_id")
        .groupBy("doc_id", "page_number", "scanned")
        .agg(F.max(F.struct("arrived_at", "text")).alias("last"))
        .select("doc_id", "page_number", F.col("last.text").alias("text"), "scanned")
    )


CORE = re.compile(r"^[\"'“”‘’«».,;:?!)\]}*_|(\[{]+|[\"'“”‘’«».,;:?!)\]}*_|]+$")
CAPITAL = re.compile(r"(?<!\S)[^\w\s]*[A-ZÀ-Þ]\S{4,}")
COUNTED = "kind string, doc_id string, page_number int, w string, clean bigint, n bigint"


def count_pages(pages: DataFrame) -> DataFrame:
    """kind w: counts of words, on clean and on all pages; of scanned pages also kind h: folded running titles
    (n = 1 where they stand at an edge), and kind n: counts of capitalised words of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            rows = []
            for d, n, t, scanned in zip(batch["doc_id"], batch["page_number"], batch["text"], batch["scanned"]):
                counts[bool(scanned)].update(t.lower().split())
                if scanned:
                    keys: dict[str, int] = {}
                    for _, key, edge in Page(t, n).keys():
                        keys[key] = max(keys.get(key, 0), int(edge))
                    rows.extend(("h", d, n, key, 0, edge) for key, edge in keys.items())
                    names = Counter(stem_of(core) for x in CAPITAL.findall(t) for _, core in tokens_of(x) if core[:1].isupper() and len(core) > 4)
                    rows.extend(("n", d, None, w, 0, c) for w, c in names.items() if w.isalpha())
            stems: dict[str, list[int]] = {}
            for scanned, tokens in enumerate(counts):
                for t, c in tokens.items():
                    w = stem_of(CORE.sub("", t))
                    if w:
                        held = stems.setdefault(w, [0, 0])
                        held[0] += 0 if scanned else c
                        held[1] += c
            rows.extend(("w", None, None, w, c, n) for w, (c, n) in stems.items())
            yield pd.DataFrame(rows, columns=["kind", "doc_id", "page_number", "w", "clean", "n"]).astype({"page_number": "Int32"})

    return pages.mapInPandas(run, COUNTED)


def known_word(clean: Column, n: Column, on_clean: int, on_scanned: int) -> Column:
    """Whether clean pages prove a word: they have it more than once, and at no less than a fifth of the rate of
    scanned pages, so that slips do not become words in a large corpus."""
    return F.coalesce((clean >= 2) & (clean * F.lit(max(on_scanned, 1)) * 5 >= (n - clean) * F.lit(max(on_clean, 1))), F.lit(False))


def inspect_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, kind, text, continues of each line and kind of repair, and a row of kind
    `text` (line_no 0) with each repaired page. An empty page gives only that row.

    pages: doc_id, page_number, text, scanned, a row a page.
    """
    spark = pages.sparkSession
    pages = checkpoint(pages.select("doc_id", "page_number", "text", "scanned"))
    scanned = pages.where("scanned").drop("scanned")
    counted = checkpoint(count_pages(pages))
    counts = counted.where("kind = 'w'").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"))
    total = counts.agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("clean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.when(F.col("clean") >= 2, F.length("w"))), F.lit(0)).alias("longest")).first()
    words = checkpoint(counts.withColumn("known", known_word(F.col("clean"), F.col("n"), total["clean"], total["n"] - total["clean"])))
    common = {r["w"]: r["clean"] for r in words.where("known").orderBy(F.desc("clean"), "w").limit(COMMON).collect()}
    editor = Editor().train(common)
    # running titles: those that two pages of a document or more have at an edge
    seen = counted.where("kind = 'h'").select("doc_id", "page_number", "w", "n")
    titles = seen.where("n > 0").groupBy("doc_id", "w").agg(F.count("*").alias("pages")).where("pages >= 2")
    own = seen.join(titles, ["doc_id", "w"]).groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("w", "pages")).alias("titles"))
    titled = scanned.join(own, ["doc_id", "page_number"], "left")
    place = F.xxhash64("doc_id", "page_number")
    chosen = [marked(r["text"], r["page_number"], r["titles"]) for r in titled.orderBy(place, "doc_id", "page_number").limit(TRAINING_PAGES).collect()]
    model = FurnitureModel().train(chosen)
    shared = spark.sparkContext.broadcast((set(common), (model.w, model.lower), editor.edit.w, editor.join.w, editor.ops, editor.bigrams, editor.margin))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = FurnitureModel()
        skip, (local.w, local.lower) = shared.value[:2]
        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            if len(cache) > 200_000:
                cache.clear()
            rows = []
            for d, n, t, own_titles in zip(batch["doc_id"], batch["page_number"], batch["text"], batch["titles"]):
                page = marked(t, n, own_titles)
                drop = local.lines(page)
                body = [k for k in page.filled if k not in drop]
                first, last = (page.lines[body[0]], page.lines[body[-1]]) if body else ("", "")
                rows.append((d, n, t, sorted(drop), sorted(page_terms(page.lines, body, skip, cache)), first, last))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "furniture", "terms", "first", "last"])

    found = checkpoint(titled.mapInPandas(find, "doc_id string, page_number int, text string, furniture array<int>, terms array<string>, first string, last string"))
    # the pages before and after, by number, so that no document is gathered anywhere
    ends = found.select("doc_id", "page_number", "first", "last")
    ahead = ends.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.col("last").alias("before"))
    behind = ends.select("doc_id", (F.col("page_number") - 1).alias("page_number"), F.col("first").alias("after"))

    def over_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, n, last, after in zip(batch["doc_id"], batch["page_number"], batch["last"], batch["after"]):
                broken = break_at(last)
                if broken:
                    terms = sorted(set(broken_terms(broken[0], first_word(after)[0])) - {""})
                    rows.extend((d, p, w) for p in (n, n + 1) for w in terms)
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "w"])

    crossing = ends.join(behind, ["doc_id", "page_number"]).select("doc_id", "page_number", "last", "after").mapInPandas(over_pages, "doc_id string, page_number int, w string")
    asked = checkpoint(found.select("doc_id", "page_number", F.explode("terms").alias("w")).unionByName(crossing).distinct())
    facts = checkpoint(repairs(asked, words, counted.where("kind = 'n'"), shared, total["longest"]))
    per_page = facts.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct("w", "known", "form", "edits")).alias("facts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = editor_of(shared.value)
        skip, seen = shared.value[0], {}
        for batch in batches:
            if len(seen) > 400_000:
                seen.clear()
            rows = []
            for d, n, t, drop, known, before, after in zip(*(batch[c] for c in ("doc_id", "page_number", "text", "furniture", "facts", "before", "after"))):
                lexicon = Words(skip, {x["w"]: (x["known"], x["form"], x["edits"]) for x in known} if known is not None else {}, seen)
                kinds, repaired, continues = inspect_page(t, n, set(drop), lexicon, local, before or "", after or "")
                rows.append((d, n, 0, "text", repaired, continues))
                rows.extend((d, n, line, kind, None, None) for line, ks in sorted(kinds.items()) for kind in sorted(ks))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "line_no", "kind", "text", "continues"])

    whole = found.select("doc_id", "page_number", "text", "furniture").join(per_page, ["doc_id", "page_number"], "left").join(ahead, ["doc_id", "page_number"], "left").join(behind, ["doc_id", "page_number"], "left")
    return whole.mapInPandas(run, "doc_id string, page_number int, line_no int, kind string, text string, continues boolean")


def marked(text: str, number: int, titles) -> Page:
    return Page(text, number).mark({x["w"]: int(x["pages"]) for x in titles} if titles is not None else {})


def editor_of(shared: tuple) -> Editor:
    out = Editor()
    out.edit.w, out.join.w, out.ops, out.bigrams, out.margin = shared[2:]
    return out


def repairs(asked: DataFrame, words: DataFrame, names: DataFrame, shared, longest: int) -> DataFrame:
    """doc_id, page_number, w, known, form, edits: what is known of each word a page asks for.

    The editor runs once for each distinct word that is not known. A form counts if it is a known word four
    times as frequent, or any word fifteen times as frequent, as the word it stands for; else if the document
    has it as a name more often, and twice at least; else if the word can't be right as it stands. Words longer
    than twice the `longest` known one can have no known form.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = editor_of(shared.value)
        for batch in batches:
            rows = []
            for w, n in zip(batch["w"], batch["n"]):
                forms = editor.candidates(w)
                odd = editor.suspicious(w, forms)
                rows.extend((w, n, k, form, edits, False) for k, (_, form, edits) in enumerate(forms) if edits and form != w and form)
                if odd:
                    rows.append((w, n, -1, odd[0], odd[1], True))
            yield pd.DataFrame(rows, columns=["w", "n", "rank", "form", "edits", "odd"])

    distinct = asked.select("w").distinct().join(words, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
    distinct = checkpoint(distinct)
    open_ = distinct.where(~F.col("known") & (F.length("w") > 1) & (F.length("w") <= 2 * longest + 8) & F.col("w").rlike(r"\p{L}"))
    forms = checkpoint(open_.select("w", "n").mapInPandas(run, "w string, n bigint, rank int, form string, edits array<int>, odd boolean"))
    target = words.select(F.col("w").alias("form"), F.col("n").alias("m"), F.col("known").alias("is_word"))
    often = F.greatest(F.col("n"), F.lit(1))
    good = forms.where("not odd").join(target, "form").where((F.col("is_word") & (F.col("m") >= 4 * often)) | (F.col("m") >= 15 * often))
    best = good.groupBy("w").agg(F.min_by(F.struct("form", "edits"), F.struct(~F.col("is_word"), "rank")).alias("fix"))
    odd = forms.where("odd").select("w", F.struct("form", "edits").alias("odd_fix"))
    known = checkpoint(distinct.select("w", "known").join(best, "w", "left").join(odd, "w", "left"))
    in_doc = names.groupBy("doc_id", "w").agg(F.sum("n").alias("n"))
    left = asked.select("doc_id", "w").distinct().join(known.where(~F.col("known") & F.col("fix").isNull()).select("w"), "w", "left_semi")
    named = (
        left.join(forms.where("not odd").select("w", "rank", "form", "edits"), "w")
        .join(in_doc.where("n >= 2").select("doc_id", F.col("w").alias("form"), F.col("n").alias("m")), ["doc_id", "form"])
        .join(in_doc, ["doc_id", "w"], "left")
        .where(F.col("m") > F.coalesce("n", F.lit(0)))
        .groupBy("doc_id", "w")
        .agg(F.min_by(F.struct("form", "edits"), "rank").alias("name_fix"))
    )
    every = asked.join(known, "w").join(named, ["doc_id", "w"], "left").withColumn("f", F.coalesce("fix", "name_fix", "odd_fix"))
    return every.where(F.col("known") | F.col("f").isNotNull()).select("doc_id", "page_number", "w", "known", F.col("f.form").alias("form"), F.col("f.edits").alias("edits"))
