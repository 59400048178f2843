"""Problem 5: reduce mails to what their sender newly wrote.

A mail is cut into its own part, its history (quoted lines with their introductions, forwarded messages) and
what follows its signature. Two dictionaries are formed over all mails: the paragraphs of a thread's ancestors
(what its mails quote, and what its earlier mails say), and the closings of senders (what stands after
signatures and above greetings). Every paragraph of the own part is compressed with and without the entries
that share a run of words with it. An abnormal gain flags it; flagged lines are dropped only where they really
overlap an entry, character by character; all others are preserved. No list of notices is built in.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpoint

# Words and formulas by which mail programs and writers mark parts of a mail.
HEADER = re.compile(r"(?i)\*?(subject|from|to|cc|bcc|date|sent|reply-to|betreff|von|an|datum|gesendet|objet|de|à|a|envoyé|date|asunto|para|enviado|fecha|oggetto|da|inviato|onderwerp|aan|verzonden|assunto|data)\s*:\*?\s")
SENT_FROM = re.compile(r"(?i)\*?(from|von|de|da|van)\s*:\*?\s+(?P<who>.+)$")
SENT_MORE = re.compile(r"(?i)\*?(sent|date|to|subject|cc|gesendet|datum|an|betreff|envoyé|à|objet|enviado( el)?|fecha|para|asunto|inviato|data|oggetto|verzonden|aan|onderwerp|assunto)\s*:\*?\s")
WROTE = re.compile(r"(?i)\b(wrote|writes|schrieb|a écrit|escribió|ha scritto|scrisse|schreef|escreveu)\b")
FORWARD = re.compile(
    r"(?i)^\s*(-{3,}\s*\S.*\S\s*-{3,}|_{20,}|begin forwarded message:|anfang der weitergeleiteten (nachricht|e-mail):|début du message (transféré|réexpédié)\s*:|inicio del mensaje reenviado:|inizio messaggio inoltrato:|begin doorgestuurd bericht:|início da mensagem reencaminhada:)\s*$"
)
CLOSING = re.compile(
    r"(?i)^(with )?((kind|kindest|best|warm|warmest) (regards|wishes)|best|all the best|regards|thanks( again)?|many thanks|thank you|cheers|sincerely( yours)?|yours (sincerely|faithfully|truly)|respectfully( yours)?|cordially"
    r"|(mit )?(freundlichen|besten|herzlichen) grüßen|(viele|beste|liebe|herzliche|freundliche) grüße|(mit )?(freundlichem|bestem) gruß|mfg|lg|danke|vielen dank|hochachtungsvoll"
    r"|cordialement|bien cordialement|bien à (vous|toi)|salutations( distinguées)?|(sincères|meilleures) salutations|merci|amicalement|respectueusement"
    r"|saludos( cordiales)?|un (cordial )?saludo|(muy )?atentamente|gracias|cordialmente|cordiali saluti|distinti saluti|grazie|met vriendelijke groet(en)?|vriendelijke groet(en)?|groeten|bedankt|atenciosamente|cumprimentos|com os melhores cumprimentos|obrigad[oa])\s*[,.!]?$"
)
DELIMITER = re.compile(r"^\s*(--|—|-{2,}|_{2,}|\*(\s?\*){1,}|={2,}|~{2,}|#{2,})\s*$")
POSTSCRIPT = re.compile(r"(?i)^(p\.\s?){1,3}s\.?[:.]?\s|^ps\s?[:.]\s|^p\.?p\.?s\.?\s")
QUOTED = re.compile(r"^[ \t]{0,4}[>|]")
COMPARISON = re.compile(r"^> ?\d[\d.,]* ?[^\W\d_]+")  # "> 30 days late" means more than
MONTHS = {  # fixed values: the first letters of the months' names, enough of them to tell the months apart
    "jan": 1, "gen": 1, "ene": 1, "feb": 2, "fev": 2, "mar": 3, "mrt": 3, "maa": 3, "apr": 4, "avr": 4, "abr": 4, "may": 5, "mai": 5, "mag": 5, "mei": 5, "jun": 6, "giu": 6, "juin": 6,
    "jul": 7, "lug": 7, "juil": 7, "aug": 8, "aou": 8, "ago": 8, "sep": 9, "set": 9, "oct": 10, "okt": 10, "ott": 10, "out": 10, "nov": 11, "dec": 12, "dez": 12, "dic": 12,
}
HEADER_KINDS = {w: kind for kind, words in {"sender": "from von de da van", "to": "to an à para a aan", "subject": "subject betreff objet asunto oggetto onderwerp assunto", "date": "date datum fecha data"}.items() for w in words.split()}
REPLY = re.compile(r"(?i)^\s*((re|fwd?|aw|wg|tr|rv|rif|antw|enc|sv)\s*(\[\d+\])?\s*:\s*)+")
OWN_PART, HISTORY, TAIL, TOP, END = "own", "history", "tail", "top", "end"
REACH = 32_000  # bytes that deflate looks back
SHINGLE, WINDOW = 5, 4  # words in an anchor, and anchors of which the least is kept


def address_name(field: str) -> str:
    """Who a From or To line names: the display name, else the address; lower case."""
    m = re.match(r"\s*\"?([^<\"]*)\"?\s*(?:<([^>]*)>)?", field)
    return " ".join(((m[1].strip() or m[2] or "") if m else "").lower().split())


def sent_at(field: str) -> int | None:
    """The minute a Date line names, as a number that sorts; None if it can't be read."""
    low = "".join(c for c in unicodedata.normalize("NFKD", field.lower()) if not unicodedata.combining(c))
    day = re.search(r"(\d{1,2})\.?\s+(?:de\s+)?([a-z]{3,})\.?,?\s+(?:de\s+)?(\d{4})|([a-z]{3,})\.?\s+(\d{1,2}),?\s+(\d{4})|(\d{4})-(\d\d)-(\d\d)", low)
    if not day:
        return None
    if day[7]:
        y, m, d = int(day[7]), int(day[8]), int(day[9])
    else:
        word = day[2] or day[4]
        m = MONTHS.get(word[:4]) or MONTHS.get(word[:3])
        y, d = int(day[3] or day[6]), int(day[1] or day[5])
        if not m:
            return None
    clock = re.search(r"(\d{1,2})[:h](\d\d)", low)
    return (((y * 100 + m) * 100 + d) * 100 + (int(clock[1]) if clock else 0)) * 100 + (int(clock[2]) if clock else 0)


class Mail:
    """The lines of one mail page, each with the part it belongs to; '' for blank and header lines."""

    def __init__(self, text: str):
        self.lines = [line.rstrip("\r") for line in text.split("\n")]
        self.address = ""
        self.introduced: set[int] = set()  # lines of introductions, which are paragraphs of their own
        self.part = [""] * len(self.lines)
        self.sender = self.subject = self.to = self.date = ""
        k = 0
        if HEADER.match(self.lines[0] or " "):
            while k < len(self.lines) and self.lines[k].strip():
                name, _, value = self.lines[k].partition(":")
                kind = HEADER_KINDS.get(name.strip(" *").lower())
                if kind == "sender" and not self.sender:
                    self.sender, self.address = re.match(r"\s*\"?([^<\"]*)", value)[1].strip(), address_name(value)
                elif kind and not getattr(self, kind):
                    setattr(self, kind, value.strip())
                k += 1
        self.body = k
        self.end = self.find_forward()
        for i in range(self.end, len(self.lines)):
            if self.lines[i].strip():
                self.part[i] = HISTORY
        self.find_quotes()
        self.find_tail()

    def next_text(self, k: int) -> int:
        while k < len(self.lines) and not self.lines[k].strip():
            k += 1
        return k

    def find_forward(self) -> int:
        """First line of a message that is repeated without quote marks, or the number of lines."""
        for k in range(self.body, len(self.lines)):
            line = self.lines[k]
            if FORWARD.match(line):
                nxt = self.next_text(k + 1)
                if re.search(r"[^\W_]", line) or (nxt < len(self.lines) and SENT_FROM.match(self.lines[nxt])):
                    return k
            named = SENT_FROM.match(line)
            if named and k + 1 < len(self.lines) and SENT_MORE.match(self.lines[k + 1] + " ") and not self.lines[k - 1].strip():
                return k
        return len(self.lines)

    def find_quotes(self) -> None:
        k = self.body
        while k < self.end:
            if not QUOTED.match(self.lines[k]):
                k += 1
                continue
            z = k
            while z < self.end and QUOTED.match(self.lines[z]):
                z += 1
            intro = self.introduction(k)
            # a lone comparison is the sender's own sentence, unless quoted lines or an introduction lead to it
            if COMPARISON.match(self.lines[k]) and intro is None and z == k + 1:
                k = z
                continue
            if intro is not None:
                self.introduced.update(range(intro, k))
            for i in range(k if intro is None else intro, z):
                if self.lines[i].strip():
                    self.part[i] = HISTORY
            # the rest of a quoted sentence that lost its mark when the quote was wrapped anew
            if re.search(r"[\w,;-]$", self.lines[z - 1].rstrip()) and z < self.end and self.lines[z][:1].islower():
                while z < self.end and self.lines[z].strip() and not QUOTED.match(self.lines[z]):
                    self.part[z] = HISTORY
                    z += 1
            k = z
        for k in range(self.body, self.end):  # introductions that no quoted line follows
            if not self.part[k] and self.lines[k].strip():
                nxt = self.next_text(k + 1)
                if nxt < len(self.lines) and self.part[nxt] == HISTORY:
                    first = self.introduction(nxt)
                    if first is not None and first <= k:
                        self.part[k] = HISTORY

    def introduction(self, k: int) -> int | None:
        """First line of the introduction ("On ..., ... wrote:") that ends just before line k."""
        z = k - 1
        while z > self.body and not self.lines[z].strip():
            z -= 1
        if z < self.body or not self.lines[z].rstrip().endswith(":") or self.part[z] == HISTORY:
            return None
        for a in range(z, max(self.body, z - 3) - 1, -1):
            if not self.lines[a].strip() or QUOTED.match(self.lines[a]):
                break
            joined = " ".join(self.lines[a : z + 1])
            named = re.search(r"[A-ZÀ-Ý][^\W\d_]+", self.lines[a])
            if WROTE.search(joined) and (re.search(r"\d{4}|@", joined)) and named and len(joined) < 200 and not re.search(r"[.!?]\s+[A-ZÀ-Ý][a-zà-ÿ]+ [a-z]", self.lines[a].split(",")[0]):
                return a
        return z if WROTE.search(self.lines[z]) and len(self.lines[z]) < 90 else None

    def is_name(self, line: str) -> bool:
        """Whether a line is no more than the sender's name, in full or the first name."""
        own, words = self.sender.split(), line.split()
        if not own or not words or len(words) > len(own) + 2:
            return False
        if len(words) == 1:
            return words[0] in (own[0], own[-1])
        return words[0] == own[0] and own[-1] in words

    def find_tail(self) -> None:
        """Closing formula or delimiter or name, and all after it but postscripts."""
        start = None
        for k in range(self.body, self.end):
            line = self.lines[k].strip()
            if not line or self.part[k]:
                continue
            if CLOSING.match(line) or DELIMITER.match(line) or self.is_name(line):
                if CLOSING.match(line) and not self.closes(k):
                    continue
                start = k
                break
        for k in range(self.body, self.end):
            if self.lines[k].strip() and not self.part[k]:
                self.part[k] = OWN_PART if start is None or k < start else TAIL
        if start is not None:
            k = start
            while k < self.end:
                if self.part[k] == TAIL and POSTSCRIPT.match(self.lines[k].strip()):
                    while k < self.end and self.part[k] == TAIL:
                        self.part[k] = OWN_PART
                        k += 1
                k += 1

    def closes(self, k: int) -> bool:
        """Whether little but a name and a signature follows a closing formula before the next gap."""
        nxt = self.next_text(k + 1)
        return nxt >= self.end or self.part[nxt] == HISTORY or nxt > k + 1 or self.is_name(self.lines[nxt].strip()) or bool(DELIMITER.match(self.lines[nxt])) or len(self.lines[nxt]) < 40

    def groups(self, part: str) -> list[list[int]]:
        """Paragraphs of one part as line numbers; quote marks separate as blank lines do."""
        out: list[list[int]] = []
        for k, p in enumerate(self.part):
            if p == part and bare(self.lines[k]):
                if out and out[-1][-1] == k - 1 and k - 1 not in self.introduced:
                    out[-1].append(k)
                else:
                    out.append([k])
        return out

    def paragraph(self, group: list[int]) -> str:
        """The text of a paragraph as it was typed, but for quote marks and the width of blanks."""
        return " ".join(" ".join(bare(self.lines[k]).split()) for k in group)

    def thread(self) -> str:
        """What the mails of one thread share: the subject without reply marks, and who writes to whom."""
        subject = " ".join(REPLY.sub("", self.subject).lower().split())
        return "|".join([subject, *sorted({self.address, *(address_name(t) for t in self.to.split(","))} - {""})])


def bare(line: str) -> str:
    return re.sub(r"^(\s*[>|])+", "", line).strip()


def anchors(text: str) -> list[int]:
    """Hashes under which a paragraph meets others that share a run of its words (winnowing): the least of
    each WINDOW runs of SHINGLE words, so that all texts with SHINGLE + WINDOW - 1 words in common share one."""
    words = text.split()
    marks = [xxhash.xxh64_intdigest(" ".join(words[k : k + SHINGLE])) - (1 << 63) for k in range(max(1, len(words) - SHINGLE + 1))]
    return sorted({min(marks[k : k + WINDOW]) for k in range(max(1, len(marks) - WINDOW + 1))})


PARAGRAPHS = "doc_id string, page_number int, para int, part string, plain boolean, thread string, sender string, sent bigint, lines array<int>, typed array<string>, widths array<int>, text string, anchors array<bigint>"


def mail_paragraphs(pages: DataFrame) -> DataFrame:
    """The paragraphs of each mail, with their part, thread, sender, time, line numbers (from 1) and anchors.

    A null or empty text gives none. What stands above a greeting is part `top`, the last paragraph of a mail
    without signature part `end`. `plain` paragraphs are evidence of ordinary text: those of the own part but the first,
    and in mails without signature the last two, as notices may stand there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, n, t in zip(batch["doc_id"], batch["page_number"], batch["text"]):
                if not t:
                    continue
                m = Mail(t)
                thread, sent = m.thread(), sent_at(m.date)
                own, tail = m.groups(OWN_PART), m.groups(TAIL)
                greeted = len(own) > 1 and len(m.paragraph(own[1])) < 40 and re.search(r"[,\-:]$", m.paragraph(own[1]))
                parts = [(TOP if greeted and k == 0 else END if not tail and 0 < k == len(own) - 1 else OWN_PART, g) for k, g in enumerate(own)] + [(TAIL, g) for g in tail] + [(HISTORY, g) for g in m.groups(HISTORY)]
                for k, (part, g) in enumerate(parts):
                    p = m.paragraph(g)
                    rows.append((d, n, k, part, part == OWN_PART and k > 0 and (bool(tail) or k < len(own) - 2), thread, m.address, sent, [i + 1 for i in g], [m.lines[i] for i in g], [len(" ".join(bare(m.lines[i]).split())) for i in g], p, anchors(p)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "para", "part", "plain", "thread", "sender", "sent", "lines", "typed", "widths", "text", "anchors"]).astype({"sent": "Int64"})

    return pages.select("doc_id", "page_number", "text").mapInPandas(run, PARAGRAPHS)


def closings(paragraphs: DataFrame, ratio: int = 4) -> DataFrame:
    """scope, text, anchors: what stands after signatures, above greetings, or at the end of unsigned mails.

    Scope '' holds for all: the paragraph stands in such places in mails of two senders or more, and `ratio`
    times as often as in the text, and at the top as often before a greeting as without one. Any sentence may come last in an unsigned mail; where only this speaks
    for a closing, it must come last too often for chance, given how many paragraphs there are. Scope
    's|sender' holds for a sender's mails: it stands after the signature of one, and in nobody's text. Counts
    cover the whole table; nothing is cut off.
    """
    sure, last = F.col("part").isin(TAIL, TOP), F.col("part") == END
    first = (F.col("part") == OWN_PART) & (F.col("para") == 0)
    told = paragraphs.where(sure | last | first | F.col("plain"))
    total = told.agg(F.count_if(last).alias("last"), F.count_if("plain").alias("own")).first()
    a_bit = -math.log((total["last"] + 1) / (total["last"] + total["own"] + 2))
    each = told.groupBy("text", "sender").agg(F.count_if(sure).alias("tail"), F.count_if(last).alias("last"), F.count_if("plain").alias("own"), F.count_if(first).alias("first"), F.count_if(F.col("part") == TAIL).alias("signed"), F.first("anchors").alias("anchors"))
    whole = each.groupBy("text").agg(
        *[F.sum(c).alias(c) for c in ("tail", "last", "own", "first")], F.count_if(F.col("tail") > 0).alias("senders"), F.count_if(F.col("tail") + F.col("last") > 0).alias("any"), F.first("anchors").alias("anchors")
    )
    stands = (F.col("senders") >= 2) & (F.col("tail") >= ratio * F.col("own")) & (F.col("tail") >= F.col("first"))
    ends = (F.col("any") >= 2) & (F.col("tail") + F.col("last") >= ratio * (F.col("own") + F.col("first"))) & (F.col("last") * a_bit >= math.log(total["own"] + 1) + 3)
    for_all = whole.where(stands | ends).select(F.lit("").alias("scope"), "text", "anchors")
    nobody = whole.where((F.col("own") + F.col("first") == 0) & (F.col("any") == 1)).select("text")
    of_one = each.where((F.col("signed") > 0) & (F.col("sender") != "")).join(nobody, "text", "left_semi").select(F.concat(F.lit("s|"), "sender").alias("scope"), "text", "anchors")
    return for_all.unionByName(of_one)


def ancestors(paragraphs: DataFrame) -> DataFrame:
    """scope, text, anchors, doc_id, sent, quoted, once of the paragraphs that earlier messages of a thread hold.

    They are what its mails quote or forward, and what they newly say. A paragraph that stands in two threads
    is a usual phrase, which proves no copy. One that stands `once` can be copied within a longer paragraph only.
    """
    said = paragraphs.where((F.col("part") != TAIL) & (F.col("thread") != ""))
    each = said.groupBy("text", "thread").agg(F.count("*").alias("n"))
    own = each.groupBy("text").agg(F.count("*").alias("threads"), F.sum("n").alias("n")).where("threads = 1").select("text", (F.col("n") == 1).alias("once"))
    return said.join(own, "text").select(F.concat(F.lit("t|"), "thread").alias("scope"), "text", "anchors", "doc_id", "sent", (F.col("part") == HISTORY).alias("quoted"), "once")


def packed(text: bytes, dictionary: bytes = b"") -> int:
    """Compressed size of a text after a dictionary: deflate within its reach, zstandard beyond it."""
    if max(len(text), len(dictionary)) <= REACH:
        z = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, dictionary) if dictionary else zlib.compressobj(9, zlib.DEFLATED, -15)
        return len(z.compress(text) + z.flush())
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=shared).compress(text))


def gain(paragraph: bytes, dictionary: bytes) -> tuple[float, int]:
    """What a paragraph saves with a dictionary before it: as a share of the smaller of the two, and in bytes."""
    size = packed(paragraph)
    saved = size - packed(paragraph, dictionary)
    return saved / max(1, min(size, packed(dictionary))), saved


def overlap(lengths: list[int], paragraph: str, entry: str) -> list[int]:
    """Numbers, within the paragraph, of the lines that an exact copy of the entry covers in whole, or all
    lines if the paragraph lies within the entry. `lengths` are those of the lines in the paragraph."""
    if paragraph in entry:
        return list(range(len(lengths)))
    out, at = [], paragraph.find(entry)
    while at >= 0:
        begin = 0
        for k, n in enumerate(lengths):
            if at <= begin and begin + n <= at + len(entry):
                out.append(k)
            begin += n + 1
        at = paragraph.find(entry, at + len(entry))
    return out


def copied_lines(rows: pd.DataFrame, abnormal: float = 0.5, least: int = 16) -> list[list[int]]:
    """For each row (text, widths, entry, scope) the numbers, within the paragraph, of the lines that copy the entry.

    The paragraph is compressed alone and with the entry as dictionary. Only a gain of more than `abnormal` of
    the smaller of the two flags it, with ancestors also `least` saved bytes, as short phrases agree by chance.
    What is flagged must then overlap exactly, as it was typed; all else is preserved.
    """
    out = []
    for text, widths, entry, scope in zip(rows["text"], rows["widths"], rows["entry"], rows["scope"]):
        share, saved = gain(text.encode(), entry.encode())
        flagged = share > abnormal and (saved >= least or scope[:2] != "t|")
        out.append(overlap(list(widths), text, entry) if flagged else [])
    return out


def reduce_mails(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, text of each newly written line; mails without any give no row.

    Lines of the own part that copy a closing or an ancestor are left out. Both dictionaries are tables, joined
    to the paragraphs by scope and anchor, so that no two texts with a run of words in common miss each other.
    """
    paragraphs = checkpoint(mail_paragraphs(pages))
    own = paragraphs.where(F.col("part").isin(OWN_PART, TOP, END))
    keys = ["doc_id", "page_number", "para"]
    scopes = F.array(F.lit(""), F.concat(F.lit("s|"), "sender"), F.concat(F.lit("t|"), "thread"))
    asked = own.select(*keys, "sent", "anchors", F.explode(scopes).alias("scope")).select(*keys, "sent", "scope", F.explode("anchors").alias("anchor"))
    none = F.lit(None)
    known = closings(paragraphs).select("scope", "text", "anchors", none.cast("string").alias("of"), none.cast("bigint").alias("at"), F.lit(False).alias("quoted"), F.lit(False).alias("once"))
    known = known.unionByName(ancestors(paragraphs).select("scope", "text", "anchors", F.col("doc_id").alias("of"), F.col("sent").alias("at"), "quoted", "once"))
    known = checkpoint(known)
    posted = known.withColumn("anchor", F.explode("anchors")).select("scope", "anchor", "of", "at", "quoted", F.xxhash64("text").alias("e")).distinct()
    # a mail's own quotes are its ancestors, and so is what another mail of the thread held before it
    earlier = F.col("of").isNull() | (F.col("quoted") & (F.col("of") == F.col("doc_id"))) | ((F.col("of") != F.col("doc_id")) & (F.col("at") < F.col("sent")))
    met = asked.join(posted, ["scope", "anchor"]).where(earlier).select(*keys, "scope", "e").distinct()
    entries = known.select("scope", F.xxhash64("text").alias("e"), F.col("text").alias("entry"), "once").distinct()
    lines = own.select("doc_id", "page_number", "para", "lines", "text", "widths")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (d, n, int(at[k]))
                for d, n, at, ks in zip(batch["doc_id"], batch["page_number"], batch["lines"], copied_lines(batch))
                for k in ks
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "line_no"])

    longer = ~F.col("once") | (F.length("entry") < F.length("text"))
    copies = lines.join(met, keys).join(entries, ["scope", "e"]).where(longer).select("doc_id", "page_number", "lines", "text", "widths", "entry", "scope").mapInPandas(verify, "doc_id string, page_number int, line_no int").distinct()
    typed = own.select("doc_id", "page_number", F.explode(F.arrays_zip("lines", "typed")).alias("x")).select("doc_id", "page_number", F.col("x.lines").alias("line_no"), F.col("x.typed").alias("text"))
    return typed.join(copies, ["doc_id", "page_number", "line_no"], "left_anti")
