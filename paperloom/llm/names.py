"""Problem 2, first part: what a typed name says, and when two names can be one party."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Titles, suffixes, legal forms, usual abbreviations and nicknames.
TITLES = frozenset("mr mrs ms miss mx dr prof professor hon honorable judge justice sir madam rev mme mlle herr frau sra srta don".split())
POSTNOMINALS = frozenset("esq esquire phd md jd cpa dds rn".split())
SUFFIXES = {"sr": "sr", "senior": "sr", "jr": "jr", "junior": "jr", "ii": "ii", "iii": "iii", "iv": "iv"}
LEGAL = frozenset("inc incorporated llc ltd limited corp corporation lp llp plc co company gmbh ag sa srl bv nv pllc pc".split())
LEGAL_PHRASES = re.compile(r"\b(limited liability company|limited partnership|limited liability partnership|public limited company)\b")
SMALL = frozenset("the and of & y und et".split())
OTHERWISE = re.compile(r"(?i)[\s,(]*\b(?:d\s?[/.]?\s?b\s?[/.]?\s?a\b\.?|a\s?[/.]\s?k\s?[/.]\s?a\b\.?|aka\b|f\s?[/.]?\s?k\s?[/.]?\s?a\b\.?|t\s?/\s?a\b|trading as\b|doing business as\b|(?:formerly|also|now) known as\b|formerly\b|n[ée]e\b)[\s:]*")
BUSINESS = frozenset(
    """realty holdings steel manufacturing garden supply transport group freight services energy industries insurance brokers marine engineering
    food distribution event catering software laboratories medical associates property development international trading mutual partners building management
    bank trust capital consulting construction logistics media pharma solutions systems technologies ventures enterprises industries agency
    foundation institute university college school hospital clinic church county city state department ministry union association society club""".split()
)
ABBREVIATED = dict(
    pair.split("=")
    for pair in """mfg=manufacturing mfr=manufacturing mgmt=management mgt=management bldg=building bldgs=building distrib=distribution dist=distribution distr=distribution
    svc=services svcs=services serv=services servs=services service=services ins=insurance intl=international int=international engr=engineering eng=engineering engg=engineering
    ind=industries inds=industries indus=industries hldg=holdings hldgs=holdings holding=holdings lab=laboratories labs=laboratories laboratory=laboratories
    assoc=associates assocs=associates assn=association ptnr=partners ptnrs=partners ptrs=partners prop=property props=property dev=development devt=development devel=development
    transp=transport trans=transport trnsp=transport gp=group grp=group med=medical sup=supply suppl=supply soft=software sw=software trdg=trading trad=trading
    brkrs=brokers brok=brokers brkr=brokers cat=catering cater=catering evt=event frt=freight nrg=energy mar=marine mut=mutual rlty=realty gdn=garden gard=garden stl=steel""".split()
)
NICKNAMES = {
    nick: full.split(",")
    for nick, full in (
        pair.split("=")
        for pair in """alex=alexander,alexandra al=albert,alan,alfred sandy=alexander,alexandra tony=anthony ben=benedict,benjamin benny=benedict,benjamin chuck=charles charlie=charles chas=charles
    chris=christopher,christine,christian kit=christopher,katherine topher=christopher deb=deborah debbie=deborah debby=deborah dot=dorothy dottie=dorothy dolly=dorothy ed=edward,edmund,edwin eddie=edward ned=edward ted=theodore,edward teddy=theodore
    liz=elizabeth beth=elizabeth lizzie=elizabeth eliza=elizabeth betty=elizabeth betsy=elizabeth bess=elizabeth libby=elizabeth fred=frederick freddy=frederick freddie=frederick rick=frederick,richard gabe=gabriel harry=harold,henry hal=harold hank=henry
    bella=isabella izzy=isabella isa=isabella belle=isabella jen=jennifer jenny=jennifer jenn=jennifer joe=joseph joey=joseph jos=joseph,josé pepe=jose josie=josephine jo=josephine,joanna kate=katherine kathy=katherine katie=katherine kat=katherine kay=katherine kitty=katherine
    larry=lawrence laurie=lawrence len=leonard lenny=leonard leo=leonard maggie=margaret meg=margaret peggy=margaret marge=margaret greta=margaret mike=michael mick=michael mickey=michael mikey=michael nate=nathaniel nat=nathaniel nathan=nathaniel ollie=oliver noll=oliver
    pat=patricia,patrick patty=patricia trish=patricia tricia=patricia becky=rebecca becca=rebecca reba=rebecca rich=richard dick=richard richie=richard ricky=richard rob=robert bob=robert bobby=robert robbie=robert bert=robert sam=samuel,samantha sammy=samuel
    sue=susan susie=susan suzy=susan theo=theodore vicky=victoria tori=victoria vic=victoria,victor vince=vincent vinny=vincent vin=vincent bill=william will=william billy=william willy=william liam=william jim=james jimmy=james jack=john johnny=john jon=jonathan
    dan=daniel danny=daniel dave=david matt=matthew nick=nicholas steve=stephen,steven tom=thomas tommy=thomas tim=timothy greg=gregory jeff=jeffrey ken=kenneth ron=ronald don=donald andy=andrew drew=andrew phil=philip ray=raymond abby=abigail cathy=catherine cate=catherine cindy=cynthia
    jess=jessica kim=kimberly mandy=amanda nancy=ann peg=margaret sally=sarah terry=teresa,terence wendy=gwendolyn ingy=ingrid""".split()
    )
}
GIVEN = frozenset(n for full in NICKNAMES.values() for n in full) | frozenset("hugo olga mei kwame yusuf priya amara zoe renee jose ingrid anna maria peter paul mark george frank laura julia emma lucas".split())


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def plain_word(word: str) -> str:
    return re.sub(r"[\W\d_]", "", plain(word))


def skeleton(word: str) -> str:
    """A spelling that sounds, doubled letters and accents do not change."""
    w = plain_word(word).replace("ph", "f").replace("ck", "k")
    w = w.translate(str.maketrans("cqy", "kki"))
    return re.sub(r"(.)\1+", r"\1", w)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, in a band; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def near(word: str, words: Iterable[str]) -> str | None:
    """The one word within a single edit of `word`, if there is just one."""
    found = {w for w in words if abs(len(w) - len(word)) <= 1 and (w[0] == word[0] or w[1:2] == word[:1] or w[-2:] == word[-2:]) and distance(word, w, 1) == 1}
    return found.pop() if len(found) == 1 else None


class Reader:
    """Reads names, with the given names and business words that the corpus itself shows."""

    def __init__(self, given: Iterable[str] = (), business: Iterable[str] = ()):
        self.business = BUSINESS | set(business)
        self.given = GIVEN | (set(given) - self.business - LEGAL)
        self.cache: dict[str, str | None] = {}

    def business_word(self, w: str) -> str | None:
        start, mark, end = w.partition("'")
        if mark:  # eng'g, internat'l: what stands around the apostrophe are the ends of the word
            w = start + end.replace("'", "")
            fits = {b for b in self.business if b.startswith(start) and b.endswith(end) and len(b) > len(w)} if len(start) > 1 and end else set()
            if w not in ABBREVIATED and len(fits) == 1:
                return fits.pop()
        if w in ABBREVIATED:
            return ABBREVIATED[w]
        if w in self.business:
            return w
        key = "b:" + w
        if key not in self.cache:
            self.cache[key] = near(w, self.business) if len(w) >= 5 else None
        return self.cache[key]

    def seems_given(self, w: str) -> bool:
        """Whether a word is a given name, an initial, or a slip of a given name. It stays as it is typed."""
        if w in self.given or w in NICKNAMES or len(w) == 1:
            return True
        key = "g:" + w
        if key not in self.cache:
            self.cache[key] = near(w, self.given) if len(w) >= 4 else None
        return self.cache[key] is not None

    def read(self, name: str) -> list[dict]:
        """The forms a name gives: the first is the name itself, others are names it says it also has."""
        out: list[dict] = []
        for part in OTHERWISE.split(name):
            if part and part.strip(" ,()"):
                out.extend(self.read_one(part))
        return out

    def read_one(self, name: str) -> list[dict]:
        raw = " ".join(name.split()).strip(" ,()")
        low = plain(raw).replace("’", "'").replace("int'l", "intl").replace("'n'", " ")
        low = re.sub(r"\b([a-z])\.(?=[a-z]\.)", r"\1", low)  # L.L.C. and L.P. become one word ...
        low = LEGAL_PHRASES.sub(" llc ", low)
        if not re.search(r"[^\W\d_]", low):
            return []
        letters = re.sub(r"[^\w]", "", raw)
        if re.fullmatch(r"[^\W\d_]{2,5}", letters) and " " not in raw and (raw.isupper() or letters.lower() not in self.given):
            return [{"kind": "acronym", "core": letters.lower(), "given": "", "middle": "", "suffix": "", "acr": "".join(sorted(letters.lower()))}]
        words = re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*|,|&", low)
        words = [x for w in words for x in (([*w] if len(w) == 2 and w + "." in low and "." in raw and re.search(rf"\b{w[0]}\.{w[1]}\.", plain(raw)) and w not in LEGAL else [w]))]
        content = [w for w in words if w not in SMALL and w != ","]
        kinds = [self.business_word(w) for w in content]
        legal = any(w in LEGAL for w in content)
        if legal or sum(k is not None for k in kinds) >= 2 or (any(kinds) and len(content) > 1 and not any(self.seems_given(w) for w in content)):
            trade = sorted({k for k in kinds if k})
            rest = [w for w, k in zip(content, kinds) if not k and w not in LEGAL]
            if not rest:
                rest = [w for w in content if w not in LEGAL][:1]
            core = max(rest, key=len, default="")
            acr = "".join((w if w == core else k)[0] for w, k in zip(content, kinds) if w == core or k)
            return [{"kind": "org", "core": plain_word(core), "given": " ".join(trade), "middle": "", "suffix": "", "acr": "".join(sorted(acr))}] if core else []
        return self.read_person(words, low)

    def read_person(self, words: list[str], low: str = "") -> list[dict]:
        suffix = next((SUFFIXES[w] for w in words if w in SUFFIXES), "")
        words = [w for w in words if w not in SUFFIXES and w not in TITLES and w not in POSTNOMINALS and w != "&"]
        while words and words[-1] == ",":
            words.pop()
        while words and words[0] == ",":
            words.pop(0)
        if not words:
            return []
        if "," in words:
            k = words.index(",")
            last, first = [w for w in words[:k] if w != ","], [w for w in words[k + 1 :] if w != ","]
            if len(last) > 1 and not first:
                last, first = last[-1:], last[:-1]
        else:
            known = [self.seems_given(w) or (len(w) <= 4 and f"{w}." in low and any(g.startswith(w) for g in self.given)) for w in words]
            if len(words) == 1:
                last, first = words, []
            elif not known[0] and any(known[1:]) and (known[-1] or len(words[-1]) == 1):
                last, first = words[:1], words[1:]
            else:
                last, first = words[-1:], words[:-1]
        given = first[0] if first else ""
        middle = next((w[0] for w in first[1:] if w), "")
        cores = [plain_word(c) for c in (last[-1] if last else given).split("-")]
        return [{"kind": "person", "core": c, "given": given, "middle": middle, "suffix": suffix, "acr": ""} for c in cores if c]


def same_given(a: str, b: str, own: Iterable[str] = GIVEN) -> bool:
    """Whether two given names, of which none is a bare initial, can be one. Two that are both known as names of
    their own (`own`) are one if they sound alike or one is short for the other, but not by a slip."""
    if a != b and set(NICKNAMES.get(a, ())) & set(NICKNAMES.get(b, ())):
        return True
    if a == b or b in NICKNAMES.get(a, ()) or a in NICKNAMES.get(b, ()) or skeleton(a) == skeleton(b):
        return True
    if a in GIVEN and b in GIVEN:
        return False
    apart = a in own and b in own
    a, b = skeleton(a), skeleton(b)
    short, long = sorted((a, b), key=len)
    return (len(short) >= 2 and long.startswith(short)) or (not apart and len(short) >= 4 and len(long) >= 5 and distance(a, b, 1) <= 1)


def blocks(form: dict) -> list[str]:
    """Where forms of one party meet: the line of business, or the initial sound of each given name that may be meant.

    Sounds are those of `skeleton`, so Catherine and Katherine meet.
    """
    if form["kind"] != "person":
        return [form["given"]]
    g = form["given"]
    full = [] if g in GIVEN else NICKNAMES.get(g, [])
    return list(dict.fromkeys(skeleton(f)[:1] for f in full)) or [skeleton(g)[:1]]


def edits_allowed(a: str, b: str) -> int:
    """Slips that two names may be apart: short names with a slip are other names."""
    size = max(len(a), len(b))
    return 0 if size < 4 else 1 if size < 7 else 2


def close(a: str, b: str) -> int:
    """0, 1 or 2 edits between two spellings, as typed or as they sound; 3 if there are more."""
    return min(distance(a, b, 2), distance(skeleton(a), skeleton(b), 2) or 1) if a != b else 0


class GivenIndex:
    """Given names seen so far, by all that `same_given` can go by: sound, beginnings, nicknames and single slips."""

    def __init__(self) -> None:
        self.order: dict[str, int] = {}
        self.by_key: dict[str, list[str]] = {}

    @staticmethod
    def keys(g: str) -> tuple[set[str], set[str]]:
        """(keys to be found under, keys to look up)."""
        sk = skeleton(g)
        full = {f"n:{f}" for f in (g, *NICKNAMES.get(g, ()))}
        slips = {f"d:{sk}", *(f"d:{sk[:k]}{sk[k + 1 :]}" for k in range(len(sk)))} if len(sk) >= 4 else set()
        heads = [sk[:k] for k in range(2, len(sk) + 1)]
        return {f"s:{sk}", *(f"h:{h}" for h in heads)} | full | slips, {f"h:{sk}", *(f"s:{h}" for h in heads), f"s:{sk}"} | full | slips

    def add(self, g: str) -> None:
        self.order[g] = len(self.order)
        for key in self.keys(g)[0]:
            self.by_key.setdefault(key, []).append(g)

    def like(self, g: str) -> list[str]:
        """The names that may be one with g, in the order they were added."""
        found = {h for key in self.keys(g)[1] for h in self.by_key.get(key, ())}
        return sorted(found, key=self.order.__getitem__)


def resolve(forms: list[tuple[str, str, str, str, int]], own: Iterable[str] = ()) -> list[tuple[list[str], bool]]:
    """Parties of one family of names: for each form (kind, given, middle, suffix, count) the labels it
    can stand for, and whether a given name or business other than a nickname or initial stands behind them.

    Of persons, given names (nicknames and slips included), generations and, where they differ, middle
    initials tell parties apart; of organisations, their line of business. A form that leaves something
    open gets all the parties that fit. `own` are given names that the corpus shows as names of their own.
    """
    own = GIVEN | set(own)
    labels: list[list[str]] = [[] for _ in forms]
    persons = [i for i, f in enumerate(forms) if f[0] == "person"]
    weight: dict[str, int] = {}
    for i in persons:
        g = forms[i][1]
        if len(g) > 1:
            weight[g] = weight.get(g, 0) + forms[i][4]
    roots: dict[str, str] = {}
    seen = GivenIndex()
    for g in sorted(weight, key=lambda g: (g in NICKNAMES and g not in GIVEN, len(g) < 4, g not in GIVEN, -weight[g], g)):
        fit = next((roots[h] for h in seen.like(g) if same_given(g, h, own) and (h == roots[h] or skeleton(h) == skeleton(roots[h]))), g)
        roots[g] = fit
        seen.add(g)
    groups: dict[str, list[int]] = {}
    for i in persons:
        if len(forms[i][1]) > 1:
            groups.setdefault(roots[forms[i][1]], []).append(i)
    parties: list[tuple[str, str, str]] = []
    for g, rows in groups.items():
        suffixes = sorted({forms[i][3] for i in rows} - {""})
        for s in suffixes or [""]:
            mids = sorted({forms[i][2] for i in rows if forms[i][3] in ("", s)} - {""}) if len(suffixes) < 2 else sorted({forms[i][2] for i in rows if forms[i][3] == s} - {""})
            parties.extend((g, m, s) for m in (mids if len(mids) > 1 else [mids[0] if mids else ""]))
    by_root: dict[str, list[tuple[str, str, str]]] = {}
    by_sound: dict[str, list[tuple[str, str, str]]] = {}
    for p in parties:
        by_root.setdefault(p[0], []).append(p)
        by_sound.setdefault(skeleton(p[0])[:1], []).append(p)
    for i in persons:
        _, given, middle, suffix, _ = forms[i]
        near_by = parties if given == "" else by_sound.get(skeleton(given)[:1], []) if len(given) == 1 else by_root.get(roots[given], [])
        fits = [p for p in near_by if (not middle or not p[1] or p[1] == middle) and (not suffix or not p[2] or p[2] == suffix)]
        labels[i] = ["p|" + "|".join(p) for p in fits] or [f"p|{given}||{suffix}"]
    orgs = [i for i, f in enumerate(forms) if f[0] == "org"]
    trades = sorted({forms[i][1] for i in orgs}, key=lambda t: (-len(t.split()), t))
    whole = [t for t in trades if not any(set(t.split()) < set(u.split()) for u in trades)]
    for i in orgs:
        t = set(forms[i][1].split())
        labels[i] = ["o|" + u for u in whole if t <= set(u.split())]
    full = {roots[g] for g in weight if g in GIVEN or (g not in NICKNAMES and len(g) > 3)}
    return [(label, any(x[0] == "o" or x.split("|")[1] in full for x in label)) for label in labels]
