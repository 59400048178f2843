"""Problem 3 on made-up pages: the editor, line joins, furniture, and pages of a document."""

import random

import pytest

from paperloom.llm import furniture, scans

WORDS = "agreement landlord tenant witness hearing security deposit maintenance records premises payment court inspector furnish liability coverage schedule invoice notice reasonable expenses property remaining heirs standing order".split()




COMMON = {w: 60 for w in WORDS} | {"the": 900, "well-documented": 30, "well": 9, "long-term": 9}
EXTRA = [a + b for a in ("mod", "barn", "claim", "trust", "gover", "infor", "insur", "cur", "corn", "mar") for b in ("ern", "ing", "ance", "ment", "ation", "ership", "iner", "ional", "ully", "ick")]


@pytest.fixture(scope="module")
def editor():
    return scans.Editor().train(COMMON | {w: 20 for w in EXTRA})


def lookup(editor, word, common=COMMON):
    return [f for _, f, _ in editor.candidates(word) if f in common]


def test_editor_repairs_unseen_noise(editor):
    rng, right, first, total = random.Random(99), 0, 0, 0
    for w in WORDS * 6:
        made = scans.noisy(w, rng, 1)
        if made and made[0] != w and made[0] not in COMMON:
            total += 1
            found = lookup(editor, made[0])
            right += w in found
            first += [f for _, f, _ in editor.candidates(made[0])].index(w) < 3 if w in found else 0
    assert total > 80 and right / total > 0.95 and first / total > 0.8


def test_untrained_editor_ranks_worse(editor):
    """What the training is for: without it the right form is not among the first."""
    blank = scans.Editor()
    blank.ops, blank.margin = editor.ops, editor.margin
    rng, scores = random.Random(7), {True: 0, False: 0}
    for w in WORDS * 6:
        made = scans.noisy(w, rng, 1)
        if made and made[0] != w and made[0] not in COMMON:
            for trained, e in ((True, editor), (False, blank)):
                scores[trained] += [f for _, f, _ in e.candidates(made[0])][:1] == [w]
    assert scores[True] > 2 * scores[False]


def test_words_are_known_by_their_rates(spark):
    """A slip that clean pages have twice is no word when scanned pages have it all the time."""
    rows = [("tenant", 5000, 9000), ("tenarit", 2, 90), ("veranda", 2, 3), ("once", 1, 1), ("scanonly", 0, 4)]
    df = spark.createDataFrame(rows, "w string, clean bigint, n bigint")
    got = {r["w"] for r in df.where(scans.known_word(df["clean"], df["n"], 100_000, 100_000)).collect()}
    assert got == {"tenant", "veranda"}
    at_scale = df.selectExpr("w", "clean * 1000 as clean", "n * 1000 as n")
    assert {r["w"] for r in at_scale.where(scans.known_word(at_scale["clean"], at_scale["n"], 10**8, 10**8)).collect()} - {"once"} == got


def test_joins(editor):
    words = scans.Words(COMMON)
    assert editor.joins("mainten", "-", "ance", words) and editor.joins("sched", "¬", "ule", words)
    assert not editor.joins("well", "-", "documented", words) and not editor.joins("Lusibo", "-", "Neklath", words)


def test_page(editor):
    text = "FAX 01/11/2024 12:21   P.017\nthe landlord sball furnish the mainte-\nnance records of the well-\ndocumented hearing\nUnits inspected:\n33\n\n1. Deposit\nthe tenant pays\n- 3 -\nthe dep0sit"
    words = scans.Words(COMMON, {"dep0sit": (False, "deposit", [3]), "sball": (False, "shall", [1])})
    kinds, repaired, continues = scans.inspect_page(text, 2, {0, 9}, words, editor)
    assert dict(kinds) == {1: {"furniture"}, 10: {"furniture"}, 2: {"hyphen", "misread"}, 11: {"misread"}}
    assert "shall furnish the maintenance records of the well-documented hearing" in repaired and "the deposit" in repaired and "FAX" not in repaired and not continues
    assert scans.inspect_page("", 1, set(), words, editor) == ({}, "", False)
    scans.inspect_page("word " * 30_000, 1, set(), words, editor)


def test_word_broken_over_pages(editor):
    words = scans.Words(COMMON)
    kinds, first, _ = scans.inspect_page("the landlord signed the agree-", 1, set(), words, editor, after="ment with the tenant")
    assert first == "the landlord signed the agreement" and dict(kinds) == {1: {"hyphen"}}
    kinds, second, continues = scans.inspect_page("ment with the tenant", 2, set(), words, editor, before="the landlord signed the agree-")
    assert second == "with the tenant" and continues and not kinds
    # a misread first word is no rest of a word unless the page before breaks off
    words = scans.Words(COMMON, {"tenarit": (False, "tenant", [3, 4])})
    kinds, text, continues = scans.inspect_page("tenarit pays", 2, set(), words, editor, before="The landlord and the")
    assert dict(kinds) == {1: {"misread"}} and text == "tenant pays" and continues


def pages_for_training(n=60):
    rng, out = random.Random(2), []
    for d in range(n):
        title = " ".join(rng.sample(["Expert", "Opinion", "Motion", "Report", "Manual", "Binder"], 2))
        forms = rng.choice([lambda p: f"- {p} -", lambda p: f"p. {p}", lambda p: f"FAX 01/{p:02d}/2024 12:{10 + p}   P.{p:03d}", lambda p: f"Page {p} of 4"])
        for p in range(1, 5):
            body = "\n".join("the " + " ".join(rng.sample(WORDS, 9)) for _ in range(9)) + "."
            out.append((f"d{d}", p, f"{title}\n\n{body}\nUnits inspected:\n{rng.randint(10, 99)}\n\n1. {title.split()[0]}\n{body}\n\n{forms(p)}", {furniture.folded(title): 4}))
    return out


@pytest.fixture(scope="module")
def model():
    return furniture.FurnitureModel().train([furniture.Page(t, p).mark(titles) for _, p, t, titles in pages_for_training()])


def test_furniture_is_learned(model):
    """No form is built in: page numbers and titles are told from figures, headings and the document's title."""
    for _, p, t, titles in pages_for_training(6):
        page = furniture.Page(t, p).mark(titles)
        last = len(page.lines) - 1
        assert model.lines(page) == ({last} if p == 1 else {0, last})
    title = furniture.folded("Expert Opinion")
    assert furniture.folded("Expcrt 0pinion") == title
    inside = furniture.Page("the tenant pays the\n- 7 -\nsecurity deposit to the landlord\nand the witness agrees to the hearing of the court.", 2).mark({})
    assert model.lines(inside) == {1}
    assert model.lines(furniture.Page("", 1).mark({})) == set() and furniture.FurnitureModel().train([]).w == {}


def test_scans_on_tables(spark):
    body = "the landlord shall furnish the maintenance records of the hearing and the tenant pays the security deposit for the premises\n"
    rows = [("c", n, body * 10 + " ".join(WORDS * 3) + " a well-documented long-term deal " * 3, False) for n in range(5)] + [("s", 1, body + "the dep0sit of the tenant", True), ("s", 2, "", True), ("s", 3, body, True), ("t", 1, body + "the security depos-", True), ("t", 2, "it of the tenant", True)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, scanned boolean").selectExpr("*", "1 as facts", "2 as titles", "3 as kind")
    got = scans.inspect_pages(pages).collect()
    assert {(r["doc_id"], r["page_number"], r["line_no"], r["kind"]) for r in got if r["kind"] != "text"} == {("s", 1, 2, "misread"), ("t", 1, 2, "hyphen")}
    texts = {(r["doc_id"], r["page_number"]): (r["text"], r["continues"]) for r in got if r["kind"] == "text"}
    assert len(texts) == 5 and texts["t", 1][0].endswith("the security deposit") and texts["t", 2] == ("of the tenant", True) and texts["s", 2] == ("", False)
    assert scans.inspect_pages(pages.limit(0)).count() == 0


def test_latest_delivery_counts(spark):
    files = spark.createDataFrame([("a", "a.PDF"), ("a", "a.PDF"), ("b", "b.txt"), ("c", None), ("d", "d.zip")], "doc_id string, file_name string")
    pages = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, "new", 2), ("b", 1, "x", 1), ("c", 1, "x", 1), ("d", 1, "x", 1), ("a", None, "x", 1), ("a", 2, None, 1)], "doc_id string, page_number int, text string, arrived_at int")
    got = {(r["doc_id"], r["page_number"], r["text"], r["scanned"]) for r in scans.flagged_pages(pages, files).collect()}
    assert got == {("a", 1, "new", True), ("b", 1, "x", False)}
