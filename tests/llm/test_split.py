"""Problem 1: pieces by definition, properties and edge cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.sentences import BLANKS, paragraphs, sentence_spans
from paperloom.llm import split


def by_definition(text, most, least, overlap):
    """The same pieces from the listing's words, without merging."""
    para, sent, starts = {b for _, b in paragraphs(text)}, {}, []
    for a, b in paragraphs(text):
        for x, y in sentence_spans(text, a, b):
            sent[y] = (a, b)
            starts.append(x)
    end, at, out = len(text.rstrip(BLANKS)), 0, []
    skip = lambda k: next((j for j in range(k, end) if text[j] not in BLANKS), end)
    at = skip(0)
    while at < end:
        if end - at <= most:
            return [*out, (at, end)]
        span = range(at + most, at + least - 1, -1)
        cut = next((c for c in span if c in para), None)
        follow = cut
        if cut is None:
            cut = next((c for c in span if c in sent), None)
            if cut is not None:
                a, _ = sent[cut]
                follow = min((x for x in starts if max(a, cut - overlap) <= x < cut), default=cut)
        if cut is None:
            cut = next((c for c in span if text[c] in BLANKS and text[c - 1] not in BLANKS), None)
            if cut is not None:
                follow = next((k for k in range(cut - overlap, cut) if text[k] not in BLANKS and (k == 0 or text[k - 1] in BLANKS)), cut)
        if cut is None:
            cut = at + most
            follow = cut - overlap
        out.append((at, cut))
        at = skip(follow)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\nA", max_size=700), st.integers(30, 80))
def test_merging_gives_the_definition(text, most):
    got = split.split_text(text, most, most * 2 // 5, most // 7)
    assert got == by_definition(text, most, most * 2 // 5, most // 7)
    assert all(0 < z - a <= most and text[a] not in BLANKS for a, z in got)
    covered = set().union(*(range(a, z) for a, z in got)) if got else set()
    assert all(k in covered for k, c in enumerate(text) if c not in BLANKS)


def test_hard_cut_and_long_text():
    assert split.split_text("x" * 2000)[:2] == [(0, 1000), (850, 1850)]
    assert split.split_text("") == [] and split.split_text(" \n ") == []
    assert len(split.split_text("One sentence here. " * 20_000)) > 300


def test_segments_really_merge():
    """What survives is the strongest boundary of a legal piece; the rest has been joined pair by pair."""
    b = split.Boundaries("one two. Three four five\n\nsix seven eight nine")
    assert split.merge_segments(b, 0, 9, 20) == (19, split.BLANK)
    assert split.merge_segments(b, 0, 9, 18) == (14, split.BLANK)
    assert split.merge_segments(b, 0, 4, 12) == (8, split.SENTENCE)
    assert split.merge_segments(b, 0, 4, 40) == (24, split.PARAGRAPH)
    assert split.merge_segments(b, 0, 13, 13) is None


def test_lists_are_one_sentence():
    text = "1. Keep the keys.\n2. Mow the lawn.\n3. Pay the rent."
    assert [text[a:b] for a, b in sentence_spans(text, 0, len(text))] == [text]


def test_pages(spark):
    rows = [("d", 1, "A sentence is here. " * 100, "x"), ("d", 1, "A sentence is here. " * 100, "x"), ("e", 1, None, "x"), ("f", 1, "", None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string, chunk_index string")
    got = split.split_pages(pages).distinct().collect()
    assert {r["doc_id"] for r in got} == {"d"}
    assert all(r["text"] == rows[0][2][r["start_off"] : r["end_off"]] for r in got)
    assert split.split_pages(pages.limit(0)).count() == 0


def test_sentence_ends():
    t = 'Dr. No v. J. R. Doe at 5 p.m. as usual. "Did he?" counsel asked. See 40 U.S.C. § 3. (See page 4.) Paid... and gone. 1. Next'
    got = [t[a:b] for a, b in sentence_spans(t, 0, len(t))]
    assert got == ["Dr. No v. J. R. Doe at 5 p.m. as usual.", '"Did he?" counsel asked.', "See 40 U.S.C. § 3.", "(See page 4.)", "Paid... and gone.", "1. Next"]
    assert [("a\n \nb")[a:b] for a, b in paragraphs("a\n \nb")] == ["a", "b"]
