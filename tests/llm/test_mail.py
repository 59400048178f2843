"""Problem 5 on made-up mails: parts, learned closings, thread ancestors, and text that must stay."""

import pytest

from paperloom.llm import mail

MAIL = """Subject: Re: keys
From: Anna Doe <anna.doe@law.example>
To: Bob Roe <bob.roe@law.example>
Date: 1 May 2024 10:00

[EXTERNAL] This message comes from outside the organisation.

Hi Bob,

> 30 days late is what the contract calls a default.

On 9 May 2023, Bob Roe
<bob.roe@law.example> wrote:
> Where are the keys?
My answer stands here.
> And the copies?

From: May the rent includes water.

Best regards,
Anna

--
Anna M. Doe
tel. 555-0100

P.S. One more thing.

This e-mail and any attachments are confidential and may be privileged.
If you are not the intended recipient, please delete it.

---------- Forwarded message ---------
From: Carl Coe <carl@x.example>
Sent: 2 May 2023
Subject: keys

Old text."""

HEAD = "Subject: {s}\nFrom: {f} Doe <{f}@b.c>\nTo: {t} Doe <{t}@b.c>\nDate: {d} May 2024 10:00\n\n"


def head(f="Anna", t="Bob", s="keys", d=1):
    return HEAD.format(f=f, t=t, s=s, d=d)


def written(spark, texts):
    rows = [(f"d{n}", 1, t) for n, t in enumerate(texts)]
    got = mail.reduce_mails(spark.createDataFrame(rows, "doc_id string, page_number int, text string").selectExpr("*", "1 as sent", "'x' as sender")).collect()
    out = [[] for _ in texts]
    for r in sorted(got, key=lambda r: r["line_no"]):
        assert texts[int(r["doc_id"][1:])].split("\n")[r["line_no"] - 1].rstrip("\r") == r["text"]
        out[int(r["doc_id"][1:])].append(r["text"])
    return out


NOTICES = ["[EXTERNAL] This message comes from outside the organisation.", "This e-mail and any attachments are confidential and may be privileged.\nIf you are not the intended recipient, please delete it."]


def test_mail(spark):
    others = [f"{head(f)}{NOTICES[0]}\n\nHi Bob,\n\nText of {f} is here.\n\nBest,\n{f} Doe\n\n{NOTICES[1]}" for f in ("Carl", "Dora", "Emil", "Fred")]
    want = ["Hi Bob,", "> 30 days late is what the contract calls a default.", "My answer stands here.", "From: May the rent includes water.", "P.S. One more thing."]
    got = written(spark, [MAIL, MAIL.replace("\n", "\r\n"), *others])
    assert got[0] == got[1] == want
    assert got[2:] == [["Hi Bob,", f"Text of {f} is here."] for f in ("Carl", "Dora", "Emil", "Fred")]


def test_nothing_and_much(spark):
    got = written(spark, ["", None, "just text\n\nmore", "> x\n" * 20_000, "word " * 40_000, head()])
    assert got[:3] == [[], [], ["just text", "more"]] and got[3] == got[5] == [] and len(got[4]) == 1
    empty = spark.createDataFrame([], "doc_id string, page_number int, text string")
    assert mail.reduce_mails(empty).count() == 0


def test_new_text_that_looks_like_a_notice_stays(spark):
    lines = ["Attention: the meeting moved to 3 pm.", "Warning: the second invoice is overdue.", "External: the auditors arrive on Monday.", "Please consider the environment before the board decides on the new plant."]
    got = written(spark, [head() + "Hi Bob,\n\n" + "\n\n".join(lines) + "\n\nBest,\nAnna"])
    assert got == [["Hi Bob,", *lines]]


def test_only_exact_copies_of_ancestors_go(spark):
    old = "The tenant paid invoice 4711 over 950 dollars on 3 May 2024 into the trust account of the firm."
    new = old.replace("4711", "4712").replace("950", "875")
    intro = "On 9 May 2023, Bob Doe <bob@b.c> wrote:"
    got = written(spark, [f"{head()}Hi Bob,\n\n{old}\n\n{new}\n\n{intro}\n> {old}\n\nBest,\nAnna"])
    assert got == [["Hi Bob,", new]]


def test_copies_of_earlier_mails_of_the_thread_go(spark):
    said = "The boiler in the northern workshop was replaced before the hearing."
    first, second = f"{head()}Hi Bob,\n\n{said}\n\nBest,\nAnna", f"{head('Bob', 'Anna', 'RE: keys', 2)}Hi Anna,\n\nAgreed, and thanks.\n\n{said}\n\nBest,\nBob"
    assert written(spark, [first, second]) == [["Hi Bob,", said], ["Hi Anna,", "Agreed, and thanks."]]
    # in another thread the same sentence is a usual phrase, and no copy is proven
    third = f"{head('Carl', 'Dora', 'rent')}{said}\n\nBest,\nCarl"
    assert written(spark, [first, second, third])[1] == ["Hi Anna,", "Agreed, and thanks.", said]


def test_ancestors_that_stand_once_go_from_longer_paragraphs(spark):
    said = "The boiler in the northern workshop was replaced before the hearing."
    first = f"{head()}Hi Bob,\n\n{said}\n\nBest,\nAnna"
    longer = f"{head('Bob', 'Anna', 'RE: keys', 2)}Hi Anna,\n\n{said}\nThe new invoice follows on Monday.\n\nBest,\nBob"
    assert written(spark, [first, longer])[1] == ["Hi Anna,", "The new invoice follows on Monday."]


def test_short_phrases_of_ancestors_stay(spark):
    assert written(spark, [f"{head()}Yes.\n\nOn 9 May 2023, Bob Doe <bob@b.c> wrote:\n> Yes."]) == [["Yes."]]


def test_closings_of_all_and_of_one_sender(spark):
    mill = "Printed on paper from the northern forest mill."
    mails = [f"{head(f)}Text of {f} is here.\n\nBest,\n{f}\n\n{mill}" for f in ("Carl", "Dora", "Emil")]
    own = "Anna Doe - keeper of the large seal"
    mails += [f"{head(d=3)}First text.\n\nBest,\nAnna\n\n{own}", f"{head(d=4)}Second text.\n\n{own}", f"{head('Hugo')}No signature here.\n\n{mill}", f"{head('Ida')}{mill[:-1]} or so.\n\nBest,\nIda"]
    assert written(spark, mails)[3:] == [["First text."], ["Second text."], ["No signature here."], [mill[:-1] + " or so."]]


def test_many_closings_and_long_history(spark):
    """Neither a count of closings nor the reach of a compressor bounds what is known."""
    word = lambda n: "".join(chr(97 + (n * 7 + k * 11) % 26) for k in range(9)) + str(n)
    mails = [f"{head(f)}Text {n} of {f}.\n\nBest,\n{f}\n\nOffice {word(n)} never {word(n + 7)} signs {word(n + 9)} by mail" for n in range(450) for f in ("Carl", "Dora")]
    quoted = "\n> \n> ".join(f"Paragraph {word(n)} of the long history {word(n + 3)} ends {word(n + 5)} here." for n in range(900))
    first = quoted.split("\n")[0]
    got = written(spark, [*mails, f"{head('Zoe')}New.\n\n{first}\n\nOffice {word(449)} never {word(456)} signs {word(458)} by mail\n\nOn 9 May 2023, Bob Doe <bob@b.c> wrote:\n> {quoted}"])
    assert all(len(g) == 1 for g in got[:-1]) and got[-1] == ["New."]


@pytest.mark.parametrize("line,minute", [("15 April 2025 9:43", 202504150943), ("14 novembre 2024 8:54", 202411140854), ("26 Dezember 2025", 202512260000), ("5 de março de 2024 7:05", 202403050705), ("May 3, 2024 10:00", 202405031000), ("2024-05-03", 202405030000), ("soon", None)])
def test_sent_at(line, minute):
    assert mail.sent_at(line) == minute


def test_gain_needs_shared_text():
    a, b = b"the tenant returned the keys to the office on friday morning", b"counsel asked for a copy of the ledger and the second exhibit"
    assert mail.gain(a, a)[0] > 0.8 and mail.gain(a, b)[0] < 0.3
    long = bytes(range(32, 127)) * 700
    assert mail.gain(long, long)[0] > 0.5
