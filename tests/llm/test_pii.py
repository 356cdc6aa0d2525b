import numpy as np
import pytest

from cardloom.llm import pii as P


def spans(text):
    found = P.candidates(text)
    if not found:
        return []
    model, thresholds = P.fitted()
    return P.select(found, model.predict(np.array([P.features(k, text, a, b) for k, a, b in found])), thresholds)


# Frames and details that share nothing with those the model is fitted on, nor with the test tables.
HELD = {
    "email": (["Forward the invoice to {x} today.", "Billing questions: {x}", "Owner is {x}, I think.", "Newsletter sign-up: {x} confirmed", "Bitte antworten Sie {x} direkt.", "{x} bounced again"], ["priya.raman@northbank.example", "okafor77@studio.test", "h.lindgren@kiosk.example.org"]),
    "phone": (["My new phone is {x}.", "Call me back under {x} tonight", "Reception: {x}", "Hotline {x} is busy", "Telefonnummer: {x}", "mobile {x}"], ["+44 161 496 0345", "(212) 555-0187", "+49 89 12345 678", "+33 1 70 18 99 12"]),
    "id_number": (["My social security number is {x}.", "Passport number {x} expires soon", "please enter your identity number, mine is {x}", "insurance no. {x}", "Ihre Ausweisnummer {x} fehlt"], ["078-05-1120", "AB 12 34 56 C", "850101-1234567", "Y1234567-Z"]),
    "address": (["The office is located at {x}.", "Invoice address: {x}", "She grew up at {x}.", "Parcel for {x}", "My mother lives at {x}."], ["17 Harbour Terrace, Kingsbarn", "Flat 8, 30 Chapel Lane, Wickford", "Gartenweg 12, 80331 Neustadt", "4, rue des Lilas, 31000 Montclar"]),
    "name": (["Yesterday {x} told the board about it.", "Our new head of sales, {x}, starts in May.", "Minutes taken by {x}.", "I am grateful to {x} for the review.", "Regards from {x}", "Ask {x} about the keys.", "Approved by {x} in June", "Herr {x} kommt später."], ["Priya Raman", "Amara Okafor", "Henrik Lindgren", "Zofia B. Malik"]),
}


@pytest.mark.parametrize("kind", P.TYPES)
def test_recall_on_held_out_frames(kind):
    frames, values = HELD[kind]
    texts = [(f, v) for f in frames for v in values]
    hits = [any(k == kind and a == f.index("{x}") for k, a, _ in spans(f.replace("{x}", v))) for f, v in texts]
    assert np.mean(hits) >= 0.9, [t for t, h in zip(texts, hits) if not h]


@pytest.mark.parametrize("text", ["Parcel 4711-2233-98 left the depot.", "Commit 8841927705 broke the nightly build.", "The order 2209-1187-45 is late.", "Chapters: Static Typing, Closing Remarks and Index.", "The ferry to Port Marlow leaves at 9.", "Pull image cache@7.4.1 first", "See logo@2x.png in the bundle", "We spent a week in Great Wexley.", "The Winter Fair opens on Sunday.", "IP 10.12.250.11 is blocked."])
def test_what_is_no_detail(text):
    assert spans(text) == []


def test_frames_are_not_those_of_the_model():
    own = {f for v in P._YES.values() for f in v}
    assert not own & {f for frames, _ in HELD.values() for f in frames}


def test_work_grows_with_the_length_of_a_line():
    from time import perf_counter

    def seconds(n):
        text = "Lea Ott, 555-0101; " * n
        began = perf_counter()
        spans(text)
        return perf_counter() - began

    seconds(100)
    assert seconds(8000) < 12 * max(seconds(2000), 0.02)


@pytest.mark.parametrize(
    "text,want",
    [
        ("You can reach me at ada_95@mail.example.net if you need it.", [("email", "ada_95@mail.example.net")]), ("Mail goes to mailto:ada.berger[at]mail.example now", [("email", "ada.berger[at]mail.example")]),
        ("Text me: +44 20 7946 0123", [("phone", "+44 20 7946 0123")]), ("the passport no. QQ 18 62 83 C is refused", [("id_number", "QQ 18 62 83 C")]), ("担当者: 佐藤花子, 김민수 님", [("name", "佐藤花子"), ("name", "김민수")]), ("I asked Ada van Berger again", [("name", "Ada van Berger")]),
        ("They sent it to Flat 3, 76 Mill Lane, Newtown.", [("address", "Flat 3, 76 Mill Lane, Newtown")]), ("A colleague, Ada B. Berger, wrote that part", [("name", "Ada B. Berger")]),
        ("Ticket 986-8225-53 has more.", []), ("Get it with `git clone git@code.host.invalid:team/a.git`.", []), ("", []), ("in version 4.14.12 of it", []),
    ],
)
def test_spans(text, want):
    got = [(k, text[a:b]) for k, a, b in spans(text)]
    assert [(k, t.startswith(w) or w.startswith(t)) for (k, t), (_, w) in zip(got, want)] == [(k, True) for k, _ in want] and len(got) == len(want)


def test_redaction_keeps_the_rest(spark):
    text = "Hi. Text me: +44 20 7946 0123 or 日本語 later."
    docs = spark.createDataFrame([(1, text, 9), (1, text, 9), (2, None, 9), (3, "", 9), (None, text, 9), (4, "x" * 200_000, 9)], "doc_id bigint, text string, spans int")
    assert [tuple(r) for r in P.redacted(docs).distinct().collect()] == [(1, "Hi. Text me: [PHONE] or 日本語 later.")]
    assert P.redacted(docs.where("false")).count() == 0


def test_no_document_is_left_out_by_its_signs(spark):
    """Names of other scripts, accented capitals, other digits and spelt-out addresses stand in documents without ASCII capitals, digits or @."""
    texts = ["担当者: 佐藤花子", "작성자: 김민수", "by Élodie Ångström.", "mail to ada.berger (at) mail dot example", "write to ada.berger at mail dot example", "tel: ０３-１２３４-５６７８"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [(s.pii_type, s.span_start) for s in r.spans] for r in P.pii_spans(docs).collect()}
    want = {i: [(k, a) for k, a, _ in found] for i, t in enumerate(texts) if (found := spans(t))}
    assert got == want and len(want) == len(texts)
