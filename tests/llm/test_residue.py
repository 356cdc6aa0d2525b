import pytest

from cardloom.llm import notices as N, residue as R

from .conftest import CARD, RENDER

# Notices that the labelled table doesn't hold.
UNLISTED = ["JavaScript is required to view this site.", "Sorry, you have been blocked", "Something went wrong. Please try again.", "Diese Seite ist nicht verfügbar.", "Votre session n'est plus valide, veuillez réessayer.", "페이지 오류가 발생했습니다."]
ORDINARY = ["Notes on the old tide tables", "A visit to the mill near the canal", "The harbour office measures three small boats", "Why the orchard school lends out maps", "Most read this week", "Share this page"]


def block(t):
    return ("text", t, None, None, None, None)


def found(spark, cards, renders):
    return {(r.source_table, r.row_id, r.field_name): r.reason for r in R.residue_values(spark.createDataFrame(cards, CARD), spark.createDataFrame(renders, RENDER)).collect()}


@pytest.mark.parametrize("text", ["{{title}}", "Old boats | ${site.name}", "Wie %%date%% es war", "[object Object] Notes", "null – Una visita", "Notes (NaN min)"])
def test_residue_of_a_value_alone(text):
    assert R.local_reason(text, R.segments(text, None))


@pytest.mark.parametrize("text", ["We explain what {{title}} stands for in a mail merge", "The border remained undefined until the survey of 1861.", "Null islands and other maps", "See the note [1] and [...] 100% of it"])
def test_sound_values(text):
    assert R.local_reason(text, R.segments(text, None)) is None


def test_model_on_lines_it_was_not_fitted_on():
    assert not {R.masked(x) for x in UNLISTED} & {R.masked(x) for x in N.shown()}
    model = N.Notices([R.masked(x) for x in ORDINARY])
    rest = [R.masked(x) for x in N.shown()[::5]]
    assert all(model.score(R.masked(x)) > 0 for x in UNLISTED[:4])
    assert sum(model.score(x) > 0 for x in rest) > 0.9 * len(rest) and not any(model.score(R.masked(x)) > 0 for x in ORDINARY)


@pytest.fixture(scope="module")
def corpus():
    """Cards with ordinary titles, and each unlisted notice in some titles and descriptions and on a page."""
    things = "boat shelf lantern kettle map rope ladder letter quay tide mill choir baker museum school garden tower bridge stone glass".split()
    pick = lambda i, k: things[(i * 7 + i // 20 * k + k) % 20]
    rows = [(i, 1, "p", f"{ORDINARY[i % 6]}: the {pick(i, 1)} and the {pick(i, 2)}", f"It is the {pick(i, 3)} that measures the {pick(i, 5)}. {ORDINARY[i % 4]}, and so on.") for i in range(600)]
    notes = [(1000 + 10 * k + j, 1, "p", t if j % 2 else "Notes", "Notes" if j % 2 else t) for k, t in enumerate(UNLISTED) for j in range(6)]
    page = "The office of the harbour measures boats, although the budget for it is small."
    renders = [(k, 1, None, f"Menu {t} {page}", 3, None, [block("Menu"), block(t), block(page)]) for k, t in enumerate(UNLISTED)]
    return rows, notes, renders


def test_unlisted_notices_are_found_wherever_they_stand(spark, corpus):
    rows, notes, renders = corpus
    got = found(spark, rows + notes, renders)
    want = {("cards", r[0], "title" if r[3] != "Notes" else "description") for r in notes} | {("render_results", r[0], "text") for r in renders}
    assert set(got) == want and set(got.values()) == {"message"}


def test_without_mined_templates_no_message_is_found(spark, corpus, monkeypatch):
    rows, notes, renders = corpus
    monkeypatch.setattr(R, "message_templates", lambda lines: lines.limit(0).withColumn("message", R.F.lit(True)))
    assert found(spark, rows + notes, renders) == {}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_verdicts_are_the_same_when_too_many_to_send(spark, corpus, monkeypatch, most):
    rows, notes, renders = corpus
    monkeypatch.setattr(R, "MOST_SENT", most)
    got = found(spark, rows + notes[:6] + [(None, None, None, "TBD", None), (1, 1, "p", None, "")], [*renders[:1], renders[0], (77, 1, None, None, None, None, None)])
    assert len(got) == 7


def test_a_template_is_judged_with_all_its_lines(spark):
    lines = [(f"sorry, the server is away today, ticket {x}", 2, True, True, False, 0.5) for x in ("ab", "cd", "ef")] + [("sorry, the server room has a new red door", 1, False, False, True, -0.1)]
    df = spark.createDataFrame(lines, "template string, n bigint, title boolean, description boolean, text boolean, score double")
    got = {tuple(r.pattern): (r.n, r.message) for r in R.message_templates(R.templates_of(df)).collect()}
    assert got == {("sorry,", "the", "server", "is", "away", "today,", "ticket", "*"): (6, True), tuple(lines[3][0].split()): (1, False)}


def test_filler_is_learnt_from_its_company(spark):
    dummy = ["lorem ipsum brallo dentis", "brallo ipsum vorcal dentis lorem", "vorcal lorem dentis brallo", "dentis vorcal brallo"]
    cards = [(i, 1, "p", t, None) for i, t in enumerate(dummy)] + [(100 + i, 1, "p", f"{ORDINARY[i % 6]} number {i}", None) for i in range(60)]
    assert {k[1] for k, v in found(spark, cards, []).items() if v == "filler"} == {0, 1, 2, 3}


PAGE_PARTS = [" ".join([x] * 20) for x in ("The office of the harbour measures boats, although the budget for it is small.", "It is the choir that tests the boats, and the museum lends out maps.")]


def test_every_stretch_of_a_text_is_looked_at(spark, corpus):
    """Also between blocks, far from the end of the text, and where blocks stand twice or in another order."""
    rows, notes, _ = corpus
    cases = [(b, sign) for b in (PAGE_PARTS, [PAGE_PARTS[0]] * 2, ["Menu", *PAGE_PARTS[::-1]]) for sign in "\n "]
    text = lambda sign, *more: sign.join(["Menu", PAGE_PARTS[0], UNLISTED[0], *more, PAGE_PARTS[1]])
    for blocks, sign in cases:
        parts = R.segments(text(sign, "By {{author}}."), blocks)
        assert UNLISTED[0] in parts and R.local_reason(text(sign, "By {{author}}."), parts) == "slot"
    renders = [(i, 1, None, text(sign), 3, None, [block(b) for b in blocks]) for i, (blocks, sign) in enumerate(cases)]
    got = found(spark, rows + notes[:6], renders)
    assert all(got.get(("render_results", i, "text")) == "message" for i in range(len(cases)))


def test_gaps_and_sentences():
    assert R.gaps("a b, c d e", ["a b", "d"]) == [", c", "e"] and R.gaps("x y x", ["x", "x"]) == ["y"] and R.gaps("x y", ["y", "x", "z"]) == [] and R.gaps("x", []) == ["x"] and R.gaps("", []) == []
    assert R.sentences("One. Two!  Three? four. 理由。次。") == ["One.", "Two!", "Three? four.", "理由。", "次。", ""]


def test_long_and_empty_texts(spark):
    long = "The office measures boats. " * 5000
    assert found(spark, [(1, 1, "p", long, " "), (2, 1, "p", "\n", "{{name}} " + long)], [(1, 1, None, long, 0, None, [])]) == {("cards", 2, "description"): "slot"}


def test_empty_tables(spark):
    assert found(spark, [], []) == {}


def test_lines_together_score_as_one_by_one(monkeypatch):
    model = N.Notices([R.masked(x) for x in ORDINARY])
    lines = [*map(R.masked, [*UNLISTED, *ORDINARY]), "", "...", "0 12 0", "$ $", "“no access” is what they said", "ja ja ja", "日本語の文 0"]
    words = [N.words_of(x) for x in lines]
    want = [model.score(x, w) for x, w in zip(lines, words)]
    assert model.scores(lines, words) == pytest.approx(want, abs=1e-12) and model.scores([], []) == []
    for name, value in (("AT_ONCE", 10), ("LONG", 6), ("MOST_WORDS", 1)):
        monkeypatch.setattr(N, name, value)
        assert model.scores(lines, words) == pytest.approx(want, abs=1e-12)
