import numpy as np
import pytest

from cardloom.llm import boilerplate as B, language as L, texttype as T, truncation as U
from cardloom.session import table

from .conftest import CARD, PAGE, RENDER

COMMON = frozenset("the of and to in a is that it for on with as was at by".split())


def block(text, kind="text"):
    return (kind, text, None, None, None, None)


# Main bodies


def labelled(data):
    import pandas as pd

    r = pd.read_parquet("/root/testdata/sf0.01/render_results.parquet").drop_duplicates("render_id")
    return [p for p in (([t for _, t in B.text_blocks(b)], h) for b, h in zip(r.blocks, r.html)) if B.labels(*p) is not None]


def test_tree_on_held_out_pages_without_names(data):
    pages = labelled(data)
    tree = B.fit(pages[: len(pages) // 2])
    right = total = 0
    for texts, html in pages[len(pages) // 2 :]:
        rows = B.block_rows(texts, html)
        rows[:, -B.HINTS :] = 0
        for got, want in zip(tree.predict(rows) >= 0, B.labels(texts, html)):
            right, total = right + (got == want), total + 1
    assert right / total > 0.96


def test_single_rows_take_the_same_way_down(data):
    pages = labelled(data)
    tree = B.fit(pages[::2])
    for texts, html in [*pages[1::2], (["a", "", "日本 12 ²"], None), ([], "<p>x")]:
        assert B.judge(tree, texts, html) == list(tree.predict(B.block_rows(texts, html)) >= 0)


def test_leaves_of_odd_markup():
    html = "\n<DIV class=' '>one <!-- <p> -->&amp; 1 < 2<a href='/x'>\n link<b> x</b></a></p><script>var a</script><p\nid=q>two</Div/> three<1></p><!-- <p>end"
    assert B.leaves(html) == [("div", "one & 1 2 link x", 5, 1, "div"), ("p", "two", 0, 2, "q"), ("p", "three1>", 0, 2, "q"), ("div", "!--", 0, 1, "div"), ("p", "end", 0, 1, "div")]
    assert B.leaves(None) == B.leaves("") == []
    assert [B.digits(t) for t in ("a1 22", "日本 12 ²", "٣é", "")] == [3, 3, 1, 0]


def test_boilerplate_edges(spark):
    html = '<div class="top-menu"><p>Home</p></div><article><h1>Boats</h1><p>A long sentence about boats and tides, which goes on.</p></article>'
    full = [block("Home"), block(None, "image"), block("Boats"), block("A long sentence about boats and tides, which goes on.")]
    rows = [(i, 1, html, "t", 1, None, full) for i in range(30)] + [(1, 1, html, "t", 1, None, full), (50, 1, None, "t", None, None, None), (51, 1, "", None, None, None, []), (None, 1, html, "t", 1, None, full), (52, 1, html, "t", 1, None, [block(None)])]
    renders = spark.createDataFrame(rows, RENDER).selectExpr("*", "1 as block_no")
    got = {tuple(r) for r in B.boilerplate_blocks(renders).collect()}
    assert {(i, 0) for i in range(30)} <= got and not {x for x in got if x[0] < 30 and x[1] != 0}
    body = B.main_bodies(renders).where("render_id = 1").first()
    assert body.text.startswith("Boats") and "Home" not in body.html
    assert B.boilerplate_blocks(renders.where("false")).count() == 0


# Languages


def test_languages_on_held_out_samples(spark, data):
    rows = [(r.lang, r.text) for r in table(spark, data, "language_samples").collect()]
    model = L.Centroids(rows[::2])
    got = [(lang, s["lang"]) for lang, text in rows[1::2] for s in L.judged_segments(text, model)]
    assert np.mean([a == b for a, b in got]) > 0.99
    assert model.nearest("zxqv wprt kjhg")[0] is None and model.nearest("")[0] is None and L.Centroids([]).nearest("word")[0] is None


@pytest.mark.parametrize("label,want", [("en_US", "en"), ("Français", "fr"), ("한국어", "ko"), ("utf-8", None), ("", None), (None, None), ("x-default", None)])
def test_label(spark, label, want):
    rows = spark.createDataFrame([(label,)], "lang_label string")
    assert rows.select(L.label_code(rows["lang_label"]).alias("c")).first().c == want


def test_short_sentences_are_segments_too(spark, data):
    model = L.Centroids([(r.lang, r.text) for r in table(spark, data, "language_samples").collect()])
    got = L.judged_segments("The boats lie at the old quay today.\n理由は簡単である。 Ja.\nThe harbour office measures the old boats of the town", model)
    assert [(g["segment"], g["lang"], g["whole"]) for g in got] == [("The boats lie at the old quay today.", "en", True), ("理由は簡単である。", "ja", True), ("Ja.", None, True), ("The harbour office measures the old boats of the town", "en", False)]


def test_texts_together_are_judged_as_one_by_one(data, monkeypatch):
    import pandas as pd

    rows = pd.read_parquet(f"{data}/language_samples.parquet")
    model = L.Centroids(list(zip(rows.lang, rows.text)))
    body = "\n".join([*rows.text[::9], "A line without a stop", "Ja.", "“Eins, zwei” is what they said.", "...", "zxqv wprt kjhg."])
    every = L.judged_segments(body, model)
    assert [s["confidence"] for s in every] == [L.judged_segments(s["segment"], model)[0]["confidence"] for s in every]
    asked = []
    judge = model.nearest_all
    monkeypatch.setattr(model, "nearest_all", lambda texts: asked.extend(texts) or judge(texts))
    whole = [s for s in every if s["whole"]]
    assert L.judged_segments(body, model, whole=True) == whole and len(asked) == len(whole) < len(every)
    model.forget()
    assert L.judged_segments(body, model) == every


def test_languages_of_a_body_need_few_lengths(data, monkeypatch):
    import pandas as pd

    rows = pd.read_parquet(f"{data}/language_samples.parquet")
    model = L.Centroids(list(zip(rows.lang, rows.text)))
    asked = []
    judge = model.cosines
    for body in ("\n".join(rows.text), "\n".join([*rows.text[:20], "Ja.", "zxqv wprt kjhg.", "...", "A line without a stop", "“Eins, zwei” is what they said."]), "Zxqv wprt kjhg.", "Ja.", "İ. Ä ö. 1.", ""):
        want = {}
        whole = [s for s in L.judged_segments(body, model) if s["whole"]]
        for s in whole:
            if s["lang"]:
                want[s["lang"]] = max(s["confidence"], want.get(s["lang"], 0.0))
        monkeypatch.setattr(model, "cosines", lambda texts: asked.extend(texts) or judge(texts))
        assert L.spoken_languages(body, model) == want
        monkeypatch.undo()
        assert len(asked) <= max(1, len(whole) // 5) + len(want)
        asked.clear()
    assert L.spoken_languages("One two three.", L.Centroids([])) == {}


def test_corrected_languages(spark):
    seg = "render_id bigint, segments array<struct<segment:string,lang:string,confidence:double,whole:boolean>>"
    s = lambda *xs: [("t", x, 1.0, True) for x in xs] + [("a line", "pt", 1.0, False)]
    segments = spark.createDataFrame([(1, s("en", "en")), (2, s("en")), (3, s("en", "fr", None)), (4, s("de")), (5, None), (6, [])], seg)
    labels = spark.createDataFrame([(1, "English"), (2, "fr"), (3, "en"), (4, None), (1, "English")], "render_id bigint, lang_label string")
    assert sorted(tuple(r) for r in L.corrected_languages(segments, labels).collect()) == [(2, "en"), (3, "en"), (3, "fr"), (4, "de")]


# Text types

KINDS = {
    "prose": ["The harbour office measures the old tide tables, although the budget for it is small. It is the choir that tests the boats.", "before sunrise the crew measures the loose pages of the book and the boats in it for the most part", "– The crew tests the boats in the harbour of the town.\n– It is the choir that sorts the pages of the book.\n– The office of the town is small, and it is old."],
    "list": ["- oak shelf\n- rope ladder\n- tin lantern\n- felt hat\n- clay jar", "gancho (5 cm)\ncesto (16 cm)\ntoalha (4 cm)\ngancho (31 cm)\nlinho (57 cm)", "1) Tonkrug\n2) Weidenkorb\n3) Glaskugel\n4) Eichenregal"],
    "table": ["oak shelf | 291 | 80.52 | B\nclay jar | 360 | 38.19\nfelt hat | 246 | 4.87 | –\npine crate | 62 | 36.54 | C", "farol\t240\t84.85\ncometa\t219\t46.88\t–\ntinaja\t72\t2.27\ngancho\t9\t1.10"],
    "junk": ["^$$@_-=<_~!<#=%^^|^^&$!>-&@\n&_>%=>&~!!&|-|!~>-$<^#", " ".join(["Archive"] * 30), '!function(y,w){var l=62;e.push([763,"h"])}(window,[]);\n!function(x,i){var b=46;p.push([81,"f"])}(window,[]);', "24 9d 2d 20 b5 89 66 bd b2 e8 92 b7 4a 88 34\n76 c4 18 7e 0e a7 eb e3 ff 25 b9 a2 16 1d 17"],
}


def test_text_types():
    texts = [(k, t) for k, ts in KINDS.items() for t in ts]
    patterns = {}
    votes = [T.votes(T.statistics(t, COMMON)) for _, t in texts]
    for v, (k, _) in zip(votes, texts):
        patterns[v] = patterns.get(v, 0) + (60 if k == "prose" else 8)
    prior, chance = T.fit(patterns)
    got = T.posterior(np.array([[v >> i & 1 for i in range(len(T.FUNCTIONS))] for v in votes], dtype=float), prior, chance).argmax(axis=1)
    assert [T.TYPES[g] for g in got] == [k for k, _ in texts]


@pytest.mark.parametrize("text", [None, "", " \n \n", "x" * 100_000])
def test_statistics_of_odd_texts(text):
    assert set(T.statistics(text, COMMON)) == {p.split(" ")[0] for p in T.STATISTICS.split(", ")}


# Cuts


def test_cuts_on_held_out_values():
    whole = ["The harbour office measures the old tide tables, although the budget is small. It is the choir that tests boat number %d." % i for i in range(300)]
    weights = U.fit({"cards": [(t, False, None) for t in whole[:200]] + [("Notes on boat number %d" % i, False, None) for i in range(100)]}, {})
    rng = np.random.default_rng(9)
    cut = [c for t in whole[200:] for c in U.cuts(t, rng)]
    assert np.mean([U.score(weights, c, "cards", 0.0) >= 0.5 for c in cut]) > 0.9
    assert np.mean([U.score(weights, t, "cards", 0.0) < 0.5 for t in whole[200:]]) > 0.95


def test_where_a_value_stops():
    lines = ["One line here.", "Another line of it", "The last"]
    assert [U.stop(t, lines) for t in ("One line", "One line here.", "One line here. Another", "One line here.\nAnother line of it", "One line here. Another line of it The last", "Else", "")] == ["inside", "line", "inside", "line", "end", "unknown", "inside"]
    assert U.stop("One", None) == "unknown"


def test_piles_of_long_values(spark):
    rows = [("cards", "x" * n) for n in [20_000] * 9 + [19_999] + list(range(50, 90))]
    values = spark.createDataFrame(rows, "source_table string, text string")
    assert [(r.n, r.pile > 5) for r in U.length_piles(values).collect()] == [(20_000, True)]


@pytest.mark.parametrize("text,part", [("one two… Read more", "one two"), ("one two [...]", "one two"), ("one two...", "one two"), ("one two.", "one two."), ("", "")])
def test_marks(text, part):
    assert U.kept(text)[0] == part


def test_truncated_edges(spark):
    line = "The harbour office measures the old tide tables near the canal, and so on."
    blocks = [block(line), block("Second line of it goes on. And on.")]
    text = f"{line}\nSecond line of it goes on. And on."
    renders = [(i, 1, None, text, 2, None, blocks) for i in range(40)] + [(100, 1, None, text[:90], 2, False, blocks), (100, 1, None, text[:90], 2, False, blocks), (101, 1, None, line, 2, True, blocks), (102, 1, None, None, None, None, None), (None, 1, None, "x", None, None, None)]
    cards = [(1, 1, "p", "t", line), (2, None, None, None, None), (3, 9, "p", "", ""), (None, 1, "p", "t", line)]
    args = spark.createDataFrame(cards, CARD), spark.createDataFrame(renders, RENDER), spark.createDataFrame([(1, "https://a.example/x", f'<meta name="description" content="{line}">'), (2, None, None)], PAGE)
    got = {(r.source_table, r.row_id) for r in U.truncated_values(*args).where("cut").collect()}
    assert got == {("render_results", 100)}
    assert U.truncated_values(*[a.where("false") for a in args]).count() == 0


def test_lost_character_at_the_end_of_both_is_no_cut():
    line = "Mentions l�gales � Confidentialit� � Accessibilit�"
    assert U.relation(line, line) == 0 and not U.continued(line, [line])
    assert U.continued("Mentions l�gales � Confi�", [line])


def test_capture_that_breaks_off_in_transfer(spark):
    line = "The harbour office measures the old tide tables near the canal, and so on."
    cut = "It is the choir that borrows a row of be"
    whole = [(i, 1, f"<p>{line}</p>\n<p>Notes on boat number {i}</p>", f"{line}\nNotes on boat number {i}", 2, None, [block(line), block(f"Notes on boat number {i}")]) for i in range(40)]
    broken = (100, 2, f"<p>{line}</p>\n<p>{cut}", f"{line}\n{cut}", 2, False, [block(line), block(cut)])
    closed = (101, 3, f"<p>{line}</p>\n<p>{cut}</p>", f"{line}\n{cut}", 2, False, [block(line), block(cut)])
    tag = (102, 4, f"<p>{line}</p>\n<h2>The painted shutters</h", f"{line}\nThe painted shutters", 2, False, [block(line), block("The painted shutters")])
    pages = [(3, "https://a.example/x", f"<body><p>{line}</p><p>It is the <em>choir</em> that borrows a row of beehives.</p></body>")]
    got = U.truncated_values(spark.createDataFrame([], CARD), spark.createDataFrame([*whole, broken, closed, tag], RENDER), spark.createDataFrame(pages, PAGE)).where("cut").collect()
    assert sorted(r.row_id for r in got) == [100, 101]


def test_queries_have_their_columns(spark, data):
    from cardloom.llm import queries as Q

    want = {"p2_found": ["source_table", "row_id", "field_name"], "p3_found": ["render_id", "block_no"], "p4_found": ["render_id", "lang"], "p5_found": ["source_table", "row_id"], "p6_found": ["source_table", "row_key", "kind"], "p7_found": ["source_table", "row_id", "field_name"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "pii_type", "span_start"]}
    for name, columns in want.items():
        rows = Q.QUERIES[name](spark, data)
        assert rows.columns == columns
        got = rows.collect()
        assert len(got) == len(set(got)), name
