"""Where languages differ: one test per hazard of the survey, by its number."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import cards as K
from cardloom.operators import dom as D
from cardloom.operators import reader as R
from cardloom.operators.plugins import Registry, SitePolicy

LONG = "A sentence that is long enough to count as content of a page, and it goes on for a few words more."


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def body(inner):
    return f"<body>{inner}</body>"


def card(spark, html, url="https://a.example/2024/05/x", **options):
    return K.cards(spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string"), **options).first()


def test_h1_lengths_count_code_points(spark):
    assert value(spark, C.clamp_text(F.lit("😀" * 5), 4)) == "😀😀😀…"


@pytest.mark.parametrize("blank", [" ", "﻿", "　", " "])
def test_h2_white_space_of_the_web(spark, blank):
    assert value(spark, C.present(F.lit(f"{blank}a{blank}{blank}b{blank}"))) == "a b" == R.tidy(f"{blank}a{blank}{blank}b{blank}")


def test_h2_other_controls_are_no_white_space(spark):
    assert value(spark, C.present(F.lit("\x1ca\x85b"))) == "\x1ca\x85b" == R.tidy("\x1ca\x85b")


def test_h3_letters_and_numbers_of_all_scripts(spark):
    text = "Ünï-코드 ② x_y"
    assert value(spark, C._plain(F.lit(text))) == R.plain(text) == "ünï 코드 ② x y"


@pytest.mark.parametrize("words,want", [(330, 2), (329, 1), (110, 1), (550, 3)])
def test_h4_halves_round_up(spark, words, want):
    assert value(spark, C.reading_minutes(F.lit(words))) == want


def test_h5_empty_strings_are_missing_only_in_static_merges(spark):
    assert value(spark, C.merge_present(F.lit(""), F.lit("b"))) == "b" and value(spark, F.coalesce(F.lit(""), F.lit("b"))) == ""


def test_h6_no_match_is_null(spark):
    assert value(spark, C.first(F.lit("<p>"), C.RX_TITLE)) is None


def test_h7_addresses_never_raise(spark):
    assert value(spark, C.normalize_url(F.lit("http://Ex.com:80/a b/../c"))) == "http://ex.com/c" and value(spark, C.normalize_url(F.lit("http://exa mple.com"))) is None


def test_h8_small_letters_do_not_depend_on_the_place(spark):
    assert value(spark, C.normalize_host(F.lit("WWW.TITLE.EXAMPLE"))) == "title.example"


def test_h9_ties_go_to_the_first():
    html = body(f"<section><h2>Boats here</h2><p>{LONG} one</p></section><section><h2>Boats here</h2><p>{LONG} two</p></section>")
    assert R.recompose(html, "", "Boats here")["text"].endswith("one")


def test_h10_plug_ins_of_one_priority_go_by_id():
    made = [type("P", (SitePolicy,), {"id": i, "priority": 1, "matches": lambda self, u, p: None})() for i in ("b", "A", "a")]
    assert [p.id for p in Registry(made).ordered()] == ["A", "a", "b"]


def test_h11_names_of_object_prototypes_are_plain_names():
    assert R.tidy("a &constructor; b") == "a b"
    assert R.recompose(body(f"<constructor><p>{LONG}</p></constructor>"), "")["text"] == LONG


def test_h12_a_bad_code_point_costs_the_content_not_the_card(spark):
    row = card(spark, "<title>T</title>" + body("<p>&#99999999;</p>"))
    assert row.content_text is None and row.title == "T"


def test_h13_three_ways_to_match_titles(spark):
    names = C.title_candidates(F.lit("Old Mill - Map"), 2)
    assert value(spark, C.title_match(F.lit("Mill"), names)) == 0.5  # a text inside a title is no whole match
    assert R.title_score("Mill", R.title_parts("Old Mill")) > 0.65 and D.title_match("Mill", R.title_parts("Old Mill", 2)) == 0.85


def test_h14_a_header_is_in_the_text_but_not_in_the_html():
    got = R.recompose(body(f"<main><header><p>Above all</p></header><p>{LONG}</p></main>"), "", None, R.Options(focus_main=False))
    assert "Above all" in got["text"] and "Above all" not in got["html"]


def test_h15_breaks_use_up_the_budget_of_the_html():
    got = R.recompose(body("<p>" + "<br>".join(f"{LONG} {i}" for i in range(6)) + "</p>"), "")
    assert got["block_count"] < 6 and got["html"].count("<p>") == got["block_count"] and not got["truncated"]


def test_h16_headings_become_paragraphs():
    got = R.recompose(body(f"<main><h2>Boats</h2><p>{LONG}</p></main>"), "")
    assert "<h2" not in got["html"] and "<p>Boats</p>" in got["html"]


def test_h17_the_capture_mode_is_as_asked():
    assert R.recompose(body(f"<p>{LONG}</p>"), "", None, R.Options(capture_mode="focused-body"))["capture_mode"] == "focused-body"
    assert R.recompose(body(f"<p>{LONG}</p>"), "", None, R.Options(focus_main=False))["capture_mode"] == "full-body"


def test_h18_relative_canonical_links_make_a_card_invalid(spark):
    assert card(spark, '<link rel="canonical" href="/x">', content=False).validation_errors == ["canonical_url"]


def test_h19_durations_are_only_handed_on(spark):
    assert card(spark, "<title>x</title>", content=False).duration is None


@pytest.mark.parametrize("name", ["header", "shadow", "ad"])
def test_h20_bad_hints_are_parts_of_words(name):
    assert R.NEGATIVE.search(name)


def test_h21_keywords_are_parts_of_hints():
    keep = R.recompose(body(f"<main><p>{LONG}</p><div class='ad'>Not noise</div><div class='ad-box'>Noise</div></main>"), "")
    assert "Not noise" in keep["text"] and keep["text"].endswith("Not noise")


@pytest.mark.parametrize("url", ["https://vimeo.com/12345", "https://www.instagram.com/p/x/"])
def test_h22_only_what_is_coded_counts(spark, url):
    assert card(spark, None, url, content=False).embed_url is None
