import pytest

from cardloom.operators import reader as R

BASE = "https://site.example/post/1"
LONG = "A sentence that is long enough to be counted as content of a page, with some more words."


def body(inner):
    return f"<html><body>{inner}</body></html>"


def test_scripts_handlers_and_unsafe_links_are_removed():
    got = R.recompose(body(f'<div class="content" onclick="x()"><script>bad("</p>")</script><p>{LONG}</p><a href="javascript:alert(1)">go</a><img src="/a.png" alt="A"><iframe></iframe></div>'), BASE)
    assert "script" not in got["html"] and "onclick" not in str(got["tree"]) and "javascript" not in str(got["tree"])
    assert [b["type"] for b in got["blocks"]] == ["text", "text", "image"] or [b["type"] for b in got["blocks"]] == ["text", "image"]
    assert got["blocks"][-1]["src"] == "https://site.example/a.png"


def test_focus_prefers_the_article_to_link_lists():
    links = "".join(f'<li><a href="/{i}">link number {i} of a list</a></li>' for i in range(8))
    got = R.recompose(body(f"<div class='menu'><ul>{links}</ul></div><article><h1>Boats</h1><p>{LONG} {LONG} {LONG}</p></article><footer>end of page</footer>"), BASE)
    assert got["focused"] and "link number" not in got["text"] and "end of page" not in got["text"] and got["text"].startswith("Boats")


def test_title_anchor_beats_a_longer_box():
    other = f"<section class='story'><h1>Site name</h1><p>{LONG * 6}</p></section>"
    wanted = f"<section><h2>Winter boats on the canal</h2><p>{LONG}</p></section>"
    got = R.recompose(body(other + wanted), BASE, "Winter boats on the canal")
    assert got["text"].startswith("Winter boats")


def test_media_blocks():
    got = R.recompose(body(f'<article><p>{LONG}</p><video poster="/p.jpg"><source src="/v.mp4"></video><iframe src="https://p.example/1" title="Player"></iframe></article>'), BASE)
    assert [(b["type"], b["src"]) for b in got["blocks"] if b["type"] != "text"] == [("video", "https://site.example/v.mp4"), ("iframe", "https://p.example/1")]


def test_order_and_breaks():
    got = R.recompose(body(f"<main><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>tail <b>bold</b> end</p></section></main>"), BASE)
    assert [b["text"] for b in got["blocks"]] == ["One", LONG, "Two", "tail bold end"]


@pytest.mark.parametrize("text,want", [("a &amp; b &copy; c", "a & b c"), ("&#65;&#x42;", "AB"), (" a ﻿b　c ", "a b c")])
def test_tidy(text, want):
    assert R.tidy(text) == want


def test_bad_code_point_is_an_error_not_a_failure():
    assert R.recompose(body("<p>&#99999999;</p>"), BASE)["error"] == "ValueError"


@pytest.mark.parametrize("html", [None, "", "<body></body>", "<", "<div" * 3000, "<div>" * 3000 + LONG])
def test_odd_pages(html):
    got = R.recompose(html, BASE)
    assert "error" not in got
    for n in got.get("tree", []):
        assert n["parent"] < n["idx"] < n["subtree_end"]


@pytest.mark.parametrize("link,want", [("/a b", "https://site.example/a%20b"), ("HTTP://EX.com:80/x/../y", "http://ex.com/y"), ("für", "https://site.example/post/f%C3%BCr"), ("mailto:a@b.example", "mailto:a@b.example"), ("http://[bad", None)])
def test_join_url(link, want):
    assert R.join_url(BASE, link) == want


def test_limits_cut_blocks_and_nodes():
    html = body("<main>" + "".join(f"<p>{LONG} {i}</p>" for i in range(50)) + "</main>")
    got = R.recompose(html, BASE, None, R.Options(max_html=1000, max_nodes=10))
    assert got["truncated"] and len(got["html"]) <= 1000 and len(got["tree"]) == got["tree_node_count"] == 10
