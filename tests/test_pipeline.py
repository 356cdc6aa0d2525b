"""The whole pipeline on small pages: what the parts hand to each other."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import cards as K
from cardloom.operators import reader as R
from cardloom.operators.plugins import ContentProfile, ContentRules, SitePolicy, registry

PAGE = "page_id bigint, url string, html string, content_type string, resolved_url string"
LONG = "A sentence that is long enough to count as content of a page, and it goes on for a few words more."
URL = "https://site.example/2024/05/boats"


def pages(spark, html, url=URL, kind="text/html", resolved=None, page_id=1):
    return spark.createDataFrame([(page_id, url, html, kind, resolved)], PAGE)


def captures(spark, html, **more):
    types = "page_id bigint, rendered_html string" + "".join(f", {k} {t}" for k, (t, _) in more.items())
    return spark.createDataFrame([(1, html, *[v for _, v in more.values()])], types)


def head(title="Static title", extra=""):
    return f"<html lang='en'><head><title>{title}</title>{extra}</head>"


def test_static_page(spark):
    html = head(extra='<meta name="description" content="About boats."><link rel="icon" href="/i.png"><link rel="canonical" href="https://site.example/c"><meta name="keywords" content="a, b ,a"><meta property="og:type" content="article">') + f"<body><article><h1>Static title</h1><p>{LONG}</p></article></body></html>"
    row = K.cards(pages(spark, html)).first()
    assert (row.title, row.description, row.canonical_url, row.resource_type, row.interaction_mode) == ("Static title", "About boats.", "https://site.example/c", "article", "expandable")
    assert (row.snapshot.favicon_url, row.snapshot.language, row.snapshot.keywords) == ("https://site.example/i.png", "en", ["a", "b"]) and row.snapshot.word_count > 10
    assert row.excerpt == LONG and row.content_title_similarity == 1.0 and row.validation_errors == []
    assert "<title>Static title</title>" in row.content_document.index_html and row.content_document.css == K.STYLE


def test_title_of_the_page_anchors_the_content(spark):
    other = f"<section class='story'><h1>Site name</h1><p>{LONG * 6}</p></section>"
    html = head("Winter boats on the canal") + f"<body>{other}<section><h2>Winter boats on the canal</h2><p>{LONG}</p></section></body></html>"
    assert K.cards(pages(spark, html)).first().content_text.startswith("Winter boats")


def test_rendered_metadata_come_first_and_static_ones_fill(spark):
    static = head(extra='<meta name="author" content="Ada"><meta property="og:site_name" content="Boats">') + f"<body><p>{LONG}</p></body></html>"
    shown = head("Rendered title", '<meta name="description" content="Rendered text."><meta name="twitter:player" content="https://p.example/1">') + f"<body><article><p>{LONG} {LONG}</p></article></body></html>"
    row = K.cards(pages(spark, static), rendered=captures(spark, shown)).first()
    assert (row.title, row.description, row.author, row.site_name, row.content_source) == ("Rendered title", "Rendered text.", "Ada", "Boats", "dynamic-dom")
    assert row.embeddable and row.embed_url == "https://p.example/1"


def test_fields_a_capture_states_come_before_its_page(spark):
    row = K.cards(pages(spark, head() + "<body></body></html>"), rendered=captures(spark, head("Shown"), title=("string", "Stated"))).first()
    assert row.title == "Stated"


def test_the_better_content_counts_by_quality_not_length(spark):
    words = "content article post story detail viewer read doc. "
    good = head("Boats") + f"<body><article><h1>Boats</h1><p>{words}{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></body></html>"
    long = "<body><div class='x'><p>" + "related menu banner ranking promo " * 10 + "</p></div></body>"
    assert K.cards(pages(spark, good), rendered=captures(spark, long)).first().content_source == "static-html"


def test_one_capture_whatever_the_order(spark):
    rows = [(1, f"<title>T{i}</title>", i, "2024-01-0%d" % d) for i, d in ((4, 1), (2, 3), (3, 3), (1, 2))]
    for order in (rows, rows[::-1]):
        shown = spark.createDataFrame(order, "page_id bigint, rendered_html string, render_id bigint, rendered_at string")
        assert K.cards(pages(spark, None), rendered=shown).first().title == "T3"


def test_tree_of_a_capture_counts_before_its_html(spark):
    node = lambda i, p, kind, tag=None, attrs=None, text=None: (i, p, 0, 0, kind, tag, attrs, text)
    tree = [node(0, -1, "element", "ARTICLE", {"onclick": "x()", "class": "story"}), node(1, 0, "element", "p"), node(2, 1, "text", text=f"Tree {LONG}"), node(3, 0, "element", "script"), node(4, 3, "text", text="bad()"), node(5, 0, "element", "img", {"src": "/a.png"})]
    row = K.cards(pages(spark, None), rendered=captures(spark, "<body><p>html</p></body>", dom_tree=(f"array<{R.NODE}>", tree))).first()
    assert row.content_text == f"Tree {LONG}" and [b.type for b in row.content_blocks] == ["text", "image"] and row.content_blocks[1].src == "https://site.example/a.png"
    assert "bad" not in str(row.content_tree) and "onclick" not in str(row.content_tree) and row.content_tree_node_count == 4


def test_rules_of_a_profile_reach_the_content(spark):
    class Mine(ContentProfile):
        id, priority = "mine", 500

        def matches(self, url, provider):
            return provider == "site"

        def rules(self):
            return ContentRules(noise_keywords=("zzbox",), drop_tags=("figure",))

    html = f"<body><main><p>{LONG}</p><div class='zzbox'>Sold here</div><figure><p>Fig</p></figure></main></body>"
    assert "Sold here" in K.cards(pages(spark, html)).first().content_text
    got = K.cards(pages(spark, html), plugins=registry(Mine())).first().content_text
    assert "Sold here" not in got and "Fig" not in got
    assert "Sold here" in K.cards(pages(spark, html, "https://other.example/2024/05/x"), plugins=registry(Mine())).first().content_text
    assert "Sold here" not in K.cards(pages(spark, html, "https://other.example/x", resolved=URL), plugins=registry(Mine())).first().content_text


def test_selectors_of_a_profile_cut_the_capture(spark):
    class Mine(ContentProfile):
        id, priority = "mine", 500

        def matches(self, url, provider):
            return provider == "site"

        def rules(self):
            return ContentRules(main_selectors=(".wanted",), remove_selectors=(".gone",))

    shown = f"<body><article><p>{LONG * 5}</p></article><div class='wanted'><p>Wanted {LONG}</p><p class='gone'>Gone</p></div></body>"
    text = K.cards(pages(spark, None), rendered=captures(spark, shown), plugins=registry(Mine())).first().content_text
    assert text == f"Wanted {LONG}"


def test_options_hook_of_a_policy(spark):
    class Mine(SitePolicy):
        id, priority = "mine", 1

        def matches(self, url, provider):
            return F.lit(True)

        def refine_options(self, url, values):
            return {"title_hint": F.lit("Second part"), "noise_keywords": F.concat(values["noise_keywords"], F.array(F.lit("zzbox")))}

    shown = f"<body><section><h2>First</h2><p>{LONG * 4}</p></section><section><h2>Second part</h2><p>{LONG}</p><div class='zzbox'>Sold</div></section></body>"
    text = K.cards(pages(spark, None), rendered=captures(spark, shown), plugins=registry(Mine())).first().content_text
    assert text.startswith("Second part") and "Sold" not in text


def test_order_of_profiles_and_join_of_rules(spark):
    def profile(id_, priority, rules, when=True):
        return type("P", (ContentProfile,), {"id": id_, "priority": priority, "matches": lambda self, u, p: F.lit(when), "rules": lambda self: rules})()

    plugins = registry(profile("b", 5, ContentRules(timeout_ms=2, noise_keywords=("x", "y"))), profile("a", 5, ContentRules(timeout_ms=1, noise_keywords=("y", "z"))), profile("c", 9, ContentRules(drop_tags=("q",)), when=False))
    got = plugins.rules(F.lit(URL), F.lit("site"), ContentRules(noise_keywords=("own",)).columns())
    row = spark.range(1).select(*[v.alias(k) for k, v in got.items()]).first()
    assert (row.timeout_ms, row.noise_keywords, row.drop_tags) == (1, ["own", "y", "z", "x"], [])


def test_built_in_profiles(spark):
    rules = lambda url, provider: spark.range(1).select(*[v.alias(k) for k, v in registry().rules(F.lit(url), F.lit(provider), ContentRules().columns()).items()]).first()
    video, place, none = rules("https://www.youtube.com/watch?v=x", "youtube"), rules("https://map.naver.com/p/1", "naver"), rules(URL, "site")
    assert "#primary" in video.main_selectors and "#related" in video.remove_selectors and "댓글" in video.main_keywords
    assert place.focus_title_nearest_body is True and "#app" in place.main_selectors and "광고" in place.noise_keywords and none.main_selectors == []


def test_map_page_is_embedded_by_its_frame(spark):
    html = head("Old Mill - Map") + '<body><iframe src="/ad"></iframe><iframe title="Old Mill" src="/p/entry?x=1"></iframe></body></html>'
    row = K.cards(pages(spark, html, "https://map.naver.com/p/1")).first()
    assert row.embeddable and row.embed_url == "https://map.naver.com/p/entry?x=1" and row.interaction_mode == "embeddable" and row.validation_errors == []


def test_relative_oembed_link(spark):
    html = head(extra='<link type="application/json+oembed" href="/oembed?x=1"><meta property="og:type" content="article">') + "<body></body></html>"
    row = K.cards(pages(spark, html)).first()
    assert row.embed_url == "https://site.example/oembed?x=1" and row.validation_errors == []


def test_html_beyond_the_byte_limit_is_cut_not_dropped(spark):
    long = "<title>Kept</title>" + "é" * 4_000_000 + "<p>end</p>"
    got = spark.range(1).select(C.readable_html(F.lit(long), F.lit("text/html")).alias("h")).select(F.octet_length("h").alias("n"), F.left("h", F.lit(19)).alias("start"), F.col("h").contains("end").alias("end")).first()
    assert (got.start, got.end) == ("<title>Kept</title>", False) and 7_999_990 < got.n <= 8_000_003


def test_limits_of_a_card(spark):
    html = head("T" * 200) + "<body><main>" + "".join(f"<p>{LONG} {i}</p>" for i in range(1200)) + "</main></body></html>"
    row = K.cards(pages(spark, html)).first()
    assert len(row.title) == 140 and row.title.endswith("…") and len(row.content_tree) == row.content_tree_node_count == 2000 and row.content_truncated
    assert max(n.subtree_end for n in row.content_tree) == 2000 and row.validation_errors == []


@pytest.mark.parametrize("field,value,rule", [("url", "nope://x", "original_url"), ("html", '<link rel="canonical" href="/rel">', "canonical_url")])
def test_invalid_cards_name_their_rule(spark, field, value, rule):
    df = pages(spark, value if field == "html" else None, value if field == "url" else URL)
    assert rule in K.cards(df, content=False).first().validation_errors


def test_nested_rules(spark):
    html = head() + f"<body><article><p>{LONG}</p></article></body></html>"
    card = K.cards(pages(spark, html))
    wrong = card.withColumns({"content_score": F.lit(101), "content_tree": F.transform("content_tree", lambda n: n.withField("kind", F.lit("other"))), "content_source": F.lit("else"), "snapshot": F.col("snapshot").withField("estimated_reading_minutes", F.lit(0))})
    assert wrong.select(K.validation_errors(wrong.columns).alias("e")).first().e == ["snapshot.estimated_reading_minutes", "content.quality", "content.tree", "content.source"]


def test_rows_without_a_page_number(spark):
    df = spark.createDataFrame([(None, f"https://a.example/{i}", None, None, None) for i in range(50)] + [(1, URL, None, None, None)], PAGE)
    got = K.cards(df, rendered=captures(spark, "<title>T</title>"))
    assert got.count() == 51 and got.where("title = 'T'").count() == 1


def test_kernel_quality_is_the_column_quality(spark):
    text = f"content and menu {LONG}"
    own = R.quality_of(text, [{"type": "text"}] * 5 + [{"type": "image"}], None, "A sentence with boats", C.MAIN_KEYWORDS, C.NOISE_KEYWORDS, True)
    blocks = F.array(*[F.struct(F.lit(t).alias("type")) for t in ["text"] * 5 + ["image"]])
    col = C.quality(F.lit(text), blocks, F.lit(None).cast("int"), F.lit("A sentence with boats"), F.lit(list(C.MAIN_KEYWORDS)), F.lit(list(C.NOISE_KEYWORDS)), F.lit(True))
    row = spark.range(1).select(*[v.alias(k) for k, v in col.items()]).first()
    assert all(own[k] == row[k] for k in own)


@pytest.mark.parametrize("url,want", [("HTTP://User:pw@Site.EXAMPLE:80/a/../b", "http://User:pw@site.example/b"), ("https://x.example:99999/", None), ("https://", None), ("javascript:alert(1)", None), ("https://a.example/%2e%2e/x", "https://a.example/x"), (" https://a.example﻿", "https://a.example/"), ("https://[::1]/x", "https://[::1]/x")])
def test_canonical_addresses(spark, url, want):
    assert spark.range(1).select(C.normalize_url(F.lit(url))).first()[0] == want


class Answer(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/page")
            self.end_headers()
            return
        kind = "image/png" if self.path == "/pic" else "text/html; charset=utf-8"
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", kind)
        self.send_header("X-Test", "1")
        self.end_headers()
        self.wfile.write("<title>Grüße</title>".encode())

    def log_message(self, *args):
        pass


def test_pages_are_fetched(spark):
    from cardloom.sources.pages import fetch_pages

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    rows = [(1, f"{root}/page"), (2, f"{root}/moved"), (3, f"{root}/pic"), (4, f"{root}/none"), (5, "http://127.0.0.1:9/x"), (6, "ftp://x"), (7, None)]
    got = {r.page_id: r for r in fetch_pages(spark.createDataFrame(rows, "page_id bigint, url string"), timeout=3).collect()}
    server.shutdown()
    assert got[1].html == "<title>Grüße</title>" and got[1].headers["x-test"] == "1" and got[2].resolved_url == f"{root}/page"
    assert (got[3].html, got[3].content_type, got[4].status, got[4].html) == (None, "image/png", 404, "<title>Grüße</title>")
    assert got[5].fetch_error and got[6].fetch_error == "Unsupported protocol" and got[7].status is None


def test_headers_map(spark):
    row = spark.range(1).select(C.headers_map(F.array(F.lit("A"), F.lit("b"), F.lit("a")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("h")).first()
    assert row.h == {"b": "2", "a": "3"}
