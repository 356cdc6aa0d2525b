import duckdb
import pytest
from pyspark.sql import functions as F

from cardloom.functions import columns as C
from cardloom.operators import cards as K
from cardloom.operators.plugins import ContentProfile, ContentRules, Registry, SitePolicy
from cardloom.plans import queries as Q

DATA = "/root/testdata/sf0.001"
PAGE = "page_id bigint, url string, html string, content_type string"


def one(spark, url, html=None, content_type=None, **options):
    return K.cards(spark.createDataFrame([(1, url, html, content_type)], PAGE), **options).first()


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://a.example/pic.PNG", ("image", "atomic", "playable")), ("https://a.example/clip.mp4", ("video", "atomic", "playable")), ("https://a.example/", ("website", "homepage", "static")),
        ("https://a.example/2024/05/boats", ("article", "atomic", "expandable")), ("https://a.example/tag/boats", ("website", "collection", "static")), ("https://a.example/@user", ("unknown", "profile", "static")),
        ("https://www.youtube.com/watch?v=abcdefgh", ("video", "atomic", "embeddable")),
    ],
)
def test_url_only_cards(spark, url, want):
    row = one(spark, url, content=False)
    assert (row.resource_type, row.page_kind, row.interaction_mode) == want and row.validation_errors == []


@pytest.mark.parametrize("url,want", [("a.b.co.uk", "b"), ("https://youtu.be/x", "youtu"), ("http://10.0.0.1/x", "10.0.0.1"), ("https://www.m.site.example/", "site"), ("localhost", "localhost")])
def test_provider(spark, url, want):
    assert spark.range(1).select(C.provider(C.normalize_url(F.lit(url)))).first()[0] == want


@pytest.mark.parametrize("url", ["", "   ", "ftp://a.example/x", "mailto:a@b.example", None])
def test_bad_urls_give_an_error_and_no_failure(spark, url):
    row = one(spark, url, content=False)
    assert row.url_error and "original_url" in row.validation_errors


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="invalid card"):
        one(spark, "https://a.example/x", '<link rel="canonical" href="/relative">', content=False, strict=True)


def test_policy_and_profile(spark):
    class Mine(SitePolicy):
        id, priority = "mine", 500

        def matches(self, url, provider):
            return provider == "a"

        def refine_card(self, url, values):
            return {"title": F.lit("mine")}

    class Rules(ContentProfile):
        id, priority = "rules", 1

        def matches(self, url, provider):
            return url.contains("boats")

        def rules(self):
            return ContentRules(noise_keywords=("x1",), timeout_ms=5)

    registry = Registry([Mine(), Rules()])
    assert one(spark, "https://a.example/2024/05/boats", content=False, plugins=registry).title == "mine"
    assert one(spark, "https://b.example/2024/05/boats", content=False, plugins=registry).title == "b.example"
    for url, want in (("https://a.example/boats", (["x1"], 5)), ("https://a.example/x", ([], None))):
        got = registry.rules(F.lit(url), F.lit("a"), ContentRules().columns())
        assert tuple(spark.range(1).select(got["noise_keywords"].alias("n"), got["timeout_ms"].alias("t")).first()) == want


def test_rendered_content_wins_a_tie(spark):
    pages = spark.createDataFrame([(1, "https://a.example/2024/05/x", "<body><article><p>" + "static words " * 30 + "</p></article></body>", None)], PAGE)
    rendered = spark.createDataFrame([(1, "<body><article><p>" + "dynamic words " * 30 + "</p></article></body>")], "page_id bigint, rendered_html string")
    assert "dynamic" in K.cards(pages, rendered=rendered).first().content_text


def test_quality_golden(spark):
    text = "x" * 93
    rows = spark.createDataFrame([(text, [("text",)] * 4 + [("image",)], 120, None, ["zz"], ["yy"], False)], "t string, b array<struct<type:string>>, n int, h string, m array<string>, o array<string>, c boolean")
    got = rows.select(*[v.alias(k) for k, v in C.quality(*[F.col(c) for c in "tbnhmoc"]).items()]).first()
    assert got.score == int(93 / 1400 * 38 + 5 / 42 * 16 + 2 + 120 / 1200 * 8 + 0.5) and got.grade == "poor"


def test_url_filters_reach_the_scan_and_content_is_pruned(spark):
    plan = K.cards(spark.read.parquet(f"{DATA}/pages.parquet"), content=False).where("page_id < 5").select("page_id", "provider")._jdf.queryExecution().toString()
    assert "LessThan(page_id,5)" in plan and "ArrowEvalPython" not in plan.split("Physical Plan")[1] and "Exchange" not in plan.split("Physical Plan")[1]


def test_stream_equals_batch(spark):
    columns = ["page_id", "provider", "resource_type", "page_kind", "interaction_mode", "title", "excerpt", "content_text", "content_score"]
    batch = sorted(map(str, K.cards(spark.read.parquet(f"{DATA}/pages.parquet")).select(*columns).collect()))
    assert sorted(map(str, Q.cards_stream(spark, DATA).collect())) == batch


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, duck, name):
    shown = lambda v: "" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(shown(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
