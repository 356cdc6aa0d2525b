"""Pages to validated link cards: every stage is a DataFrame to DataFrame function, and the whole is one narrow plan.

No stage shuffles, save the join with rendered captures where a table of them is given. Filters on page_id and url reach
the scan, and a card without its content costs nothing for it: the content function and the html are pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C
from .joins import left_join
from .plugins import DEFAULTS, LISTS, SCALARS, ContentRules, Registry
from .reader import Options, reader_content

Stage = Callable[[DataFrame], DataFrame]

# Limits of a card.
TITLE, DESCRIPTION, AUTHOR, EXCERPT, KEYWORD, HIGHLIGHT, TEXT, HTML, BLOCKS, NODES, INDEX_HTML, CSS = 140, 280, 80, 320, 28, 180, 120_000, 180_000, 1_500, 2_000, 220_000, 32_000
TYPES = ("video", "article", "image", "audio", "social", "website", "unknown")
KINDS, MODES = ("homepage", "collection", "profile", "atomic", "unknown"), ("embeddable", "playable", "expandable", "static")
STATIC = Options(capture_mode="focused-body")
DYNAMIC = Options(source="dynamic-dom", capture_mode="focused-body", min_text_length=80, max_html=260_000, max_blocks=1_200)
#: Style of the documents around contents; a caller may give another.
STYLE = ":root{color-scheme:light}.preview-root{max-width:52rem;margin:0 auto;padding:1rem;font-family:sans-serif;line-height:1.6}.preview-root img,.preview-root video,.preview-root iframe{width:100%;border:0}.pv-section{padding:.75rem 0}.pv-list{padding-left:1.25rem}"
OPTIONS = (*SCALARS, *LISTS)
SNAPSHOT = ("language", "favicon_url", "estimated_reading_minutes", "word_count", "keywords", "highlights")


def _need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"stage lacks columns: {', '.join(missing)}")


def _options(df: DataFrame, plugins: Registry, url: str, base: dict) -> DataFrame:
    """The columns o_... : what the caller, the content profiles and the policies ask for at an address."""
    got = plugins.options(F.col(url), F.col("provider"), base)
    return df.withColumns({f"o_{k}": got[k] for k in got})


def bootstrap(plugins: Registry = DEFAULTS, rules: ContentRules = ContentRules(), title_hint: str | None = None) -> Stage:
    """original_url, provider, options; a URL that is no web address leaves them null and an error."""

    def stage(df: DataFrame) -> DataFrame:
        _need(df, "page_id", "url")
        df = df.withColumn("original_url", C.normalize_url(F.col("url")))
        url = F.col("original_url")
        df = df.withColumn("provider", F.when(url.isNotNull(), C.provider(url))).withColumn("url_error", F.when(url.isNull(), F.when(C.collapse(F.coalesce("url", F.lit(""))) == "", "URL must not be empty").otherwise("Unsupported protocol")))
        return _options(df, plugins, "original_url", rules.columns() | {"title_hint": F.lit(title_hint).cast("string")})

    return stage


def snapshot_of(tags: Column, html: Column, text: Column, content_html: Column, meta: dict[str, Column]) -> dict[str, Column]:
    """What a page is at a glance, from its content where there is one."""
    words = C.word_count(F.coalesce(text, C.strip_tags(html)))
    return {"language": meta["language"], "favicon_url": meta["favicon_url"], "estimated_reading_minutes": C.reading_minutes(words), "word_count": words, "keywords": C.keywords(tags), "highlights": C.highlights(F.coalesce(content_html, html))}


def with_metadata(df: DataFrame, html: str, base: str, to: str) -> DataFrame:
    """Adds the fields of page_metadata under a prefix. The head's tags are a column of their own, so that a page is gone through once."""
    df = df.withColumn(f"{to}tags", C.head_tags(F.col(html)))
    return df.withColumns({f"{to}{k}": v for k, v in C.page_metadata(F.col(f"{to}tags"), F.col(base)).items()})


def with_snapshot(df: DataFrame, html: str, content: str | None, to: str) -> DataFrame:
    none = F.lit(None).cast("string")
    text, inner = (F.col(f"{content}.text"), F.col(f"{content}.html")) if content else (none, none)
    meta = {k: F.col(f"{to}{k}") for k in ("language", "favicon_url")}
    return df.withColumn(f"{to}snapshot", F.when(F.col(html).isNotNull(), F.struct(*[v.alias(k) for k, v in snapshot_of(F.col(f"{to}tags"), F.col(html), text, inner, meta).items()])))


def fetch_static(plugins: Registry = DEFAULTS, options: Options = STATIC, content: bool = True) -> Stage:
    """resolved_url and what the page says of itself, with its content where it is asked for.

    Provider and options are those of the resolved address, on top of those of the original one. The title of the page,
    else its site's name or author, anchors the content.
    """

    def stage(df: DataFrame) -> DataFrame:
        _need(df, "original_url", "html")
        kind = F.col("content_type") if "content_type" in df.columns else F.lit(None).cast("string")
        resolved = C.normalize_url(F.col("resolved_url")) if "resolved_url" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("content_type", kind).withColumn("resolved_url", F.coalesce(resolved, F.col("original_url"))).withColumn("html", C.readable_html(F.col("html"), F.col("content_type")))
        df = df.withColumn("provider", F.when(F.col("resolved_url").isNotNull(), C.provider(F.col("resolved_url"))))
        df = _options(df, plugins, "resolved_url", {k: F.col(f"o_{k}") for k in (*OPTIONS, "title_hint")})
        df = with_metadata(df, "html", "resolved_url", "m_")
        if content:
            hint = F.coalesce("m_title", "m_site_name", "m_author")
            df = df.withColumn("content", reader_content("html", "resolved_url", hint, options, noise=F.col("o_noise_keywords"), main=F.col("o_main_keywords"), drop=F.col("o_drop_tags")))
        first = F.when(F.col("content.html").isNull(), C.first_paragraph(F.col("html"))).otherwise(F.col("content.first_paragraph")) if content else C.first_paragraph(F.col("html"))
        df = with_snapshot(df.withColumn("m_excerpt", first), "html", "content" if content else None, "m_")
        values = plugins.fold("refine_metadata", F.col("resolved_url"), F.col("provider"), {k: F.col(f"m_{k}") for k in (*C.METADATA, "excerpt")})
        return df.withColumns({**values, "snapshot": F.col("m_snapshot")}).drop(*[f"m_{k}" for k in (*C.METADATA, "excerpt", "tags", "snapshot")])

    return stage


def content_score(content: Column) -> Column:
    """-1 without content, its quality score where there is one, else by the length of its text."""
    n = F.length(content["text"])
    return F.when(content["text"].isNull(), -1).otherwise(F.coalesce(content["score"], F.when(n >= 600, 55).when(n >= 180, 35).otherwise(15)))


def one_capture(rendered: DataFrame) -> DataFrame:
    """One capture per page: the latest, then the one with the greatest number, then by its html, so that the choice is the same wherever rows lie."""
    kept = [c for c in ("rendered_html", "dom_tree", "rendered_url", *C.METADATA) if c in rendered.columns]
    order = [F.col(c) for c in ("rendered_at", "render_id") if c in rendered.columns] + [F.xxhash64("rendered_html")]
    best = rendered.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r"))
    return best.select("page_id", *[F.col(f"r.{c}").alias(f"r_{c}" if c in C.METADATA else c) for c in kept])


def dynamic_merge(rendered: DataFrame | None, plugins: Registry = DEFAULTS) -> Stage:
    """Left join with rendered captures (page_id, rendered_html, perhaps dom_tree, rendered_url and fields that the capture states).

    The metadata of the rendered page come first, those of the fetched one fill the rest; of the two contents the one
    with the better quality counts, a tie is the rendered one's.
    """

    def stage(df: DataFrame) -> DataFrame:
        if rendered is None:
            return df
        _need(rendered, "page_id", "rendered_html")
        both = left_join(df, one_capture(rendered), "page_id", "url")
        both = both.withColumn("c_base", F.coalesce(C.normalize_url(F.col("rendered_url")), F.col("resolved_url")) if "rendered_url" in both.columns else F.col("resolved_url"))
        both = with_metadata(both, "rendered_html", "c_base", "d_")
        hint = F.coalesce("o_title_hint", "title", "d_title")
        tree = F.col("dom_tree") if "dom_tree" in both.columns else None
        both = both.withColumn("dynamic", reader_content("rendered_html", "c_base", hint, DYNAMIC, noise=F.col("o_noise_keywords"), main=F.col("o_main_keywords"), drop=F.col("o_drop_tags"), nodes=tree, select=F.col("o_main_selectors"), remove=F.col("o_remove_selectors"), otherwise=STATIC))
        both = with_snapshot(both, "rendered_html", "dynamic", "d_")
        better = content_score(F.col("dynamic")) >= content_score(F.col("content"))
        both = both.withColumn("c_content", F.when(better, F.col("dynamic")).otherwise(F.col("content")))
        stated = lambda k: [F.col(f"r_{k}")] if f"r_{k}" in both.columns else []
        merged = {k: F.coalesce(*stated(k), F.col(f"d_{k}"), F.col(k)) for k in C.METADATA}
        merged["excerpt"] = F.coalesce(C.excerpt(F.col("dynamic.text")), F.when(F.col("dynamic.text").isNull(), C.first_paragraph(F.col("rendered_html"))), F.col("excerpt"), C.excerpt(F.col("c_content.text")))
        values = plugins.fold("refine_metadata", F.col("resolved_url"), F.col("provider"), merged)
        both = both.withColumns({**values, "snapshot": F.coalesce("d_snapshot", "snapshot"), "content": F.col("c_content")})
        return both.drop("dynamic", "rendered_html", "dom_tree", "rendered_url", "c_base", "c_content", "d_tags", "d_snapshot", *[f"{x}_{k}" for x in "dr" for k in C.METADATA])

    return stage


def classify(plugins: Registry = DEFAULTS) -> Stage:
    def stage(df: DataFrame) -> DataFrame:
        _need(df, "resolved_url", "content_type", "og_type")
        url = F.col("resolved_url")
        df = df.withColumn("c_path", C.url_path(url))
        path = F.col("c_path")
        text = F.col("content.text") if "content" in df.columns else F.lit(None).cast("string")
        words = F.col("snapshot.word_count")
        silent = ~reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > 0, F.lit(False)) for c in (F.col("og_type"), F.col("description"), F.col("excerpt"), text, F.col("title"))]) & words.isNull()
        suggests = C.suggests_article(F.col("og_type"), text, F.col("description"), F.col("excerpt"), words)
        df = df.withColumn("c_type", C.resource_type(path, F.col("content_type"), F.col("og_type"), suggests, silent))
        values = plugins.fold("refine_classification", url, F.col("provider"), {"resource_type": F.col("c_type"), "page_kind": C.page_kind(path, F.col("c_type"))})
        df = df.withColumns(values).drop("c_type")
        kind, page = F.col("resource_type"), F.col("page_kind")
        own = C.embed_url(url, kind, page, F.col("oembed_url"), F.col("player_url"))
        df = df.withColumn("c_embed", F.coalesce(own, F.when(F.col("original_url") != url, C.embed_url(F.col("original_url"), kind, page, F.col("oembed_url"), F.col("player_url")))))
        embeddable = F.col("c_embed").isNotNull()
        df = df.withColumn("c_play", C.playable(embeddable, kind, F.col("content_type"), path))
        play = F.col("c_play")
        values = {"embed_url": F.col("c_embed"), "embeddable": embeddable, "playable": play, "interaction_mode": C.interaction_mode(embeddable, play, kind, page), "player_url": F.col("player_url")}
        return df.withColumns(plugins.fold("refine_capability", url, F.col("provider"), values)).drop("c_embed", "c_play", "c_path")

    return stage


def _clamper(most: int) -> Callable[[Column], Column]:
    return lambda x: C.clamp_text(x, most)


def build(plugins: Registry = DEFAULTS, css: str = STYLE) -> Stage:
    """One wide row per card: fields that only some types have are null for the others."""

    def stage(df: DataFrame) -> DataFrame:
        kind = F.col("resource_type")
        mode = F.col("interaction_mode")
        shown = (
            F.when(kind == "video", F.when(mode == "embeddable", mode).otherwise("playable")).when(kind.isin("image", "audio"), "playable")
            .when(kind == "article", F.when(mode.isin("embeddable", "expandable"), mode).otherwise("static")).otherwise(mode)
        )
        content = "content" in df.columns
        text = F.col("content.text") if content else F.lit(None).cast("string")
        values = {
            "title": C.clamp_text(F.coalesce(C.trimmed(F.col("title")), C.url_host(F.col("resolved_url"))), TITLE), "description": C.clamp_text(F.col("description"), DESCRIPTION), "author": C.clamp_text(F.col("author"), AUTHOR),
            "image_url": F.when(C.trimmed(F.col("image_url")).rlike("^https?://"), C.trimmed(F.col("image_url"))), "excerpt": F.when(kind == "article", C.clamp_text(F.coalesce(F.col("excerpt"), C.excerpt(text)), EXCERPT)),
            "embed_url": F.when(~kind.isin("image", "audio"), F.col("embed_url")), "original_media_url": F.when(kind.isin("image", "audio"), F.col("resolved_url")), "interaction_mode": shown, "duration": F.lit(None).cast("double"),
        }
        values = plugins.fold("refine_card", F.col("resolved_url"), F.col("provider"), values)
        tight = {"keywords": KEYWORD, "highlights": HIGHLIGHT}
        snapshot = F.when(F.col("snapshot").isNotNull(), F.struct(*[(F.transform(f"snapshot.{k}", _clamper(tight[k])) if k in tight else F.col(f"snapshot.{k}")).alias(k) for k in SNAPSHOT]))
        kept = ["page_id", "original_url", "resolved_url", "canonical_url", "provider", "resource_type", "page_kind", "site_name", "published_at", "embeddable", "playable"]
        out = [F.col(c) for c in kept] + [v.alias(k) for k, v in values.items()] + [snapshot.alias("snapshot"), F.col("url_error")]
        if content:
            c = F.col("content")
            long = (F.length(F.trim(c["text"])) > TEXT) | (F.length(c["html"]) > HTML) | (F.size(c["blocks"]) > BLOCKS) | (F.length(c["index_html"]) > INDEX_HTML) | F.lit(len(css) > CSS) | (F.size(c["tree"]) > NODES)
            # A limit on nodes in document order is a prefix; what reached beyond it ends there.
            tree = F.transform(F.slice(c["tree"], 1, NODES), lambda n: n.withField("subtree_end", F.least(n["subtree_end"], F.lit(NODES))))
            document = F.when(c["text"].isNotNull(), F.struct(C.clamp_raw(c["index_html"], INDEX_HTML).alias("index_html"), F.lit(css[: CSS - 1] + "…" if len(css) > CSS else css).alias("css")))
            out += [C.clamp_text(c["text"], TEXT).alias("content_text"), C.clamp_raw(c["html"], HTML).alias("content_html"), F.slice(c["blocks"], 1, BLOCKS).alias("content_blocks"), tree.alias("content_tree"), F.least(c["tree_node_count"], F.lit(NODES)).alias("content_tree_node_count"),
                    (c["truncated"] | long).alias("content_truncated"), c["score"].alias("content_score"), c["grade"].alias("content_grade"), c["title_similarity"].alias("content_title_similarity"), c["source"].alias("content_source"), c["capture_mode"].alias("content_capture_mode"), document.alias("content_document")]
        return df.select(*out)

    return stage


def validation_errors(columns: list[str] | None = None) -> Column:
    """The rules that a card breaks, by name; empty for a valid one. Rules of the snapshot and the content count where their columns are given."""
    have = set(columns or ())
    web = lambda c: F.col(c).isNull() | C.is_web_url(F.col(c))
    rules = {
        "original_url": F.col("original_url").isNotNull() & web("original_url"), "resolved_url": F.col("resolved_url").isNotNull() & web("resolved_url"), "canonical_url": web("canonical_url"), "image_url": web("image_url"), "embed_url": web("embed_url"),
        "provider": F.length("provider") > 0, "resource_type": F.col("resource_type").isin(*TYPES), "page_kind": F.col("page_kind").isin(*KINDS), "interaction_mode": F.col("interaction_mode").isin(*MODES), "duration": F.col("duration").isNull() | (F.col("duration") >= 0),
    }
    if "snapshot" in have:
        s = F.col("snapshot")
        none = lambda c: F.coalesce(c, F.lit(True))
        rules |= {"snapshot.favicon_url": none(s["favicon_url"].rlike(r"^[a-zA-Z][a-zA-Z\d+.-]*:.")), "snapshot.estimated_reading_minutes": none(s["estimated_reading_minutes"] > 0), "snapshot.word_count": none(s["word_count"] >= 0), "snapshot.keywords": none(F.size(s["keywords"]) <= 10), "snapshot.highlights": none(F.size(s["highlights"]) <= 5)}
    if {"content_blocks", "content_tree", "content_score"} <= have:
        missing = F.col("content_text").isNull()
        source = F.forall("content_blocks", lambda b: F.when(b["type"] == "text", b["text"].isNotNull()).otherwise(b["type"].isin("image", "video", "iframe") & C.is_web_url(b["src"]) & F.coalesce(C.is_web_url(b["poster"]), F.lit(True))))
        node = F.forall("content_tree", lambda n: F.when(n["kind"] == "text", n["text"].isNotNull()).otherwise((n["kind"] == "element") & (F.length(n["tag"]) > 0)))
        rules |= {"content.quality": missing | (F.col("content_score").between(0, 100) & F.col("content_grade").isin("poor", "fair", "good", "excellent") & F.col("content_title_similarity").between(0, 1)), "content.blocks": missing | source, "content.tree": missing | (node & (F.col("content_tree_node_count") == F.size("content_tree"))),
                  "content.source": missing | F.col("content_source").isin("dynamic-dom", "static-html"), "content.capture_mode": missing | F.col("content_capture_mode").isin("focused-body", "full-body")}
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def validate(strict: bool = False) -> Stage:
    def stage(df: DataFrame) -> DataFrame:
        df = df.withColumn("validation_errors", validation_errors(df.columns))
        if strict:
            wrong = F.concat(F.lit("invalid card: "), F.array_join("validation_errors", ", "))
            df = df.withColumn("validation_errors", F.when(F.size("validation_errors") > 0, F.raise_error(wrong).cast("array<string>")).otherwise(F.col("validation_errors")))
        return df

    return stage


def pipeline(*stages: Stage) -> Stage:
    return lambda df: reduce(lambda d, s: d.transform(s), stages, df)


def cards(pages: DataFrame, *, rendered: DataFrame | None = None, plugins: Registry = DEFAULTS, content: bool = True, strict: bool = False, rules: ContentRules = ContentRules(), title_hint: str | None = None, css: str = STYLE) -> DataFrame:
    """A card per page row. pages needs page_id, url and html; content_type and resolved_url are used where they are."""
    return pages.transform(pipeline(bootstrap(plugins, rules, title_hint), fetch_static(plugins, content=content or rendered is not None), dynamic_merge(rendered, plugins), classify(plugins), build(plugins, css), validate(strict)))
