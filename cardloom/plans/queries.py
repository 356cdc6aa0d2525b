"""Registered queries and the SQL that must give the same rows. Queries of the reader kernel have no SQL; golden tests hold them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..operators import cards as K
from ..operators.joins import left_join
from ..operators.plugins import video_id
from ..operators.reader import Options, reader_content
from ..operators.timestamps import p1_found
from ..session import shared_folder, table

QUERIES: dict = {"p1_found": p1_found}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# SQL of the shared functions ------------------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_list(xs) -> str:
    return ", ".join(q(x) for x in xs)


def s_collapse(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, {q(C.WS + '+')}, ' ', 'g'), '^ | $', '', 'g')"


def s_present(c: str) -> str:
    return f"nullif({s_collapse(c)}, '')"


def s_first(c: str, rx: str) -> str:
    return f"nullif(regexp_extract({c}, {q(rx)}, 1), '')"


def s_host(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(r'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)')}, 1))"


def s_path(u: str) -> str:
    p = f"regexp_extract({u}, {q(r'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)')}, 1)"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def s_segments(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda x: x <> '')"


def s_ext(p: str) -> str:
    return f"nullif(lower(regexp_extract(coalesce({s_segments(p)}[-1], ''), '\\.([^.]*)$', 1)), '')"


def s_shape(p: str) -> str:
    e = f"coalesce({s_ext(p)}, '')"
    return f"CASE WHEN {e} IN ({s_list(C.IMAGE_EXTENSIONS)}) THEN 'direct-image' WHEN {e} IN ({s_list(C.VIDEO_EXTENSIONS)}) THEN 'direct-video' WHEN {e} IN ({s_list(C.AUDIO_EXTENSIONS)}) THEN 'direct-audio' WHEN {p} IN ('/', '') THEN 'root' WHEN len({s_segments(p)}) >= 2 THEN 'path-document' ELSE 'unknown' END"


def s_article(p: str) -> str:
    barred = " OR ".join(f"contains(lower({p}), {q(x)})" for x in C.NOT_ARTICLE)
    return f"(lower({p}) <> '/' AND length({p}) >= 5 AND NOT ({barred}) AND (regexp_matches(lower({p}), '[0-9]{{4}}/[0-9]{{2}}') OR len({s_segments(p)}) >= 2))"


def s_strip(c: str) -> str:
    return s_collapse(f"regexp_replace(regexp_replace({c}, {q(C.RX_CODE)}, ' ', 'g'), '<[^>]+>', ' ', 'g')")


def s_texts(c: str, rx: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, {q(rx)}, 1), lambda t: {s_strip('t')}), lambda t: t <> '')"


def s_unique(xs: str) -> str:
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def s_html() -> str:
    return f"CASE WHEN (content_type IS NULL OR content_type = '' OR contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'application/xhtml+xml')) THEN html END"


def s_url(c: str) -> str:
    t = f"regexp_replace({c}, {q(f'^{C.WS}+|{C.WS}+$')}, '', 'g')"
    u = f"CASE WHEN regexp_matches({t}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {t} ELSE 'https://' || {t} END"
    bare = f"regexp_replace({u}, '#.*$', '')"
    return f"CASE WHEN {t} <> '' AND regexp_matches({u}, '^(?i)https?://[^/?#]+') THEN CASE WHEN regexp_matches({bare}, '^[a-z]+://[^/?]+$') THEN {bare} || '/' ELSE {bare} END END"


def s_clamp(c: str, n: int) -> str:
    t = f"nullif({s_collapse(c)}, '')"
    return f"CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n - 1}) || '…' ELSE {t} END"


def s_excerpt(c: str) -> str:
    return f"CASE WHEN length({s_collapse(c)}) >= 60 THEN substr({s_collapse(c)}, 1, 320) END"


_HOSTED = f"SELECT page_id, {s_url('url')} AS u FROM pages"
_LABELS = f"SELECT page_id, u, {s_host('u')} AS host, regexp_replace(regexp_replace({s_host('u')}, '^www\\.', ''), '^m\\.', '') AS bare, {s_path('u')} AS path FROM ({_HOSTED})"
_PROVIDER = """CASE WHEN u IS NULL THEN NULL ELSE coalesce(nullif(CASE WHEN regexp_matches(bare, '^[0-9]{1,3}(\\.[0-9]{1,3}){3}$') OR contains(bare, ':') THEN bare WHEN len(ls) <= 1 THEN ls[1]
 WHEN len(ls) >= 3 AND length(ls[-1]) = 2 AND length(ls[-2]) <= 3 THEN ls[-3] ELSE ls[-2] END, ''), 'unknown') END"""


@query(f"SELECT page_id, u AS normalized_url, host, {_PROVIDER} AS provider, path, {s_ext('path')} AS extension, {s_shape('path')} AS url_shape, {s_article('path')} AS article_path FROM (SELECT *, list_filter(string_split(bare, '.'), lambda x: x <> '') AS ls FROM ({_LABELS}))")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """URLs normalised and taken apart, with provider and shape."""
    url = C.normalize_url(F.col("url"))
    base = table(spark, d, "pages").select("page_id", url.alias("u")).select("page_id", "u", C.url_host(F.col("u")).alias("host"), C.url_path(F.col("u")).alias("path"))
    path = F.col("path")
    return base.select("page_id", F.col("u").alias("normalized_url"), "host", F.when(F.col("u").isNotNull(), C.provider(F.col("u"))).alias("provider"), "path", C.extension(path).alias("extension"), C.url_shape(path).alias("url_shape"), C.article_path(path).alias("article_path"))


def s_kind(p: str, kind: str) -> str:
    starts = lambda xs: " OR ".join(f"starts_with(lower({p}), {q(x)})" for x in xs)
    return f"CASE WHEN ({s_shape(p)}) = 'root' THEN 'homepage' WHEN {starts(C.COLLECTIONS)} THEN 'collection' WHEN {starts(C.PROFILES)} THEN 'profile' WHEN {kind} IN ('video', 'image', 'audio', 'article', 'social') THEN 'atomic' ELSE 'unknown' END"


# Addresses of every shape, made from the pages' own.
_MADE = "CASE page_id % 12 WHEN 0 THEN '/photo/a.JPG' WHEN 1 THEN '/clip.mp4' WHEN 2 THEN '/s/t.mp3' WHEN 3 THEN '/' WHEN 4 THEN '/tag/boats' WHEN 5 THEN '/@user' WHEN 6 THEN '/author/x' WHEN 7 THEN '/2024/05/boats' WHEN 8 THEN '/embed/42' WHEN 9 THEN '/search?q=1' WHEN 10 THEN '/shop' ELSE '/news/boats?embed=1' END"
_MADE_URL = f"regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || {_MADE}"
_OG = "CASE page_id % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'website' WHEN 2 THEN 'profile' WHEN 3 THEN 'video.other' ELSE NULL END"
_TYPE = "CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/mp4' ELSE NULL END"
_PLAYER = "CASE WHEN page_id % 9 = 0 THEN 'https://player.example/' || page_id END"
_S_TYPE = f"""CASE WHEN ({s_shape('path')}) = 'direct-image' OR contains(coalesce(lower(ct), ''), 'image/') THEN 'image' WHEN ({s_shape('path')}) = 'direct-audio' OR contains(coalesce(lower(ct), ''), 'audio/') THEN 'audio'
 WHEN ({s_shape('path')}) = 'direct-video' OR contains(coalesce(lower(ct), ''), 'video/') THEN 'video' WHEN contains(coalesce(og, ''), 'profile') OR contains(coalesce(og, ''), 'social') THEN 'social' WHEN contains(coalesce(og, ''), 'article') THEN 'article'
 WHEN {s_article('path')} AND (CASE WHEN contains(coalesce(og, ''), 'article') THEN true WHEN regexp_matches(coalesce(og, ''), 'website|profile|video|music') THEN false ELSE coalesce(length(descr) >= 140, false) END OR (og IS NULL AND descr IS NULL)) THEN 'article'
 WHEN path IN ('/', '') THEN 'website' WHEN ({s_shape('path')}) = 'path-document' THEN 'website' ELSE 'unknown' END"""
_CLASSIFIED = f"SELECT *, {s_kind('path', 'kind')} AS page FROM (SELECT *, {_S_TYPE} AS kind FROM (SELECT page_id, u, {s_path('u')} AS path, og, ct, player, descr FROM (SELECT page_id, {_MADE_URL} AS u, {_OG} AS og, {_TYPE} AS ct, {_PLAYER} AS player, {s_first('html', C.rx_meta('description'))} AS descr FROM pages)))"
_EMBED = "CASE WHEN page = 'atomic' AND kind IN ('video', 'social', 'article') THEN coalesce(player, CASE WHEN regexp_matches(lower(path), '/embed/|/player/') OR regexp_matches(u, '[?&]embed(=|&|$)') THEN u END) END"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "pages").select("page_id", F.expr(_MADE_URL).alias("u"), F.expr(_OG).alias("og"), F.expr(_TYPE).alias("ct"), F.expr(_PLAYER).alias("player"), C.first(F.col("html"), C.rx_meta("description")).alias("descr"))
    none = F.lit(None).cast("string")
    made = made.withColumn("path", C.url_path(F.col("u")))
    suggests = C.suggests_article(F.col("og"), none, F.col("descr"), none, F.lit(None).cast("int"))
    made = made.withColumn("kind", C.resource_type(F.col("path"), F.col("ct"), F.col("og"), suggests, F.col("og").isNull() & F.col("descr").isNull()))
    return made.withColumn("page", C.page_kind(F.col("path"), F.col("kind")))


@query(f"SELECT page_id, u AS url, kind AS resource_type, page AS page_kind FROM ({_CLASSIFIED})")
def classification(spark: SparkSession, d: str) -> DataFrame:
    """Resource type and page kind from address, content type and metadata."""
    return _classified(spark, d).select("page_id", F.col("u").alias("url"), F.col("kind").alias("resource_type"), F.col("page").alias("page_kind"))


@query(f"""SELECT page_id, embed_url, embed_url IS NOT NULL AS embeddable, playable, CASE WHEN embed_url IS NOT NULL THEN 'embeddable' WHEN playable THEN 'playable' WHEN kind = 'article' AND page = 'atomic' THEN 'expandable' ELSE 'static' END AS interaction_mode
 FROM (SELECT *, (embed_url IS NOT NULL AND kind = 'video') OR kind IN ('image', 'audio') OR (kind = 'video' AND (contains(coalesce(lower(ct), ''), 'video/') OR coalesce({s_ext('path')}, '') IN ({s_list(C.VIDEO_EXTENSIONS)}))) AS playable FROM (SELECT *, {_EMBED} AS embed_url FROM ({_CLASSIFIED})))""")
def capability(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page can be embedded, played or expanded."""
    df = _classified(spark, d)
    df = df.withColumn("embed_url", C.embed_url(F.col("u"), F.col("kind"), F.col("page"), F.lit(None).cast("string"), F.col("player"))).withColumn("embeddable", F.col("embed_url").isNotNull())
    df = df.withColumn("playable", C.playable(F.col("embeddable"), F.col("kind"), F.col("ct"), F.col("path")))
    return df.select("page_id", "embed_url", "embeddable", "playable", C.interaction_mode(F.col("embeddable"), F.col("playable"), F.col("kind"), F.col("page")).alias("interaction_mode"))


_VIDEO = "CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/abcdef' || page_id WHEN 1 THEN 'https://www.youtube.com/watch?v=id_' || (100000 + page_id) || '&t=1' WHEN 2 THEN 'https://m.youtube.com/shorts/sh-' || (100000 + page_id) WHEN 3 THEN 'https://youtube.com/embed/no' WHEN 4 THEN 'https://notyoutube.com/watch?v=abcdefg' ELSE 'https://www.youtube.com/live/lv' || (100000 + page_id) END"


@query(f"""SELECT page_id, id AS video_id, 'https://www.youtube.com/embed/' || id AS embed_url FROM (SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)youtube\\.com$|(^|\\.)youtu\\.be$') AND regexp_matches(raw, '^[a-zA-Z0-9_-]{{6,20}}$') THEN raw END AS id
 FROM (SELECT page_id, h, CASE WHEN regexp_matches(h, '(^|\\.)youtu\\.be$') THEN {s_segments('p')}[1] WHEN p = '/watch' THEN regexp_extract(u, '[?&]v=([^&#]*)', 1) ELSE regexp_extract(p, '^/(?:shorts|embed|live)/([^/]+)', 1) END AS raw FROM (SELECT page_id, u, {s_host('u')} AS h, {s_path('u')} AS p FROM (SELECT page_id, {_VIDEO} AS u FROM pages))))""")
def video_embeds(spark: SparkSession, d: str) -> DataFrame:
    """Ids and embed addresses of a video site's pages."""
    made = table(spark, d, "pages").select("page_id", F.expr(_VIDEO).alias("u")).select("page_id", video_id(F.col("u")).alias("video_id"))
    return made.select("page_id", "video_id", F.concat(F.lit("https://www.youtube.com/embed/"), F.col("video_id")).alias("embed_url"))


def s_resolved(link: str) -> str:
    """A link from the root, a relative one or an absolute one, seen from u."""
    root = "regexp_extract(u, '^([a-z]+://[^/]+)', 1)"
    return f"CASE WHEN {link} IS NULL THEN NULL WHEN regexp_matches({link}, '^[a-zA-Z]+:') THEN {link} WHEN starts_with({link}, '/') THEN {root} || {link} ELSE regexp_extract(u, '^([a-z]+://[^?#]*/)', 1) || {link} END"


def _s_meta() -> dict[str, str]:
    m = lambda k: s_first("h", C.rx_meta(k))
    return {
        "title": s_present(s_first("h", C.RX_TITLE)), "description": s_present(f"coalesce({m('description')}, {m('og:description')})"), "image_url": s_present(m("og:image")), "site_name": s_present(m("og:site_name")), "author": s_present(m("author")), "published_at": s_present(m("article:published_time")),
        "canonical_url": s_present(s_first("h", C.RX_CANONICAL)), "og_type": s_present(m("og:type")), "oembed_url": s_resolved(s_first("h", C.RX_OEMBED)), "favicon_url": s_resolved(s_first("h", C.RX_ICON)), "language": s_present(s_first("h", C.RX_LANG)),
    }


_S_EXCERPT = f"list_filter({s_texts('h', C.RX_PARAGRAPH)}, lambda t: length(t) >= 60)[1]"


@query(f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _s_meta().items())}, {_S_EXCERPT} AS excerpt FROM (SELECT page_id, {s_html()} AS h, {s_url('url')} AS u FROM pages)")
def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What pages say of themselves in their markup, as the pipeline reads it."""
    df = table(spark, d, "pages").select("page_id", C.readable_html(F.col("html"), F.col("content_type")).alias("h"), C.normalize_url(F.col("url")).alias("u"))
    df = K.with_metadata(df, "h", "u", "m_")
    return df.select("page_id", *[F.col(f"m_{k}").alias(k) for k in _s_meta()], C.first_paragraph(F.col("h")).alias("excerpt"))


_DERIVED = "'<meta property=\"og:type\" content=\"' || CASE page_id % 3 WHEN 0 THEN 'article' ELSE 'website' END || '\"><meta name=\"keywords\" content=\"boats, tides , boats,' || page_id || '\"><link rel=\"canonical\" href=\"/c/' || page_id || '\"><link rel=\"shortcut icon\" href=\"/i.png\"><link type=\"application/json+oembed\" href=\"/o?' || page_id || '\"><meta name=\"twitter:player\" content=\"https://p.example/' || page_id || '\">' || html"


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'article' ELSE 'website' END AS og_type, '/c/' || page_id AS canonical_url, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/i.png' AS favicon, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/o?' || page_id AS oembed_url, 'https://p.example/' || page_id AS player_url, 'boats|tides|' || page_id AS keywords FROM pages WHERE html IS NOT NULL""")
def head_links(spark: SparkSession, d: str) -> DataFrame:
    """Links and metadata of heads that have every kind of them; what must come out is said in the SQL without any pattern."""
    df = table(spark, d, "pages").where(F.col("html").isNotNull()).select("page_id", F.expr(_DERIVED).alias("h"), C.normalize_url(F.col("url")).alias("u"))
    df = K.with_metadata(df, "h", "u", "m_")
    return df.select("page_id", F.col("m_og_type").alias("og_type"), F.col("m_canonical_url").alias("canonical_url"), F.col("m_favicon_url").alias("favicon"), F.col("m_oembed_url").alias("oembed_url"), F.col("m_player_url").alias("player_url"), F.array_join(C.keywords(F.col("m_tags")), "|").alias("keywords"))


_FRAMES = "'<title>Winter boats | Site</title><iframe src=\"/ads/' || page_id || '\"></iframe><iframe class=\"x\" title=\"' || CASE page_id % 3 WHEN 0 THEN 'Winter boats film' WHEN 1 THEN 'winter' ELSE 'other' END || '\" src=\"film/' || page_id || '\"></iframe>'"


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'https://frames.example/a/film/' || page_id END AS player_url FROM pages")
def frame_players(spark: SparkSession, d: str) -> DataFrame:
    """Players among the frames of pages by their titles."""
    df = table(spark, d, "pages").select("page_id", F.expr(_FRAMES).alias("h"), F.lit("https://frames.example/a/b").alias("u"))
    return K.with_metadata(df, "h", "u", "m_").select("page_id", F.col("m_player_url").alias("player_url"))


# Ways to write an address and what it is in canonical form: fixed pairs, with a number from the table.
_WRITTEN = {
    "'HTTP://User:pw@Site.Example:80/a/./b/../c?n=' || page_id || '#f'": ("'http://User:pw@site.example/a/c?n=' || page_id", "site.example", "site"),
    "'http://[2001:DB8::1]:8080/n' || page_id": ("'http://[2001:db8::1]:8080/n' || page_id", "[2001:db8::1]", "[2001:db8::1]"),
    "'  www.m.shop.co.uk?n=' || page_id": ("'https://www.m.shop.co.uk/?n=' || page_id", "www.m.shop.co.uk", "shop"),
    "'https:\\\\news.example:443\\n' || page_id || '/'": ("'https://news.example/n' || page_id || '/'", "news.example", "news"),
    "'https://10.0.0.1/a b/é/' || page_id": ("'https://10.0.0.1/a%20b/%C3%A9/' || page_id", "10.0.0.1", "10.0.0.1"),
    "'localhost:' || page_id": ("NULL", None, None),
    "'ftp://a.example/' || page_id": ("NULL", None, None),
    "'https://m.blog.example/../x/' || page_id || '/..'": ("'https://m.blog.example/x/'", "m.blog.example", "blog"),
}


def _written(values: list) -> str:
    return "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(f"SELECT page_id, {_written([v[0] for v in _WRITTEN.values()])} AS url, {_written([q(v[1]) if v[1] else 'NULL' for v in _WRITTEN.values()])} AS host, {_written([q(v[2]) if v[2] else 'NULL' for v in _WRITTEN.values()])} AS provider FROM pages")
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as people write them in canonical form: ports, user names, IPv6, dot segments, spaces; none for other schemes."""
    made = _written(list(_WRITTEN)).replace("\\", "\\\\")
    df = table(spark, d, "pages").select("page_id", C.normalize_url(F.expr(made)).alias("url"))
    return df.select("page_id", "url", C.url_host(F.col("url")).alias("host"), F.when(F.col("url").isNotNull(), C.provider(F.col("url"))).alias("provider"))


_WORDS = f"nullif(len(list_filter(regexp_split_to_array({s_strip('h')}, {q(C.WS + '+')}), lambda t: t <> '')), 0)"


@query(f"""SELECT page_id, language, word_count, CASE WHEN word_count IS NOT NULL THEN greatest(1, CAST(floor(word_count / {C.WORDS_PER_MINUTE} + 0.5) AS BIGINT)) END AS reading_minutes, CASE WHEN h IS NOT NULL THEN array_to_string(({s_unique('hs')})[1:{C.MAX_HIGHLIGHTS}], '|') END AS highlights
 FROM (SELECT page_id, h, {s_present(s_first('h', C.RX_LANG))} AS language, {_WORDS} AS word_count, list_concat(list_filter({s_texts('h', C.RX_HEADING)}, lambda t: length(t) >= 6)[1:3], list_filter({s_texts('h', C.RX_PARAGRAPH)}, lambda t: length(t) >= 40)[1:3]) AS hs FROM (SELECT page_id, {s_html()} AS h FROM pages))""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Language, words, reading time and highlights of pages."""
    h = F.col("h")
    df = table(spark, d, "pages").select("page_id", C.readable_html(F.col("html"), F.col("content_type")).alias("h")).withColumn("word_count", C.word_count(C.strip_tags(h)).cast("bigint"))
    return df.select("page_id", C.present(C.first(h, C.RX_LANG)).alias("language"), "word_count", C.reading_minutes(F.col("word_count")).cast("bigint").alias("reading_minutes"), F.array_join(C.highlights(h), "|").alias("highlights"))


@query(f"SELECT page_id, len(t) AS n_tokens, len(list_filter(t, lambda x: starts_with(x, '</'))) AS n_closing, len(list_filter(t, lambda x: starts_with(x, '<!'))) AS n_declarations, length(coalesce({s_first('html', C.RX_BODY)}, html)) AS body_length FROM (SELECT page_id, html, regexp_extract_all(html, {q(C.RX_TOKEN)}, 0) AS t FROM pages)")
def html_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the tokens of pages."""
    df = table(spark, d, "pages").select("page_id", "html", F.regexp_extract_all("html", F.lit(C.RX_TOKEN), 0).alias("t"))
    count = lambda p: F.size(F.filter("t", lambda x: x.startswith(p))).cast("bigint")
    some = F.col("t").isNotNull()
    return df.select("page_id", F.when(some, F.size("t").cast("bigint")).alias("n_tokens"), F.when(some, count("</")).alias("n_closing"), F.when(some, count("<!")).alias("n_declarations"), F.length(C.body_html(F.col("html"))).cast("bigint").alias("body_length"))


@query("SELECT tag, count(*) AS n_tags, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def tag_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each tag opens, and on how many pages. Counted per page first, so that a tag on every page shuffles one row per page."""
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag")).withColumn("tag", F.lower("tag"))
    return tags.groupBy("page_id", "tag").count().groupBy("tag").agg(F.sum("count").alias("n_tags"), F.count("page_id").alias("n_pages"))


def s_plain(c: str) -> str:
    return s_collapse(f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')")


def s_long(c: str) -> str:
    return f"list_filter(string_split({s_plain(c)}, ' '), lambda t: length(t) >= 2)"


def s_hits(k: str) -> str:
    return f"len(list_filter(list_transform(coalesce({k}, CAST([] AS VARCHAR[])), lambda x: {s_plain('x')}), lambda x: x <> '' AND contains(flat, x)))"


_SIGNALS = f"SELECT case_id, txt, n_blocks, media, nodes, tr, CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda x: list_contains(have, x))) / len(want) ELSE 0.0 END AS sim, {s_hits('main_keywords')} AS mains, {s_hits('noise_keywords')} AS noisy FROM (SELECT case_id, coalesce(text, '') AS txt, {s_plain(q('') + ' || coalesce(text, ' + q('') + ')')} AS flat, coalesce(len(blocks), 0) AS n_blocks, coalesce(len(list_filter(blocks, lambda b: b.type <> 'text')), 0) AS media, tree_node_count AS nodes, truncated AS tr, main_keywords, noise_keywords, {s_long('coalesce(text, ' + q('') + ')')} AS have, {s_long('coalesce(title_hint, ' + q('') + ')')} AS want FROM quality_cases)"


@query(f"""SELECT case_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS grade, length(txt) AS text_length, n_blocks AS block_count, media AS media_count, round(sim, 3) AS title_similarity, round(ratio, 3) AS noise_ratio, mains AS main_keyword_hits
 FROM (SELECT *, CAST(greatest(0, least(100, floor(least(length(txt) / 1400 * 38, 38) + least(n_blocks / 42 * 16, 16) + least(media, 3) * 2 + sim * 16 + least(mains, 6) * 4 + CASE WHEN nodes IS NULL THEN 0 ELSE least(nodes / 1200 * 8, 8) END - ratio * 18 - CASE WHEN tr THEN 8 ELSE 0 END + 0.5))) AS BIGINT) AS score
 FROM (SELECT *, CASE WHEN noisy + mains > 0 THEN noisy / (noisy + mains) ELSE 0.0 END AS ratio FROM ({_SIGNALS})))""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Score, grade and signals of the quality cases."""
    df = table(spark, d, "quality_cases")
    parts = C.quality(F.col("text"), F.col("blocks"), F.col("tree_node_count"), F.col("title_hint"), F.col("main_keywords"), F.col("noise_keywords"), F.col("truncated"))
    whole = {"score", "text_length", "block_count", "media_count", "main_keyword_hits"}
    rated = df.select("case_id", F.explode(F.array(F.struct(*[v.alias(k) for k, v in parts.items()]))).alias("q"))  # computed once a row
    return rated.select("case_id", *[(F.col(f"q.{k}").cast("bigint") if k in whole else F.col(f"q.{k}")).alias(k) for k in parts])


@query(f"""SELECT card_id, {s_clamp('coalesce(nullif(regexp_replace(title, ' + q(f'^{C.WS}+|{C.WS}+$') + ", '', 'g'), ''), " + s_host('resolved_url') + ')', K.TITLE)} AS title, {s_clamp('description', K.DESCRIPTION)} AS description, {s_clamp('author', K.AUTHOR)} AS author, CASE WHEN regexp_matches(image_url, '^https?://') THEN image_url END AS image_url,
 CASE WHEN resource_type = 'article' THEN {s_clamp('excerpt', K.EXCERPT)} END AS excerpt, CASE WHEN resource_type = 'video' THEN CASE WHEN interaction_mode = 'embeddable' THEN interaction_mode ELSE 'playable' END WHEN resource_type IN ('image', 'audio') THEN 'playable' WHEN resource_type = 'article' THEN CASE WHEN interaction_mode IN ('embeddable', 'expandable') THEN interaction_mode ELSE 'static' END ELSE interaction_mode END AS interaction_mode,
 CASE WHEN resource_type IN ('image', 'audio') THEN resolved_url END AS original_media_url FROM cards""")
def card_fields(spark: SparkSession, d: str) -> DataFrame:
    """Selected and limited fields of cards by their type."""
    df = table(spark, d, "cards")
    kind, mode = F.col("resource_type"), F.col("interaction_mode")
    shown = F.when(kind == "video", F.when(mode == "embeddable", mode).otherwise("playable")).when(kind.isin("image", "audio"), "playable").when(kind == "article", F.when(mode.isin("embeddable", "expandable"), mode).otherwise("static")).otherwise(mode)
    return df.select(
        "card_id", C.clamp_text(F.coalesce(C.trimmed(F.col("title")), C.url_host(F.col("resolved_url"))), K.TITLE).alias("title"), C.clamp_text(F.col("description"), K.DESCRIPTION).alias("description"), C.clamp_text(F.col("author"), K.AUTHOR).alias("author"),
        F.when(F.col("image_url").rlike("^https?://"), F.col("image_url")).alias("image_url"), F.when(kind == "article", C.clamp_text(F.col("excerpt"), K.EXCERPT)).alias("excerpt"), shown.alias("interaction_mode"), F.when(kind.isin("image", "audio"), F.col("resolved_url")).alias("original_media_url"),
    )


def _s_rules() -> dict[str, str]:
    web = lambda c: f"({c} IS NULL OR regexp_matches({c}, '^https?://[^/?#\\s]+'))"
    return {
        "original_url": f"original_url IS NOT NULL AND {web('original_url')}", "resolved_url": f"resolved_url IS NOT NULL AND {web('resolved_url')}", "canonical_url": web("canonical_url"), "image_url": web("image_url"), "embed_url": web("embed_url"), "provider": "length(provider) > 0",
        "resource_type": f"resource_type IN ({s_list(K.TYPES)})", "page_kind": f"page_kind IN ({s_list(K.KINDS)})", "interaction_mode": f"interaction_mode IN ({s_list(K.MODES)})", "duration": "(duration IS NULL OR duration >= 0)",
    }


@query("SELECT card_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({v}, false) THEN '{k}' END" for k, v in _s_rules().items()) + "], lambda x: x IS NOT NULL), ',') AS errors FROM cards")
def card_validation(spark: SparkSession, d: str) -> DataFrame:
    """The rules that each card breaks."""
    return table(spark, d, "cards").select("card_id", F.array_join(K.validation_errors(), ",").alias("errors"))


@query(f"""SELECT c.card_id, coalesce({s_present('c.title')}, {s_present('p.title')}) AS title, coalesce({s_present('c.description')}, {s_present('p.description')}) AS description, coalesce({s_present('c.site_name')}, {s_present('p.site_name')}) AS site_name, coalesce(c.excerpt, p.description) AS excerpt
 FROM (SELECT DISTINCT card_id, page_id, title, description, site_name, excerpt FROM cards) c LEFT JOIN (SELECT page_id, max({_s_meta()['title']}) AS title, max({_s_meta()['description']}) AS description, max({_s_meta()['site_name']}) AS site_name FROM (SELECT page_id, {s_html()} AS h FROM pages) GROUP BY page_id) p USING (page_id)""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields of cards filled from the metadata of their pages; an empty field counts as missing, save where it is kept."""
    heads = table(spark, d, "pages").where(F.col("page_id").isNotNull()).select("page_id", C.head_tags(C.readable_html(F.col("html"), F.col("content_type"))).alias("t"))
    meta = C.page_metadata(F.col("t"), F.lit("https://page.example/"))
    pages = heads.select("page_id", *[meta[k].alias(f"p_{k}") for k in ("title", "description", "site_name")]).groupBy("page_id").agg(*[F.max(f"p_{k}").alias(f"p_{k}") for k in ("title", "description", "site_name")])
    cards = table(spark, d, "cards").select("card_id", "page_id", "title", "description", "site_name", "excerpt").distinct()
    return left_join(cards, pages, "page_id", "card_id").select("card_id", *[C.merge_present(F.col(k), F.col(f"p_{k}")).alias(k) for k in ("title", "description", "site_name")], F.coalesce("excerpt", "p_description").alias("excerpt"))


def s_rated(t: str, blocks: str) -> str:
    """The quality of a text and its blocks without title and tree, by the default keywords."""
    hits = lambda ks: "(" + " + ".join(f"CASE WHEN contains({s_plain(t)}, {q(k)}) THEN 1 ELSE 0 END" for k in ks) + ")"
    noisy, mains = hits(x.strip("-") for x in C.NOISE_KEYWORDS), hits(C.MAIN_KEYWORDS)
    media = f"len(list_filter({blocks}, lambda b: b.type <> 'text'))"
    return f"""CASE WHEN {t} IS NULL THEN -1 ELSE CAST(greatest(0, least(100, floor(least(length({t}) / 1400 * 38, 38) + least(coalesce(len({blocks}), 0) / 42 * 16, 16) + least(coalesce({media}, 0), 3) * 2 + least({mains}, 6) * 4
 - CASE WHEN {noisy} + {mains} > 0 THEN {noisy} / ({noisy} + {mains}) ELSE 0 END * 18 + 0.5))) AS BIGINT) END"""


_CAPTURE = "SELECT page_id, arg_max(struct_pack(t := text, b := blocks), (rendered_at, render_id)) AS r FROM render_results WHERE source = {s} AND page_id IS NOT NULL GROUP BY page_id"


@query(f"""SELECT page_id, CASE WHEN dscore >= sscore THEN 'dynamic-dom' ELSE 'static-html' END AS chosen, greatest(dscore, sscore) AS score, CASE WHEN dscore >= sscore THEN {s_excerpt('d')} ELSE {s_excerpt('s')} END AS excerpt FROM
 (SELECT page_id, s.r.t AS s, d.r.t AS d, {s_rated('s.r.t', 's.r.b')} AS sscore, {s_rated('d.r.t', 'd.r.b')} AS dscore FROM ({_CAPTURE.format(s=q('static-html'))}) s FULL JOIN ({_CAPTURE.format(s=q('dynamic-dom'))}) d USING (page_id))""")
def content_preference(spark: SparkSession, d: str) -> DataFrame:
    """Of the static and the rendered capture of a page, the content of better quality; one aggregation, no join."""
    renders = table(spark, d, "render_results").where(F.col("page_id").isNotNull())
    latest = lambda s: F.max_by(F.when(F.col("source") == s, F.struct("text", "blocks")), F.when(F.col("source") == s, F.struct("rendered_at", "render_id")))
    both = renders.groupBy("page_id").agg(latest("static-html").alias("s"), latest("dynamic-dom").alias("d"))
    keys = [F.lit(list(k)) for k in (C.MAIN_KEYWORDS, C.NOISE_KEYWORDS)]
    for c in "sd":
        rated = C.quality(F.col(f"{c}.text"), F.col(f"{c}.blocks"), F.lit(None).cast("int"), F.lit(None).cast("string"), *keys, F.lit(False))["score"]
        both = both.withColumn(f"{c}_score", F.when(F.col(f"{c}.text").isNull(), -1).otherwise(rated).cast("bigint"))
    wins = F.col("d_score") >= F.col("s_score")
    return both.select("page_id", F.when(wins, "dynamic-dom").otherwise("static-html").alias("chosen"), F.greatest("d_score", "s_score").alias("score"), F.when(wins, C.excerpt(F.col("d.text"))).otherwise(C.excerpt(F.col("s.text"))).alias("excerpt"))


_RENDERED = "'<html lang=\"x' || page_id || '\"><head>' || CASE WHEN page_id % 2 = 0 THEN '<title>Rendered ' || page_id || '</title>' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '<meta name=\"author\" content=\"R' || page_id || '\">' ELSE '' END || '</head><body></body></html>'"
_S_MERGED = {"title": "CASE WHEN page_id % 2 = 0 THEN 'Rendered ' || page_id END", "author": "CASE WHEN page_id % 3 = 0 THEN 'R' || page_id END", "language": "'x' || page_id", "description": "NULL", "site_name": "NULL"}


@query(f"SELECT page_id, {', '.join(f'coalesce({v}, {_s_meta()[k]}) AS {k}' for k, v in _S_MERGED.items() if k != 'language')}, 'x' || page_id AS language FROM (SELECT page_id, {s_html()} AS h, {s_url('url')} AS u FROM pages)")
def dynamic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of pages with those of their rendered captures before them: what the capture says counts, the fetched page fills the rest."""
    pages = table(spark, d, "pages")
    rendered = pages.where(F.col("page_id").isNotNull()).select("page_id", F.expr(_RENDERED).alias("rendered_html"))
    out = pages.transform(K.pipeline(K.bootstrap(), K.fetch_static(), K.dynamic_merge(rendered)))
    return out.select("page_id", "title", "author", "description", "site_name", F.col("snapshot.language").alias("language"))


_E = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"SELECT render_id, array_to_string(list_transform(list_filter(blocks, lambda b: b.type = 'text'), lambda b: '<p>' || {_E.format(c='b.text')} || '</p>'), '') AS html, {s_collapse('array_to_string(list_transform(list_filter(blocks, lambda b: b.type = ' + q('text') + '), lambda b: b.text), ' + q(' ') + ')')} AS text, len(blocks) AS block_count FROM render_results")
def block_html(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks as html and as one text."""
    texts = F.filter("blocks", lambda b: b["type"] == "text")
    return table(spark, d, "render_results").select("render_id", F.array_join(F.transform(texts, lambda b: F.concat(F.lit("<p>"), C.escape_html(b["text"]), F.lit("</p>"))), "").alias("html"), C.collapse(F.array_join(F.transform(texts, lambda b: b["text"]), " ")).alias("text"), F.when(F.col("blocks").isNotNull(), F.size("blocks").cast("bigint")).alias("block_count"))


@query("SELECT provider, resource_type, count(*) AS n_cards, count(DISTINCT page_id) AS n_pages, CAST(sum(CASE WHEN embeddable THEN 1 ELSE 0 END) AS BIGINT) AS n_embeddable FROM (SELECT DISTINCT card_id, page_id, provider, resource_type, embeddable FROM cards) GROUP BY provider, resource_type")
def cards_by_provider(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of cards. Pages are counted from (provider, type, page) groups, so a provider with a third of all rows is spread over its pages."""
    rows = table(spark, d, "cards").select("card_id", "page_id", "provider", "resource_type", "embeddable").distinct()
    by_page = rows.groupBy("provider", "resource_type", "page_id").agg(F.count("*").alias("n"), F.sum(F.col("embeddable").cast("int")).alias("e"))
    return by_page.groupBy("provider", "resource_type").agg(F.sum("n").alias("n_cards"), F.count("page_id").alias("n_pages"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_embeddable"))


@query()
def reader_text(spark: SparkSession, d: str) -> DataFrame:
    """The main content of every page: text, block count, focus and size of its tree."""
    df = table(spark, d, "pages").select("page_id", C.readable_html(F.col("html"), F.col("content_type")).alias("html"), "url").withColumn("c", reader_content("html", "url", None, Options(capture_mode="focused-body")))
    return df.select("page_id", "c.text", "c.html", "c.block_count", "c.truncated", "c.tree_node_count", "c.focused", "c.error")


@query()
def reader_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every page, one a row."""
    df = table(spark, d, "pages").select("page_id", "html", "url").withColumn("c", reader_content("html", "url"))
    return df.select("page_id", F.posexplode("c.blocks").alias("block_no", "b")).select("page_id", "block_no", "b.*")


@query()
def reader_tree(spark: SparkSession, d: str) -> DataFrame:
    """The sanitised tree of every page, one node a row in document order."""
    df = table(spark, d, "pages").select("page_id", "html", "url").withColumn("c", reader_content("html", "url"))
    return df.select("page_id", F.explode("c.tree").alias("n")).select("page_id", "n.idx", "n.parent", "n.depth", "n.subtree_end", "n.kind", "n.tag", "n.text")


@query()
def cards_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: a validated card per page, with rendered captures joined in."""
    rendered = table(spark, d, "render_results").where(F.col("source") == "dynamic-dom").select("page_id", "render_id", "rendered_at", F.col("html").alias("rendered_html"))
    out = K.cards(table(spark, d, "pages"), rendered=rendered)
    return out.select("page_id", "original_url", "resolved_url", "provider", "resource_type", "page_kind", "interaction_mode", "title", "description", "excerpt", "embed_url", "content_text", "content_score", "content_grade", F.array_join("validation_errors", ",").alias("errors"))


_BARE_TYPE = f"CASE WHEN ({s_shape('path')}) = 'direct-image' THEN 'image' WHEN ({s_shape('path')}) = 'direct-audio' THEN 'audio' WHEN ({s_shape('path')}) = 'direct-video' THEN 'video' WHEN {s_article('path')} THEN 'article' WHEN path IN ('/', '') OR ({s_shape('path')}) = 'path-document' THEN 'website' ELSE 'unknown' END"
_BARE_EMBED = "page_kind = 'atomic' AND resource_type IN ('video', 'article') AND (regexp_matches(lower(path), '/embed/|/player/') OR regexp_matches(u, '[?&]embed(=|&|$)'))"


@query(f"""SELECT page_id, provider, resource_type, page_kind, CASE WHEN {_BARE_EMBED} THEN 'embeddable' WHEN resource_type IN ('video', 'image', 'audio') THEN 'playable' WHEN resource_type = 'article' AND page_kind = 'atomic' THEN 'expandable' ELSE 'static' END AS interaction_mode, host AS title
 FROM (SELECT *, {s_kind('path', 'resource_type')} AS page_kind FROM (SELECT page_id, u, path, host, {_PROVIDER} AS provider, {_BARE_TYPE} AS resource_type FROM (SELECT *, list_filter(string_split(bare, '.'), lambda x: x <> '') AS ls FROM ({_LABELS}))))""")
def cards_url_only(spark: SparkSession, d: str) -> DataFrame:
    """Cards from the address alone; no html is read."""
    bare = table(spark, d, "pages").select("page_id", "url").withColumn("html", F.lit(None).cast("string"))
    return K.cards(bare, content=False).select("page_id", "provider", "resource_type", "page_kind", "interaction_mode", "title")


@query()
def cards_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same pipeline, content included, over the pages as a stream, all that is there, read back from its sink."""
    from ..streaming.cards import write_cards

    place = f"{shared_folder(spark)}/cards-stream-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages")
    stream = spark.readStream.schema(pages.schema).parquet(f"{d}/pages.parquet" if pages.inputFiles() and pages.inputFiles()[0].rstrip("/").split("/")[-2] == "pages.parquet" else f"{d}/pages*.parquet")
    write_cards(stream, f"{place}/out", f"{place}/checkpoint", ).awaitTermination()
    return spark.read.parquet(f"{place}/out").select("page_id", "provider", "resource_type", "page_kind", "interaction_mode", "title", "excerpt", "content_text", "content_score")


@query()
def dom_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of rendered pages below their main box, one node a row."""
    from ..operators.dom import dom_tree

    bases = table(spark, d, "pages").where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min(C.normalize_url(F.col("url"))).alias("base"))
    shown = table(spark, d, "render_results").where((F.col("source") == "dynamic-dom") & F.col("page_id").isNotNull())
    df = shown.join(bases, "page_id", "left").select("render_id", dom_tree("html", "base", None, ("article", "[class*=story]"), (".promo-box", "nav", "aside")).alias("t"))
    return df.select("render_id", F.explode("t").alias("n")).select("render_id", "n.idx", "n.parent", "n.depth", "n.subtree_end", "n.kind", "n.tag", "n.text")


@query("SELECT page_id, '<!doctype html><html><head><meta charset=\"utf-8\" /><meta name=\"viewport\" content=\"width=device-width, initial-scale=1\" /><title>' || " + _E.format(c="coalesce(nullif(regexp_replace(t, " + q(f"^{C.WS}+|{C.WS}+$") + ", '', 'g'), ''), 'Preview Document')") + f" || '</title><link rel=\"stylesheet\" href=\"./preview.css\" /></head><body><main class=\"preview-root\">' || '<p>' || coalesce({s_strip('h')}, '') || '</p></main></body></html>' AS document FROM (SELECT page_id, {s_first('html', C.RX_TITLE)} AS t, {s_first('html', C.RX_BODY)} AS h FROM pages)")
def render_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents around the text of pages."""
    from ..operators.dom import render_document

    df = table(spark, d, "pages").select("page_id", C.first(F.col("html"), C.RX_TITLE).alias("t"), C.first(F.col("html"), C.RX_BODY).alias("h"))
    return df.select("page_id", render_document(F.col("t"), F.concat(F.lit("<p>"), F.coalesce(C.strip_tags(F.col("h")), F.lit("")), F.lit("</p>"))).alias("document"))
