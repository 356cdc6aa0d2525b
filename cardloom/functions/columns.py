"""Column functions of the card pipeline: URLs, page metadata, classification, capability, quality, limits.

All are native expressions, so filters and column pruning reach the scan and no row leaves the JVM. What is used several
times within an expression is bound by let, which Spark interprets; the rest is compiled.
A null input gives null unless stated; an empty string counts as missing where metadata are merged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The white space of the web platform, tag and word lists, limits.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp", "ico")
VIDEO_EXTENSIONS = ("mp4", "webm", "mov", "m4v", "ogv")
AUDIO_EXTENSIONS = ("mp3", "wav", "ogg", "m4a", "aac", "flac")
NOT_ARTICLE = ("/tag/", "/tags/", "/category/", "/categories/", "/topics/", "/search", "/archive", "/author/", "/profile/", "/users/", "/about", "/contact", "/privacy", "/terms")
COLLECTIONS = ("/tag/", "/tags/", "/category/", "/categories/", "/search", "/archive", "/topics/", "/collections/", "/list/")
PROFILES = ("/@", "/author/", "/profile/", "/users/", "/user/", "/member/")
NOISE_KEYWORDS = ("nav", "menu", "footer", "sidebar", "banner", "advert", "ad-", "promo", "recommend", "related", "ranking", "gnb", "lnb", "snb", "댓글", "인기", "추천", "광고")
MAIN_KEYWORDS = ("content", "article", "post", "story", "detail", "viewer", "read", "doc", "본문", "콘텐츠", "내용")
MAX_HTML_BYTES = 8_000_000
WORDS_PER_MINUTE, MAX_KEYWORDS, MAX_HIGHLIGHTS = 220, 10, 5

# Patterns over raw html, in a syntax that both Java and RE2 read.
RX_TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
RX_LANG = r"(?i)<html[^>]*\slang=[\"']([^\"']+)[\"']"
RX_ICON = r"(?i)<link[^>]+rel=[\"'][^\"']*icon[^\"']*[\"'][^>]+href=[\"']([^\"']+)[\"'][^>]*>"
RX_CANONICAL = r"(?i)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']+)[\"'][^>]*>"
RX_OEMBED = r"(?i)<link[^>]+type=[\"']application/(?:json|xml)\+oembed[\"'][^>]+href=[\"']([^\"']+)[\"'][^>]*>"
RX_HEADING = r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"
RX_PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
RX_BODY = r"(?is)<body[^>]*>(.*?)</body>"
RX_TOKEN = r"(?s)<!--.*?-->|</?[^>]+>|[^<]+"
RX_CODE = r"(?is)<script.*?</script>|<style.*?</style>"


def rx_meta(key: str) -> str:
    return rf"(?i)<meta[^>]+(?:property|name)=[\"']{key}[\"'][^>]+content=[\"']([^\"']+)[\"'][^>]*>"


def first(html: Column, pattern: str) -> Column:
    """The first group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, WS + "+", " "), "^ | $", "")


def present(c: Column) -> Column:
    """Collapsed text; null where nothing is left."""
    return F.nullif(collapse(c), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, f"^{WS}+|{WS}+$", ""), F.lit(""))


# URLs -----------------------------------------------------------------------------------------------------------------


# Scheme, authority, path and query of a web address; any number of slashes may follow the scheme.
_RX_ADDRESS = r"^(?i)(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_RX_AUTHORITY = r"^(?:[\s\S]*@)?(\[[0-9A-Fa-f:.]+\]|[^:\[\]\s<>^|%@]+)(?::(\d{0,5}))?$"
_RX_ODD_PATH, _RX_ODD_QUERY = r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]", r"[^\x21\x23-\x26\x28-\x3B\x3D\x3F-\x7E]"


# Addresses that are canonical as they stand: next to all, so that the rest may go the slow way.
_RX_CANONICAL = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/(?:[A-Za-z0-9_~!$&'()*+,;=:@-]|/(?!\.)|(?<!/)\.|%(?!2[eE])[0-9A-Fa-f]{2})*(?:\?[A-Za-z0-9_~!$&()*+,;=:@/?.%-]*)?$"


def _escaped(c: Column, odd: str) -> Column:
    """Characters that may not stand in an address as UTF-8 bytes in hexadecimal."""
    one = lambda ch: F.when(ch.rlike(odd), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)
    return F.when(c.rlike(odd), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments carried out."""
    dot, dots = r"^(?i)(\.|%2e)$", r"^(?i)(\.|%2e){2}$"
    step = lambda acc, x: F.when(x.rlike(dots), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x.rlike(dot), acc).otherwise(F.concat(acc, F.array(x)))
    walked = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    closed = F.concat(walked, F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}$"), "/").otherwise(""))
    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), F.regexp_replace(F.concat(F.lit("/"), closed), "^/+", "/")).otherwise(path)


def _canonical(u: Column, fragment: bool) -> Column:
    part = lambda i: F.regexp_extract(u, _RX_ADDRESS, i)
    parts = F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), F.replace(part(3), F.lit("\\"), F.lit("/")).alias("path"), part(4).alias("query"), part(5).alias("tail"))

    def built(p: Column) -> Column:
        host, digits = (F.regexp_extract(p["authority"], _RX_AUTHORITY, i) for i in (1, 2))
        port = digits.try_cast("int")
        own = F.when(port.isNotNull() & (port != F.when(p["scheme"] == "http", 80).otherwise(443)), F.concat(F.lit(":"), port.cast("string"))).otherwise("")
        path = F.when(p["path"] == "", "/").otherwise(let(_without_dots(p["path"]), lambda x: _escaped(x, _RX_ODD_PATH)))
        whole = F.concat(p["scheme"], F.lit("://"), F.regexp_extract(p["authority"], r"^([\s\S]*@)", 1), F.lower(host), own, path, _escaped(p["query"], _RX_ODD_QUERY), *([p["tail"]] if fragment else []))
        return F.when((p["scheme"] != "") & p["authority"].rlike(_RX_AUTHORITY) & (F.coalesce(port, F.lit(0)) <= 65535), whole)

    return let(parts, built)


def canonical_url(u: Column, *, fragment: bool = False) -> Column:
    """A web address in canonical form: scheme and host in small letters, no default port, a path without dot segments; null for one that can't be.

    User names and passwords stay; hosts beyond ASCII stay as they are.
    """
    return F.when(u.rlike(_RX_CANONICAL), u).otherwise(_canonical(u, fragment))


def normalize_url(c: Column) -> Column:
    """Trimmed, with https:// where no scheme is given, canonical, without fragment; null for an empty one or another protocol."""

    def slow(t: Column) -> Column:
        return F.when(t != "", _canonical(F.when(t.rlike(r"^[a-zA-Z][a-zA-Z\d+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t)), False))

    blank = rf"(?:{WS}|[\x00-\x20])+"
    return F.when(c.rlike(_RX_CANONICAL), c).otherwise(let(F.regexp_replace(F.regexp_replace(c, f"^{blank}|{blank}$", ""), r"[\t\r\n]", ""), slow))


def resolve_link(link: Column, base: Column) -> Column:
    """A link as an absolute address, seen from a canonical base; null for an empty one. Other schemes than the web's stay as they are."""

    def whole(x: Column) -> Column:
        root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
        folder = F.regexp_extract(base, r"^([a-z]+://[^/?#]+(?:/[^?#/]*)*/)", 1)
        return (
            F.when(x.rlike(r"^[a-zA-Z][a-zA-Z\d+.-]*:"), x).when(x.rlike(r"^[/\\]{2}"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), x)).when(x.rlike(r"^[/\\]"), F.concat(root, x))
            .when(x.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), x)).when(x.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), x)).otherwise(F.concat(folder, x))
        )

    made = let(let(present(link), whole), lambda w: F.when(w.rlike(r"^(?i)https?:"), canonical_url(w, fragment=True)).otherwise(w))
    return F.when(link.isNotNull(), made)


def url_host(url: Column) -> Column:
    """The host of an address: behind a user name, before a port; of IPv6 with its brackets."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z\d+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z\d+.-]*://[^/?#]+([^?#]*)", 1), "^$", "/")


def normalize_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"^m\.", "")


def provider(url: Column) -> Column:
    """The label of the site: of an address the address, behind a short second level under a country the one before it."""
    host = normalize_host(url_host(url))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    country = (n >= 3) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    label = (
        F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains(":"), host)
        .when(n <= 1, F.try_element_at(labels, F.lit(1)))
        .when(country, F.try_element_at(labels, F.lit(-3)))
        .otherwise(F.try_element_at(labels, F.lit(-2)))
    )
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit("")), r"\.([^.]*)$", 1)), F.lit(""))


def url_shape(path: Column) -> Column:
    return let(F.coalesce(extension(path), F.lit("")), lambda ext: _shape(ext, path))


def _shape(ext: Column, path: Column) -> Column:
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), "direct-image").when(ext.isin(*VIDEO_EXTENSIONS), "direct-video").when(ext.isin(*AUDIO_EXTENSIONS), "direct-audio")
        .when(path.isin("/", ""), "root").when(F.size(segments(path)) >= 2, "path-document").otherwise("unknown")
    )


def article_path(path: Column) -> Column:
    low = F.lower(path)
    barred = reduce(lambda a, b: a | b, [low.contains(x) for x in NOT_ARTICLE])
    return (low != "/") & (F.length(low) >= 5) & ~barred & (low.rlike(r"\d{4}/\d{2}") | (F.size(segments(low)) >= 2))


# Metadata -------------------------------------------------------------------------------------------------------------


def readable_html(html: Column, content_type: Column) -> Column:
    """The html where the content type allows to read it, cut at the byte limit; a character that the cut breaks becomes U+FFFD."""
    low = F.lower(content_type)
    cut = F.make_valid_utf8(F.substring(F.encode(html, "UTF-8"), 1, MAX_HTML_BYTES).cast("string"))
    return F.when(content_type.isNull() | (content_type == "") | low.contains("text/html") | low.contains("application/xhtml+xml"), F.when(F.octet_length(html) > MAX_HTML_BYTES, cut).otherwise(html))


def headers_map(names: Column, values: Column) -> Column:
    """Response headers as a map with small names; of a repeated name the last counts."""
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"]), p["k"]))
    return F.map_from_entries(last)


RX_HEAD_TAG = r"(?i)<(?:meta|link|html)[^>]*>|<title[^>]*>[^<]+</title>|<iframe\b[^>]*>"


def head_tags(html: Column) -> Column:
    """The tags that metadata stand in, one behind the other: a page is gone through once, and the patterns then only see these."""
    return F.array_join(F.regexp_extract_all(html, F.lit(RX_HEAD_TAG), F.lit(0)), "")


def tag_attribute(tag: Column, name: str) -> Column:
    rx = name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    part = lambda i: F.nullif(F.regexp_extract(tag, "(?i)" + rx, i), F.lit(""))
    return present(F.coalesce(part(1), part(2), part(3)))


def title_match(text: Column, candidates: Column) -> Column:
    """1 where a text holds a candidate, else the best share of a candidate's words that it holds."""
    tokens = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) >= 2)
    share = lambda flat: lambda c: F.when(F.contains(flat, c), 1.0).otherwise(let(tokens(c), lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, lambda t: F.contains(flat, t))) / F.size(ts)).otherwise(0.0)))
    return F.when(text.isNull(), 0.0).otherwise(let(_plain(text), lambda flat: F.when(flat == "", 0.0).otherwise(F.coalesce(F.array_max(F.transform(candidates, share(flat))), F.lit(0.0)))))


PLAYER_SCORE = 0.5


def frame_player(tags: Column, title: Column, base: Column) -> Column:
    """The address of the first frame; with a title, of the frame whose own title matches it best, if well enough."""
    frames = F.regexp_extract_all(tags, F.lit(r"(?i)<iframe\b[^>]*>"), F.lit(0))
    names = title_candidates(title, 2)
    rated = F.filter(F.transform(frames, lambda f: F.struct(resolve_link(tag_attribute(f, "src"), base).alias("src"), title_match(tag_attribute(f, "title"), names).alias("fit"))), lambda x: x["src"].isNotNull())
    best = lambda xs, most: F.try_element_at(F.filter(xs, lambda x: (x["fit"] == most) & (most >= PLAYER_SCORE)), F.lit(1))["src"]
    chosen = let(rated, lambda xs: F.when(title.isNull() | (F.size(names) == 0), F.try_element_at(xs, F.lit(1))["src"]).otherwise(let(F.array_max(F.transform(xs, lambda y: y["fit"])), lambda most: best(xs, most))))
    return F.when(tags.rlike(r"(?i)<iframe\b"), chosen)


def strip_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(html, RX_CODE, " "), r"<[^>]+>", " "))


def tag_texts(html: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), strip_tags), lambda t: t != "")


def keywords(html: Column) -> Column:
    raw = first(html, rx_meta("keywords"))
    return F.when(raw.isNotNull(), F.slice(F.array_distinct(F.filter(F.transform(F.split(raw, ","), collapse), lambda t: t != "")), 1, MAX_KEYWORDS))


def highlights(html: Column) -> Column:
    heads = F.slice(F.filter(tag_texts(html, RX_HEADING), lambda t: F.length(t) >= 6), 1, 3)
    parts = F.slice(F.filter(tag_texts(html, RX_PARAGRAPH), lambda t: F.length(t) >= 40), 1, 3)
    return F.slice(F.array_distinct(F.concat(heads, parts)), 1, MAX_HIGHLIGHTS)


def word_count(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, WS + "+"), lambda t: t != ""))
    return F.nullif(n, F.lit(0))


def reading_minutes(words: Column) -> Column:
    return F.when(words.isNotNull(), F.greatest(F.lit(1), F.floor(words / WORDS_PER_MINUTE + 0.5).cast("int")))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def excerpt(text: Column) -> Column:
    return let(collapse(text), lambda t: F.when(F.length(t) >= 60, F.left(t, F.lit(320))))


def title_candidates(title: Column, least: int) -> Column:
    """A title and its parts between separators, without repeats, at most 6."""
    flat = lambda t: collapse(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s]", " "))
    parts = F.filter(F.transform(F.split(title, rf"{WS}*(?:\||-|:|·|•|›|»){WS}*"), flat), lambda p: F.length(p) >= least)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(flat(title)), parts), lambda p: p != "")), 1, 6)


def body_html(html: Column) -> Column:
    return F.coalesce(first(html, RX_BODY), html)


METADATA = ("title", "description", "image_url", "site_name", "author", "published_at", "canonical_url", "og_type", "oembed_url", "player_url", "favicon_url", "language")


def page_metadata(tags: Column, base: Column) -> dict[str, Column]:
    """What a page says of itself in its markup, from its head_tags. oEmbed, player frame and icon are absolute addresses, others as written."""
    meta = lambda key: first(tags, rx_meta(key))
    title = present(first(tags, RX_TITLE))
    return {
        "title": title, "description": present(F.coalesce(meta("description"), meta("og:description"))), "image_url": present(meta("og:image")), "site_name": present(meta("og:site_name")),
        "author": present(meta("author")), "published_at": present(meta("article:published_time")), "canonical_url": present(first(tags, RX_CANONICAL)), "og_type": present(meta("og:type")),
        "oembed_url": resolve_link(first(tags, RX_OEMBED), base), "player_url": F.coalesce(present(F.coalesce(meta("twitter:player"), meta("og:video"), meta("og:video:url"), meta("og:video:secure_url"))), frame_player(tags, title, base)),
        "favicon_url": resolve_link(first(tags, RX_ICON), base), "language": present(first(tags, RX_LANG)),
    }


def first_paragraph(html: Column, least: int = 60) -> Column:
    """The text of the first paragraph that is long enough."""
    return F.try_element_at(F.filter(tag_texts(html, RX_PARAGRAPH), lambda t: F.length(t) >= least), F.lit(1))


def merge_present(*values: Column) -> Column:
    """The first value that has text."""
    return F.coalesce(*[present(v) for v in values])


# Classification and capability ----------------------------------------------------------------------------------------


def _has(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def suggests_article(og_type: Column, text: Column, description: Column, short: Column, words: Column) -> Column:
    og = F.coalesce(F.lower(og_type), F.lit(""))
    at_least = lambda c, n: F.coalesce(F.length(c) >= n, F.lit(False))
    return (
        F.when(og.contains("article"), True).when(og.rlike("website|profile|video|music"), False)
        .otherwise(at_least(text, 220) | at_least(description, 140) | at_least(short, 140) | F.coalesce(words >= 180, F.lit(False)))
    )


def resource_type(path: Column, content_type: Column, og_type: Column, suggests: Column, silent: Column) -> Column:
    """First rule that holds. silent: the metadata say nothing at all."""
    kind, og, shape = F.coalesce(F.lower(content_type), F.lit("")), F.coalesce(F.lower(og_type), F.lit("")), url_shape(path)
    return (
        F.when((shape == "direct-image") | kind.contains("image/"), "image").when((shape == "direct-audio") | kind.contains("audio/"), "audio").when((shape == "direct-video") | kind.contains("video/"), "video")
        .when(og.contains("profile") | og.contains("social"), "social").when(og.contains("article"), "article").when(article_path(path) & (suggests | silent), "article")
        .when(path.isin("/", ""), "website").when(shape == "path-document", "website").otherwise("unknown")
    )


def page_kind(path: Column, kind: Column) -> Column:
    low = F.lower(path)
    starts = lambda xs: reduce(lambda a, b: a | b, [low.startswith(x) for x in xs])
    return F.when(url_shape(path) == "root", "homepage").when(starts(COLLECTIONS), "collection").when(starts(PROFILES), "profile").when(kind.isin("video", "image", "audio", "article", "social"), "atomic").otherwise("unknown")


def embed_url(url: Column, kind: Column, page: Column, oembed: Column, player: Column) -> Column:
    """Where an atomic video, post or article can be embedded from: its oEmbed address, its player, or itself by its shape."""
    shaped = F.lower(url_path(url)).rlike("/embed/|/player/") | url.rlike(r"[?&]embed(=|&|$)")
    return F.when((page == "atomic") & kind.isin("video", "social", "article"), F.coalesce(F.nullif(oembed, F.lit("")), F.nullif(player, F.lit("")), F.when(shaped, url)))


def playable(embeddable: Column, kind: Column, content_type: Column, path: Column) -> Column:
    direct = kind.isin("image", "audio") | (kind == "video") & (F.coalesce(F.lower(content_type), F.lit("")).contains("video/") | F.coalesce(extension(path), F.lit("")).isin(*VIDEO_EXTENSIONS))
    return (embeddable & (kind == "video")) | direct


def interaction_mode(embeddable: Column, can_play: Column, kind: Column, page: Column) -> Column:
    return F.when(embeddable, "embeddable").when(can_play, "playable").when((kind == "article") & (page == "atomic"), "expandable").otherwise("static")


# Quality --------------------------------------------------------------------------------------------------------------


def _plain(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "))


def overlap_ratio(text: Column, target: Column) -> Column:
    """Share of the target's words, repeats counted, that the text has."""
    long = lambda c: F.filter(F.split(_plain(F.coalesce(c, F.lit(""))), " "), lambda t: F.length(t) >= 2)
    share = lambda want: let(long(text), lambda have: F.size(F.filter(want, lambda t: F.array_contains(have, t))) / F.size(want))
    return let(long(target), lambda want: F.when(F.size(want) > 0, share(want)).otherwise(F.lit(0.0)))


def keyword_hits(text: Column, words: Column) -> Column:
    known = F.transform(F.coalesce(words, F.array().cast("array<string>")), _plain)
    return let(_plain(text), lambda flat: F.size(F.filter(known, lambda k: (k != "") & F.contains(flat, k))))


def quality(text: Column, blocks: Column, nodes: Column, title: Column, main: Column, noise: Column, truncated: Column) -> dict[str, Column]:
    """Score from 0 to 100, its grade and its signals. A tree without a known size adds nothing."""
    text = F.coalesce(text, F.lit(""))
    n_blocks = F.when(blocks.isNull(), 0).otherwise(F.size(blocks))
    media = F.when(blocks.isNull(), 0).otherwise(F.size(F.filter(blocks, lambda b: b["type"] != "text")))
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(float(hi)), c))

    def signals(flat: Column) -> Column:
        """All that is counted in the text, whose plain form is made once."""
        tokens = lambda c: F.filter(F.split(c, " "), lambda t: F.length(t) >= 2)
        words = lambda ks: F.transform(F.coalesce(ks, F.array().cast("array<string>")), _plain)
        hits = lambda ks: F.size(F.filter(words(ks), lambda k: (k != "") & F.contains(flat, k)))
        share = let(tokens(_plain(F.coalesce(title, F.lit("")))), lambda want: F.when(F.size(want) > 0, let(tokens(flat), lambda have: F.size(F.filter(want, lambda t: F.array_contains(have, t))) / F.size(want))).otherwise(0.0))
        return F.struct(share.alias("similarity"), hits(noise).alias("noisy"), hits(main).alias("mains"), F.length(text).alias("length"), n_blocks.alias("blocks"), media.alias("media"))

    def rated(s: Column) -> Column:
        ratio = F.when(s["noisy"] + s["mains"] > 0, s["noisy"] / (s["noisy"] + s["mains"])).otherwise(0.0)
        raw = (
            clamp(s["length"] / 1400 * 38, 38) + clamp(s["blocks"] / 42 * 16, 16) + clamp(s["media"].cast("double"), 3) * 2 + s["similarity"] * 16 + clamp(s["mains"].cast("double"), 6) * 4
            + F.when(nodes.isNotNull(), clamp(nodes / 1200 * 8, 8)).otherwise(0.0) - ratio * 18 - F.when(truncated, 8).otherwise(0)
        )
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))).cast("int")
        return F.struct(score.alias("score"), F.round(s["similarity"], 3).alias("title_similarity"), F.round(ratio, 3).alias("noise_ratio"), s["mains"].alias("main_keyword_hits"), s["length"].alias("text_length"), s["blocks"].alias("block_count"), s["media"].alias("media_count"))

    all_ = let(let(_plain(text), signals), rated)
    grade = F.when(all_["score"] >= 80, "excellent").when(all_["score"] >= 60, "good").when(all_["score"] >= 40, "fair").otherwise("poor")
    return {"score": all_["score"], "grade": grade} | {k: all_[k] for k in ("text_length", "block_count", "media_count", "title_similarity", "noise_ratio", "main_keyword_hits")}


# Limits and rendering -------------------------------------------------------------------------------------------------


def clamp_text(c: Column, most: int) -> Column:
    """Collapsed and cut to a length, with an ellipsis in its last place; null for an empty text."""
    return let(F.nullif(collapse(c), F.lit("")), lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t))


def clamp_raw(c: Column, most: int) -> Column:
    t = F.nullif(c, F.lit(""))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 1)), F.lit("…"))).otherwise(t)


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_web_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^/?#\s]+")
