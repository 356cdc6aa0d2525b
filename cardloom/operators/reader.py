"""Main content of a page as blocks, text, semantic html and a flat tree: one Arrow-batched function per page.

A page is parsed into columns, not objects: nodes in document order with their kind, tag, attributes, text, parent, and
the number of the first node behind their subtree. Sums over a subtree are then differences of running sums, so every
candidate for the main content is rated in constant time, and a limit on nodes is a prefix. Nothing here raises: a page
that can't be read gives an error and no content.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import accumulate
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.columns import MAIN_KEYWORDS, NOISE_KEYWORDS

# Tags, attributes and words with a meaning of their own, entities, limits and thresholds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg canvas object embed head".split())
UNWRAPPED = frozenset("html body".split())
GLOBAL_ATTRS = frozenset("id class role title aria-label lang dir".split())
TAG_ATTRS = {
    "a": "href", "img": "src data-src alt width height loading decoding", "video": "src poster controls autoplay muted loop playsinline", "audio": "src controls autoplay muted loop",
    "iframe": "src title loading allow allowfullscreen referrerpolicy", "source": "src type media", "picture": "src",
}
TAG_ATTRS = {k: frozenset(v.split()) for k, v in TAG_ATTRS.items()}
BREAKS = frozenset("main article section div p li h1 h2 h3 h4 h5 h6 blockquote pre table tr td th video audio iframe".split())
FOCUSABLE, PRIMARY, HEADINGS = frozenset("main article section div".split()), frozenset("main article".split()), frozenset("h1 h2 h3 h4".split())
POSITIVE = re.compile(r"content|main|article|post|entry|story|body|detail|viewer|view|read|doc|document|place|panel", re.I)
NEGATIVE = re.compile(r"nav|menu|header|footer|sidebar|toolbar|tabbar|share|ad|banner|popup|modal|cookie|login|search|gnb|lnb|snb", re.I)
NOISE_TAGS = frozenset("nav aside footer".split())
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "apos": "'", "#39": "'"}
MAX_BLOCKS, MAX_NODES, MAX_HTML, MAX_TEXT, MIN_TEXT, FOCUS = 900, 4_000, 240_000, 180_000, 40, 180
VIEW_DROPPED = DROPPED | frozenset("meta link header nav footer aside".split())
VIEW_BLOCKS = frozenset("article section main div p li blockquote pre table tr td th".split())

_WS = re.compile("[\t\n\x0b\f\r    -     　﻿]+")
_TOKEN = re.compile(r"<!--[\s\S]*?-->|</?[^>]+>|[^<]+")
_NAME = re.compile(r"<\s*/?\s*([a-zA-Z0-9:-]+)")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ENTITY = re.compile(r"&(#x[0-9a-f]+|#\d+|[a-z][a-z0-9]*);", re.I)
_SPLIT = re.compile(r"\s*(?:\||-|:|·|•|›|»)\s*")
_PORT = {"http": ":80", "https": ":443"}


def decode_entities(text: str) -> str:
    """The few named entities and all numeric ones; other names vanish. Raises ValueError beyond the last code point."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name.lower(), "")
        return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))

    return _ENTITY.sub(one, text) if "&" in text else text


def tidy(text: str | None) -> str:
    return _WS.sub(" ", decode_entities(text)).strip(" ") if text else ""


def _dots(path: str) -> str:
    """A path without '.' and '..'."""
    out: list[str] = []
    parts = path.split("/")
    for i, part in enumerate(parts):
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/".join(out) or "/"


@lru_cache(maxsize=20_000)
def join_url(base: str, link: str) -> str | None:
    """A link as an absolute URL in canonical form; None if it can't be one."""
    try:
        parts = urlsplit(urljoin(base, link.replace("\\", "/")))
        if not parts.scheme:
            return None
        if parts.scheme not in ("http", "https"):
            return parts.geturl()
        host = (parts.hostname or "").encode("idna").decode() if not (parts.hostname or "").isascii() else parts.hostname
        if not host:
            return None
        port = f":{parts.port}" if parts.port and f":{parts.port}" != _PORT[parts.scheme] else ""
        return urlunsplit((parts.scheme, host + port, quote(_dots(parts.path or "/"), safe="/%:@!$&'()*+,;=~-._"), quote(parts.query, safe="/%:@!$&'()*+,;=?~-._"), parts.fragment))
    except (ValueError, UnicodeError):
        return None


def _link(value: str | None, base: str, schemes: tuple[str, ...]) -> str | None:
    url = join_url(base, tidy(value)) if value and tidy(value) else None
    return url if url and urlsplit(url).scheme in schemes else None


def parse_attributes(source: str) -> dict[str, str | None]:
    """Lower-case names to decoded values; a bare name has None; the last of a repeated name counts."""
    return {m[1].lower(): next((decode_entities(v) for v in (m[2], m[3], m[4]) if v is not None), None) for m in _ATTR.finditer(source)}


def clean_attributes(tag: str, attrs: dict[str, str | None], base: str) -> dict[str, str | None]:
    own = TAG_ATTRS.get(tag, frozenset())
    out: dict[str, str | None] = {}
    for name, value in attrs.items():
        if name.startswith("on") or name in ("style", "srcdoc") or not (name.startswith(("data-", "aria-")) or name in GLOBAL_ATTRS or name in own):
            continue
        if name == "href":
            value = _link(value, base, ("http", "https", "mailto", "tel"))
        elif name in ("src", "data-src", "poster"):
            value, name = _link(value, base, ("http", "https")), "src" if name == "data-src" and "src" in own else name
        elif value is not None:
            value = tidy(value)
        elif value is None:
            out[name] = None
            continue
        if value:
            out[name] = value
    return out


@dataclass
class Tree:
    """Nodes in document order; tag is '' for text. end is the number of the first node that is not below."""

    tag: list[str] = field(default_factory=list)
    attrs: list[dict] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)

    def add(self, tag: str, attrs: dict, text: str, parent: int) -> int:
        n = len(self.tag)
        for column, x in ((self.tag, tag), (self.attrs, attrs), (self.text, text), (self.parent, parent), (self.depth, self.depth[parent] + 1 if parent >= 0 else 0), (self.end, n + 1)):
            column.append(x)
        return n

    def sums(self) -> None:
        """Running sums of text, text inside links, images and elements, and the hint of every element."""
        linked = [False] * len(self.tag)
        for i, p in enumerate(self.parent):
            linked[i] = p >= 0 and (linked[p] or self.tag[p] == "a")
        run = lambda xs: [0, *accumulate(xs)]
        self.chars = run(len(t) for t in self.text)
        self.link_chars = run(len(t) if a else 0 for t, a in zip(self.text, linked))
        self.images = run(t == "img" for t in self.tag)
        self.elements = run(t != "" for t in self.tag)
        self.hint = [" ".join(v for k in ("id", "class", "role", "title", "aria-label") if (v := a.get(k))).lower() if a else "" for a in self.attrs]

    def stat(self, i: int) -> tuple[int, float, int, int]:
        """Text length, share of it in links (the node itself taken as a link if it is one), images and elements of a subtree."""
        j = self.end[i]
        chars = self.chars[j] - self.chars[i]
        links = chars if self.tag[i] == "a" else self.link_chars[j] - self.link_chars[i]
        return chars, links / chars if chars else 0.0, self.images[j] - self.images[i], self.elements[j] - self.elements[i]

    def below(self, i: int, most: int) -> str:
        """Text below a node, up to the piece with which it is long enough."""
        out: list[str] = []
        size = 0
        for k in range(i, self.end[i]):
            if self.text[k]:
                out.append(self.text[k])
                size += len(self.text[k]) + (len(out) > 1)
                if size >= most:
                    break
        return " ".join(out)


def parse(html: str, base: str) -> Tree:
    """Tokens to a sanitised tree in one pass. A closing tag closes up to the nearest open tag of its name; none is implied."""
    tree = Tree()
    open_: list[tuple[str, int, bool]] = []  # tag, node or the nearest one above, hidden

    def close(to: int) -> None:
        for name, node, hidden in open_[to:]:
            if not hidden and name not in UNWRAPPED:
                tree.end[node] = len(tree.tag)
        del open_[to:]

    for m in _TOKEN.finditer(html):
        token = m[0]
        above, hidden = (open_[-1][1], open_[-1][2]) if open_ else (-1, False)
        if token[0] != "<":
            if not hidden and (text := tidy(token)):
                tree.add("", {}, text, above)
            continue
        if token.startswith(("<!", "<?")) or not (name := _NAME.match(token)):
            continue
        tag = name[1].lower()
        if token.startswith("</"):
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), -1)
            if at >= 0:
                close(at)
            continue
        node, gone = above, hidden or tag in DROPPED
        if not gone and tag not in UNWRAPPED:
            attrs = clean_attributes(tag, parse_attributes(token[name.end() : -1].rstrip("/")), base)
            gone = tag in ("img", "iframe") and not attrs.get("src")
            if not gone:
                node = tree.add(tag, attrs, "", above)
        if tag not in VOID and not token.endswith("/>"):
            open_.append((tag, node, gone))
    close(0)
    tree.sums()
    return tree


def from_nodes(nodes, base: str) -> Tree:
    """A sanitised tree from nodes in document order (kind, tag, attrs, text, parent), as a renderer hands them in."""
    tree = Tree()
    place: list[int | None] = []  # node or the nearest one above that is kept; None below a dropped one
    for n in nodes:
        at = n["parent"]
        above = -1 if at is None or not 0 <= at < len(place) else place[at]
        here = above
        if above is not None and n["kind"] == "text":
            if text := tidy(n["text"]):
                tree.add("", {}, text, above)
        elif above is not None:
            tag = (n["tag"] or "").lower()
            attrs = clean_attributes(tag, dict(n["attrs"] or {}), base)
            if not tag or tag in DROPPED or tag in ("img", "iframe") and not attrs.get("src"):
                here = None
            elif tag not in UNWRAPPED:
                here = tree.add(tag, attrs, "", above)
        place.append(here)
    for i in range(len(tree.tag) - 1, -1, -1):
        if (p := tree.parent[i]) >= 0:
            tree.end[p] = max(tree.end[p], tree.end[i])
    tree.sums()
    return tree


@dataclass(frozen=True)
class Options:
    source: str = "static-html"
    capture_mode: str | None = None
    min_text_length: int = MIN_TEXT
    max_blocks: int = MAX_BLOCKS
    max_nodes: int = MAX_NODES
    max_html: int = MAX_HTML
    max_text: int = MAX_TEXT
    focus_threshold: int = FOCUS
    focus_main: bool = True
    focus_title: bool = True
    noise_keywords: tuple[str, ...] = ()
    main_keywords: tuple[str, ...] = ()
    drop_tags: tuple[str, ...] = ()

    def with_words(self, noise, main, drop) -> Options:
        """The same options with the words that a row's rules add."""
        more = lambda a, b: (*a, *b) if b is not None else a
        return replace(self, noise_keywords=more(self.noise_keywords, noise), main_keywords=more(self.main_keywords, main), drop_tags=more(self.drop_tags, drop))

    @lru_cache(maxsize=1024)  # noqa: B019
    def noise(self) -> tuple[tuple[str, ...], tuple[str, ...], frozenset]:
        more = lambda xs: tuple(k for x in xs if len(k := x.strip().lower()) > 1)
        return tuple(dict.fromkeys(NOISE_KEYWORDS + more(self.noise_keywords))), tuple(dict.fromkeys(MAIN_KEYWORDS + more(self.main_keywords))), NOISE_TAGS | frozenset(more(self.drop_tags))


def plain(text: str) -> str:
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c.isspace() else " " for c in text.lower()).split())


def title_parts(title: str, least: int = 3) -> list[str]:
    parts = [plain(title)] + [p for x in _SPLIT.split(title) if len(p := plain(x)) >= least]
    return list(dict.fromkeys(p for p in parts if p))[:6]


def title_score(text: str, parts: list[str]) -> float:
    """How well a heading matches a title: holding a part counts by how much of the heading it is, else by shared words."""
    flat = plain(text)
    best = 0.0
    for p in parts if flat else ():
        if p in flat or flat in p:
            short, long = sorted((len(p), len(flat)))
            best = max(best, 0.65 + 0.35 * min(1.0, short / long))
        else:
            tokens = [t for t in p.split() if len(t) >= 2]
            best = max(best, 0.7 * sum(t in flat for t in tokens) / len(tokens)) if tokens else best
    return best


def is_noise(tree: Tree, i: int, control) -> bool:
    noise, main, tags = control
    if tree.tag[i] in tags:
        return True
    hint = tree.hint[i]
    if any(k in hint for k in main):
        return False
    chars, density, images, _ = tree.stat(i)
    return any(k in hint for k in noise) and chars < 1600 and images < 4 or tree.tag[i] not in PRIMARY and density >= 0.82 and chars < 420


def focus_root(tree: Tree, options: Options, control) -> int | None:
    """The node that rates best as main content, above the threshold."""
    best: tuple[float, int, int] | None = None
    for i in sorted((k for k, t in enumerate(tree.tag) if t in FOCUSABLE), key=lambda k: (tree.end[k], -k)):
        chars, density, images, elements = tree.stat(i)
        if chars < 60 and images < 1 or is_noise(tree, i, control):
            continue
        good = bool(POSITIVE.search(tree.hint[i]))
        score = chars + 180 * images + 220 * (tree.tag[i] in PRIMARY) + 120 * good - 420 * density - 160 * (not good and bool(NEGATIVE.search(tree.hint[i]))) - 1.6 * max(0, elements - 280)
        if best is None or (score, chars) > best[:2]:
            best = (score, chars, i)
    return best[2] if best and best[0] >= options.focus_threshold else None


def title_root(tree: Tree, title: str, control) -> int | None:
    """The box around the heading that matches the title, if the two rate well together."""
    parts = title_parts(title)
    best: tuple[float, int] | None = None
    seen = set()
    for i, tag in enumerate(tree.tag):
        if tag not in HEADINGS or not parts or (match := title_score(tree.below(i, 320), parts)) < 0.4:
            continue
        chain = []
        while (p := tree.parent[chain[-1] if chain else i]) >= 0:
            chain.append(p)
        box = next((k for k in chain if tree.tag[k] in ("article", "main", "section")), None) or next((k for k in chain if tree.tag[k] == "div"), None)
        box = box if box is not None else chain[0] if chain else None
        if box is None or box in seen:
            continue
        seen.add(box)
        if is_noise(tree, box, control):
            continue
        chars, density, images, elements = tree.stat(box)
        score = 1000 * match + chars + 120 * images + 110 * bool(POSITIVE.search(tree.hint[box])) - 260 * density - 130 * bool(NEGATIVE.search(tree.hint[box])) - 1.1 * max(0, elements - 320)
        if best is None or score > best[0]:
            best = (score, box)
    return best[1] if best and best[0] >= 220 else None


def collect_blocks(tree: Tree, start: int, stop: int, control) -> list[dict]:
    """Text and media of a stretch of nodes in order, without noise; texts join up to the next boundary."""
    noise, _, tags = control
    blocks: list[dict] = []
    fresh, i = True, start
    closing: list[int] = []
    while i < stop:
        while closing and closing[-1] <= i:
            closing.pop()
            fresh = True
        tag = tree.tag[i]
        if not tag:
            if not fresh and blocks and blocks[-1]["type"] == "text":
                blocks[-1]["text"] += " " + tree.text[i]
            else:
                blocks.append({"type": "text", "text": tree.text[i]})
            fresh = False
            i += 1
            continue
        boundary = tag in BREAKS
        fresh = fresh or boundary
        if (tag in tags or any(k in tree.hint[i] for k in noise)) and is_noise(tree, i, control):
            i = tree.end[i]
            continue
        if tag in ("img", "video", "iframe"):
            a = tree.attrs[i]
            src = a.get("src") or tag == "video" and next((tree.attrs[k].get("src") for k in range(i + 1, tree.end[i]) if tree.parent[k] == i and tree.tag[k] == "source" and tree.attrs[k].get("src")), None)
            if src:
                extra = {"img": "alt", "video": "poster", "iframe": "title"}[tag]
                blocks.append({"type": "image" if tag == "img" else tag, "src": src, extra: a.get(extra)})
                fresh = True
            i = tree.end[i]
            continue
        if boundary:
            closing.append(tree.end[i])
        i += 1
    return blocks


def _html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attr(text: str) -> str:
    return _html(text).replace('"', "&quot;")


def _media(kind: str, src: str, extra: str | None) -> str:
    if kind == "image":
        inner = f'<img src="{_attr(src)}" alt="{_attr(extra or "")}" loading="lazy" />'
    elif kind == "video":
        inner = f'<video controls preload="metadata" src="{_attr(src)}"' + (f' poster="{_attr(extra)}"' if extra else "") + "></video>"
    else:
        inner = f'<iframe src="{_attr(src)}" title="{_attr(extra or "Embedded content")}" loading="lazy" allowfullscreen></iframe>'
    return f'<figure class="pv-media pv-{kind}">{inner}</figure>'


def semantic_pieces(tree: Tree, start: int, stop: int) -> list[tuple[bool, str]]:
    """Pieces of semantic html in order as (opens a section, html): paragraphs, headings, media and lists."""
    out: list[tuple[bool, str]] = []
    words: list[str] = []
    closing: list[int] = []

    def flush() -> None:
        if words:
            out.append((False, f"<p>{_html(' '.join(words))}</p>"))
            words.clear()

    i = start
    while i < stop:
        while closing and closing[-1] <= i:
            closing.pop()
            flush()
        tag, a, end = tree.tag[i], tree.attrs[i], min(tree.end[i], stop)
        if not tag:
            words.append(tree.text[i])
            i += 1
        elif tag in VIEW_DROPPED:
            i = end
        elif tag == "br":
            flush()
            i = end
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            flush()
            if text := tree.below(i, 220)[:220].strip():
                out.append((True, f"<p>{_html(text)}</p>"))
            i = end
        elif tag in ("img", "video", "iframe"):
            flush()
            src = a.get("src") or tag == "video" and next((tree.attrs[k].get("src") for k in range(i + 1, end) if tree.parent[k] == i and tree.tag[k] == "source"), None)
            if src:
                out.append((False, _media("image" if tag == "img" else tag, src, a.get({"img": "alt", "video": "poster", "iframe": "title"}[tag]))))
            i = end
        elif tag in ("ul", "ol"):
            flush()
            items = [t for k in range(i + 1, end) if tree.parent[k] == i and tree.tag[k] == "li" and (t := tree.below(k, 280)[:280].strip())][:16]
            if items:
                out.append((False, f'<{tag} class="pv-list">' + "".join(f"<li>{_html(t)}</li>" for t in items) + f"</{tag}>"))
            i = end
        else:
            if tag in VIEW_BLOCKS:
                flush()
                closing.append(tree.end[i])
            i += 1
    flush()
    return out


def semantic_html(pieces: list[tuple[bool, str]]) -> str:
    sections: list[list[str]] = []
    for opens, html in pieces:
        if opens or not sections:
            sections.append([])
        sections[-1].append(html)
    return '<article class="pv-article">' + "".join(f'<section class="pv-section">{"".join(s)}</section>' for s in sections) + "</article>" if sections else ""


def render_block(b: dict) -> str:
    if b["type"] == "text":
        return f"<p>{_html(b['text'])}</p>"
    if b["type"] == "image":
        return f'<img src="{_attr(b["src"])}" alt="{_attr(b.get("alt") or "")}" loading="lazy" />'
    if b["type"] == "video":
        return f'<video controls preload="metadata" src="{_attr(b["src"])}"' + (f' poster="{_attr(b["poster"])}"' if b.get("poster") else "") + "></video>"
    return f'<iframe src="{_attr(b["src"])}" title="{_attr(b.get("title") or "Embedded content")}" loading="lazy" allowfullscreen></iframe>'


def index_html(title: str | None, html: str) -> str:
    """A whole page around the html of a content."""
    head = (title or "").strip() or "Preview Document"
    return f'<!doctype html><html><head><meta charset="utf-8" /><meta name="viewport" content="width=device-width, initial-scale=1" /><title>{_html(head)}</title><link rel="stylesheet" href="./preview.css" /></head><body><main class="preview-root">{html}</main></body></html>'


def quality_of(text: str, blocks: list[dict], nodes: int | None, title: str | None, main: tuple[str, ...], noise: tuple[str, ...], truncated: bool) -> dict:
    """Score from 0 to 100, grade and signals of a content; the same figures as the column function quality."""
    flat = plain(text)
    words = {t for t in flat.split() if len(t) >= 2}
    wanted = [t for t in plain(title or "").split() if len(t) >= 2]
    similarity = sum(t in words for t in wanted) / len(wanted) if wanted and words else 0.0
    hits = lambda keys: sum(k in flat for x in keys if (k := plain(x))) if flat else 0
    noisy, mains, media = hits(noise), hits(main), sum(b["type"] != "text" for b in blocks)
    ratio = noisy / (noisy + mains) if noisy + mains else 0.0
    raw = min(len(text) / 1400 * 38, 38) + min(len(blocks) / 42 * 16, 16) + min(media, 3) * 2 + similarity * 16 + min(mains, 6) * 4 + (min(nodes / 1200 * 8, 8) if nodes is not None else 0.0) - ratio * 18 - (8 if truncated else 0)
    score = max(0, min(100, math.floor(raw + 0.5)))
    grade = "excellent" if score >= 80 else "good" if score >= 60 else "fair" if score >= 40 else "poor"
    return {"score": score, "grade": grade, "title_similarity": round(similarity, 3), "noise_ratio": round(ratio, 3), "main_keyword_hits": mains, "media_count": media}


_PARAGRAPH = re.compile(r"<p[^>]*>([\s\S]*?)</p>", re.I)
_CODE = re.compile(r"<script[\s\S]*?</script>|<style[\s\S]*?</style>", re.I)
_ANY_TAG = re.compile(r"<[^>]+>")


def first_paragraph(html: str, least: int = 60) -> str | None:
    """The text of the first paragraph that is long enough."""
    for m in _PARAGRAPH.finditer(html):
        inner = m[1]
        if "<" in inner:
            inner = _ANY_TAG.sub(" ", _CODE.sub(" ", inner))
        if len(text := tidy(inner)) >= least:
            return text
    return None


def _rendered(tree: Tree, start: int, stop: int, options: Options, control) -> dict | None:
    blocks = collect_blocks(tree, start, stop, control)
    if not blocks:
        return None
    truncated = len(blocks) > options.max_blocks
    blocks = blocks[: options.max_blocks]
    # Limits on tree nodes are prefixes of the document order.
    pieces = semantic_pieces(tree, start, min(stop, start + max(200, 8 * options.max_blocks)))

    def show(n: int) -> str:
        return semantic_html(pieces[:n]) or "".join(map(render_block, blocks[:n]))

    n = len(blocks)
    if len(show(n)) > options.max_html:
        low, high = 0, n - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(show(mid)) <= options.max_html else (low, mid - 1)
        n, truncated = low, True
    if not n or not (html := show(n)):
        return None
    blocks = blocks[:n]
    text = _WS.sub(" ", " ".join(b["text"] for b in blocks if b["type"] == "text")).strip(" ")
    if len(text) < options.min_text_length and all(b["type"] == "text" for b in blocks):
        return None
    return {"html": html, "text": text[: options.max_text], "block_count": n, "truncated": truncated or len(text) > options.max_text, "blocks": blocks}


def recompose(html: str | None, base: str | None, title: str | None = None, options: Options = Options(), nodes=None) -> dict:
    """The content of a page, from its html or the nodes of its tree; only error is set where it can't be read, and nothing where there is none."""
    if not html and nodes is None:
        return {}
    try:
        if nodes is not None:
            tree = from_nodes(nodes, base or "")
        else:
            body = re.search(r"<body[^>]*>([\s\S]*?)</body>", html, re.I)
            tree = parse(body[1] if body else html, base or "")
    except (ValueError, OverflowError) as e:
        return {"error": type(e).__name__}
    n = len(tree.tag)
    control = options.noise()
    chosen = title_root(tree, title, control) if options.focus_title and title else None
    by_title = chosen is not None
    main = focus_root(tree, options, control) if options.focus_main else None
    chosen = chosen if by_title else main
    span = lambda i: (0, n) if i is None else (i, tree.end[i])
    got, focused = _rendered(tree, *span(chosen), options, control), chosen is not None
    if got is None and by_title:
        got, focused = _rendered(tree, *span(main), options, control), main is not None
    if got is None and focused:
        got, focused = _rendered(tree, 0, n, options, control), False
    if got is None:
        return {}
    kept = min(n, options.max_nodes)
    rows = [
        {"idx": i, "parent": tree.parent[i], "depth": tree.depth[i], "subtree_end": min(tree.end[i], kept), "kind": "element" if tree.tag[i] else "text", "tag": tree.tag[i] or None, "attrs": tree.attrs[i] or None, "text": tree.text[i] or None}
        for i in range(kept)
    ]
    truncated = got["truncated"] or n > kept
    own = quality_of(got["text"], got["blocks"], kept, title, control[1], control[0], truncated)
    return got | own | {
        "truncated": truncated, "tree": rows, "tree_node_count": kept, "source": options.source, "capture_mode": options.capture_mode or ("focused-body" if focused else "full-body"), "focused": focused,
        "first_paragraph": first_paragraph(got["html"]), "index_html": index_html(title, got["html"]),
    }


BLOCK = "struct<type:string,text:string,src:string,alt:string,poster:string,title:string>"
NODE = "struct<idx:int,parent:int,depth:int,subtree_end:int,kind:string,tag:string,attrs:map<string,string>,text:string>"
CONTENT = (
    f"html string, text string, block_count int, truncated boolean, blocks array<{BLOCK}>, tree array<{NODE}>, tree_node_count int, source string, capture_mode string, focused boolean, error string, "
    "score int, grade string, title_similarity double, noise_ratio double, main_keyword_hits int, media_count int, first_paragraph string, index_html string"
)
_FIELDS = tuple(f.strip().split(" ")[0] for f in CONTENT.replace(BLOCK, "").replace(NODE, "").split(", "))


def reader_content(html: Column | str, base: Column | str, title: Column | str | None = None, options: Options = Options(), *, noise: Column | None = None, main: Column | None = None, drop: Column | None = None, nodes: Column | None = None, select: Column | None = None, remove: Column | None = None, otherwise: Options | None = None) -> Column:
    """The content struct of a page. Unused, it is pruned with its html; used twice, it is computed once.

    noise, main and drop are words that the rules of a row add. nodes is the tree of a rendered page, which counts before
    its html; without one, select and remove are selectors by which the tree is cut out of the html. otherwise are the
    options of a second try on the html where the first finds nothing.
    """

    def run(html: pd.Series, base: pd.Series, title: pd.Series, noise: pd.Series, main: pd.Series, drop: pd.Series, nodes: pd.Series, select: pd.Series, remove: pd.Series) -> pd.DataFrame:
        from .dom import captured_tree

        text = lambda x: x if isinstance(x, str) else None
        words = lambda x: tuple(x) if x is not None and len(x) else None
        rows = []
        for h, b, t, n, m, d, tree, s, r in zip(html, base, title, noise, main, drop, nodes, select, remove):
            h, b, t = text(h), text(b), text(t)
            n, m, d = words(n), words(m), words(d)
            own = options.with_words(n, m, d) if n or m or d else options
            given = tree if tree is not None and len(tree) else captured_tree(h, b, t, words(s) or (), words(r) or ()) if words(s) or words(r) else None
            got = recompose(h, b, t, own, given if given is not None and len(given) else None)
            if otherwise is not None and "text" not in got and h:
                got = recompose(h, b, t, otherwise.with_words(n, m, d) if n or m or d else otherwise)
            rows.append(got)
        return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], index=html.index, dtype=object) for f in _FIELDS})

    run.__annotations__ = {k: pd.Series for k in ("html", "base", "title", "noise", "main", "drop", "nodes", "select", "remove")} | {"return": pd.DataFrame}
    words = lambda c: F.lit(None).cast("array<string>") if c is None else c
    tree = F.lit(None).cast(f"array<{NODE}>") if nodes is None else nodes
    return pandas_udf(run, CONTENT).asNondeterministic()(html, base, F.lit(None).cast("string") if title is None else title, words(noise), words(main), words(drop), tree, words(select), words(remove))
