"""The main body of a page: which of its text blocks belong to it.

Blocks are flat: text, word count, share of its characters inside links, the box it stands in, and the same of its
neighbours, of its box and of the boxes before and after. A decision tree decides main or not. It is fitted on a bounded
table of blocks of pages whose markup names its boxes (article, nav, aside, footer, classes such as story-content): the
box of the headline gives the label. The names are hidden in half of these rows, so that the tree also judges pages whose
markup says nothing.
"""

from __future__ import annotations

import heapq
import html as html_lib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import bounded_sample, table
from .trees import Tree, fit_tree

#: Pages whose blocks the tree is fitted on, and its depth.
LABELLED_PAGES, DEPTH = 1500, 11

_MARKUP = re.compile(r"(<!--.*?-->|</?[a-zA-Z][^>]*>)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption".split())
_INLINE = frozenset("a b i em strong span small u s code sub sup mark abbr time font q cite label".split())
_PLAIN = frozenset("ul ol dl table tbody thead tfoot tr figure".split())
_HIDDEN = frozenset("script style noscript template head title".split())
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_MAIN_HINT = re.compile(r"\b(?:article|main|story|content|post|entry|body)\b", re.I)
_NOISE_HINT = re.compile(r"nav|menu|footer|aside|sidebar|related|promo|consent|cookie|banner|share|social|advert|newsletter|breadcrumb|header|comment|subscribe", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
#: Beyond ASCII, and outside the letters and signs of Latin, Korean and Japanese, which hold no digits.
_FAR = re.compile(r"[^\x00-\x7FÀ-ɏ‐-‿぀-ヿ㐀-鿿가-힣]+")
_END = re.compile(r"[.!?。！？…”»\"']\s*$")
_TAGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 3, "p": 4, "li": 5, "td": 6, "th": 6}


@lru_cache(maxsize=20_000)
def _tag(markup: str) -> tuple[str, str, str] | None:
    """What a tag does, its name, and the name of the box it opens; None for a comment."""
    m = _TAG.match(markup)
    if m is None:
        return None
    close, name, rest = m[1], m[2].lower(), m[3]
    if name in _HIDDEN:
        return ("show" if close else "hide"), name, ""
    if name in _INLINE:
        return ("inline end" if close else "inline"), name, ""
    if name in _VOID or rest.endswith("/"):
        return "void", name, ""
    if close:
        return "end", name, ""
    named = " ".join(_CLASS.findall(rest))
    if name in _LEAF:  # a paragraph with a class may hold others
        return "leaf", name, named if name == "p" else ""
    return "box", name, "" if name in _PLAIN else f"{name} {named}".strip()


def leaves(html: str | None) -> list[tuple[str, str, int, int, str]]:
    """Text leaves of a page in order: (tag, text, characters inside links, box number, box name)."""
    out: list[tuple[str, str, int, int, str]] = []
    stack: list[tuple[str, int, str]] = []
    parts: list[str] = []
    boxes = linked = hidden = links = 0
    tag = ""
    markup = True

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            box = (0, "")
            for _, n, name in reversed(stack):
                if n:
                    box = (n, name)
                    break
            out.append((tag or "div", text, linked, *box))

    for token in _MARKUP.split(html or ""):
        markup = not markup
        if not markup:
            # Space alone adds nothing before the first text of a leaf; a "<" that begins no tag is dropped.
            if hidden or not token or not parts and token.isspace():
                continue
            for part in token.split("<") if "<" in token else (token,):
                parts.append(part)
                if links:
                    linked += len(part.strip())
            continue
        got = _tag(token)
        if got is None:
            continue
        what, name, label = got
        if what == "inline":
            stack.append((name, 0, ""))
            links += name == "a"
            continue
        if what == "inline end":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i]
                    links -= name == "a"
                    break
            continue
        if what == "hide" or what == "show":
            hidden = max(0, hidden + (1 if what == "hide" else -1))
            continue
        if parts:
            flush()
            parts.clear()
            linked = 0
        if what == "void":
            continue
        if what == "end":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    if links:
                        links = sum(t == "a" for t, _, _ in stack)
                    break
            tag = ""
            for t, _, _ in reversed(stack):
                if t in _LEAF:
                    tag = t
                    break
            continue
        if what == "leaf":
            tag = name
        number = 0
        if label:
            boxes += 1
            number = boxes
        stack.append((name, number, label))
    if parts:
        flush()
    return out


def words(text: str) -> float:
    """Words of a text; two East Asian characters count as one."""
    if text.isascii():
        return len(text.split())
    bare, east = _CJK.subn(" ", text)
    return len(bare.split()) + east / 2


def digits(text: str) -> int:
    """Characters of a text that are digits, of any script and superscripts too."""
    n = sum(map(text.count, "0123456789"))
    return n if text.isascii() else n + sum(map(str.isdigit, "".join(_FAR.findall(text))))


@lru_cache(maxsize=10_000)
def hints(name: str) -> tuple[float, float]:
    """Whether the name of a box speaks of main content, and of other things."""
    noise = _NOISE_HINT.search(name) is not None
    return float(_MAIN_HINT.search(name) is not None and not noise), float(noise)


def align(texts: list[str], found: list[tuple]) -> list[int]:
    """For each block text the number of its leaf, or -1: the next leaf of the same text, else the next of which one begins the other.

    Leaves are looked up by their text and by how it begins, so that a page of many blocks costs no more per block.
    """
    norm = [t[1] for t in found]
    same: dict[str, list[int]] = {}
    alike: dict[str, list[int]] = {}
    short: list[int] = []
    after = lambda js, at: js[i] if js and (i := bisect_left(js, at)) < len(js) else None
    out, at = [], 0
    for text in texts:
        want = " ".join((text or "").split())
        if at < len(norm) and norm[at] == want:  # as next to always
            out.append(at)
            at += 1
            continue
        if not same:
            for j, t in enumerate(norm):
                same.setdefault(t, []).append(j)
                alike.setdefault(t[:_BEGINS], []).append(j)
            short = [j for j, t in enumerate(norm) if len(t) < _BEGINS]
        hit = after(same.get(want), at)
        if hit is None and want:
            if len(want) < _BEGINS:
                near = range(at, len(norm))
            else:
                near = heapq.merge(*([j for j in js[bisect_left(js, at) :]] for js in (alike.get(want[:_BEGINS], []), short)))
            hit = next((j for j in near if norm[j].startswith(want) or want.startswith(norm[j])), None)
        if hit is None:
            out.append(-1)
        else:
            out.append(hit)
            at = hit + 1
    return out


_BEGINS = 12
NAMES = ["words", "link", "tag", "ends", "signs", "digits", "before_words", "before_link", "after_words", "after_link", "box_from_head", "has_head", "in_head_box", "box_blocks", "box_words", "box_mean", "box_link", "box_most", "box_heads", "box_items",
         "last_words", "last_link", "last_mean", "next_words", "next_link", "next_mean", "boxes_before", "boxes_after", "at", "left", "lost", "head_gap", "run_words", "second_words", "second_mean", "second_head", "second_link", "third_words", "third_head", "main_hint", "noise_hint"]
HINTS = 2


def block_lists(texts: list[str], html: str | None) -> list[list[float]]:
    """A row of numbers per text block, in the order of NAMES."""
    if not texts:
        return []
    found = leaves(html)
    place = align(texts, found)
    n = len(texts)
    w = [words(t or "") for t in texts]
    link = [found[p][2] / max(1, len(found[p][1])) if p >= 0 else 0.0 for p in place]
    tag = [_TAGS.get(found[p][0], 0) if p >= 0 else 0 for p in place]
    box, last = [], 0
    for p in place:
        last = found[p][3] if p >= 0 else last
        box.append(last)
    inside: dict[int, list[int]] = {}
    for i, b in enumerate(box):
        inside.setdefault(b, []).append(i)
    order = list(inside)
    stat = []
    for rows in inside.values():
        total = sum([w[i] for i in rows])
        stat.append((len(rows), total, total / len(rows), sum([link[i] * w[i] for i in rows]) / max(total, 1), max([w[i] for i in rows]), sum([tag[i] in (2, 3) for i in rows]), sum([tag[i] in (5, 6) for i in rows]) / len(rows)))
    head = next((i for i in range(n) if tag[i] == 1), None)
    headed = order.index(box[head]) if head is not None else -9
    none = (0.0, 0.0, 0.0)
    out: list[list[float]] = [[]] * n
    for k, rows in enumerate(inside.values()):
        s = stat[k]
        before, after = (stat[j] if 0 <= j < len(order) else None for j in (k - 1, k + 1))
        second, third = (stat[j] if j >= 0 else (0, 0.0, 0.0, 0.0) for j in (k - 2, k - 3))
        distance = k - headed if head is not None else 0
        between = stat[headed + 1 : k] if head is not None and distance > 0 else []
        # What all blocks of a box have in common.
        own = [max(-6, min(6, distance)), float(head is not None), float(k == headed), *s, *((before[1], before[3], before[2]) if before else none), *((after[1], after[3], after[2]) if after else none), min(k, 8), min(len(order) - 1 - k, 8)]
        gap = [len(between), max([x[2] for x in between], default=0.0), second[1], second[2], float(headed == k - 2), second[3], third[1], float(headed == k - 3)]
        for i in rows:
            text = texts[i] or ""
            out[i] = [
                w[i], link[i], tag[i], float(_END.search(text) is not None), text.count("·") + text.count("|"), digits(text),
                w[i - 1] if i else -1, link[i - 1] if i else -1, w[i + 1] if i + 1 < n else -1, link[i + 1] if i + 1 < n else -1,
                *own, i / n, (n - 1 - i) / n, float(place[i] < 0), *gap, *hints(found[place[i]][4] if place[i] >= 0 else ""),
            ]
    return out


def block_rows(texts: list[str], html: str | None) -> np.ndarray:
    """The same as an array."""
    return np.array(block_lists(texts, html), dtype=float) if texts else np.zeros((0, len(NAMES)))


def labels(texts: list[str], html: str | None) -> list[int] | None:
    """1 for main by the names of the boxes, on a page that names them; None for a page that doesn't."""
    found = leaves(html)
    names = {f[4] for f in found}
    if not any(_NOISE_HINT.search(x) for x in names) or not any(_MAIN_HINT.search(x) and not _NOISE_HINT.search(x) for x in names):
        return None
    return [-1 if p < 0 else int(bool(_MAIN_HINT.search(found[p][4])) and not _NOISE_HINT.search(found[p][4])) for p in align(texts, found)]


def fit(pages: list[tuple[list[str], str]], seed: int = 3) -> Tree:
    """The tree from labelled pages; every page gives its rows with the names of its boxes and once without."""
    xs, ys = [], []
    for texts, html in pages:
        label = labels(texts, html)
        if label is None:
            continue
        rows, y = block_rows(texts, html), np.array(label)
        keep = y >= 0
        bare = rows.copy()
        bare[:, -HINTS:] = 0
        xs += [rows[keep], bare[keep]]
        ys += [y[keep], y[keep]]
    if not xs:
        return Tree([-1], [0.0], [-1], [-1], [1.0])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    # With gradients 1 - 2y and unit hessians a leaf is the mean of 2y - 1: the majority decides by its sign.
    return fit_tree(x, 1 - 2 * y, np.ones(len(y)), DEPTH, 3.0, ridge=0.1)


def text_blocks(blocks) -> list[tuple[int, str]]:
    return [(i, b["text"] or "") for i, b in enumerate(blocks) if b is not None and b["type"] == "text"] if blocks is not None else []


def block_texts() -> Column:
    """The texts of a page's text blocks: with their places all that the tree needs, and light to hand over."""
    return F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))


def block_places() -> Column:
    """The places of the text blocks among all blocks."""
    return F.filter(F.transform("blocks", lambda b, i: F.when(b["type"] == "text", i)), lambda i: i.isNotNull())


def judge(tree: Tree, texts: list[str], html: str | None) -> list[bool]:
    """Whether each text block is main."""
    return [tree.value_of(row) >= 0 for row in block_lists(texts, html)] if len(texts) else []


def labelled_pages(renders: DataFrame, most: int = LABELLED_PAGES) -> list[tuple[list[str], str]]:
    """A bounded sample of pages for the tree, the same for the same rows wherever they lie."""
    rows = renders.where(F.col("html").rlike("<(?:article|nav|aside|footer)[ >]|class=\"[a-z]+-[a-z]+")).select("render_id", "blocks", "html")
    return [([t for _, t in text_blocks(r["blocks"])], r["html"]) for r in bounded_sample(rows, most, rows.count(), "render_id", "html")]


def fitted_tree(renders: DataFrame):
    """The tree, sent to every task; a few thousand nodes at most whatever the input."""
    return renders.sparkSession.sparkContext.broadcast(fit(labelled_pages(renders)))


def boilerplate_blocks(renders: DataFrame) -> DataFrame:
    """(render_id, block_no) of the text blocks outside the main body, numbered from 0 with media blocks counted.

    Pages with null or empty blocks have none; without html the texts alone decide. Rows with a null id are dropped,
    repeated rows count once, extra columns don't matter.
    """
    tree = fitted_tree(renders)

    def run(texts: pd.Series, places: pd.Series, html: pd.Series) -> pd.Series:
        out = []
        for t, p, h in zip(texts, places, html):
            out.append([int(i) for i, main in zip(p, judge(tree.value, list(t), h if isinstance(h, str) else None)) if not main])
        return pd.Series(out, index=texts.index, dtype=object)

    run.__annotations__ = {"texts": pd.Series, "places": pd.Series, "html": pd.Series, "return": pd.Series}
    rows = renders.where(F.col("render_id").isNotNull() & (F.size("blocks") > 0))
    return rows.select("render_id", F.explode(pandas_udf(run, "array<int>").asNondeterministic()(block_texts(), block_places(), "html")).alias("block_no")).distinct()


BLOCK = "struct<type:string,text:string,src:string,alt:string,poster:string,title:string>"


def main_bodies(renders: DataFrame) -> DataFrame:
    """(render_id, html, text, blocks) with only the main body of each page; media stay where the blocks around them do."""
    tree = fitted_tree(renders)

    def run(blocks: pd.Series, html: pd.Series) -> pd.Series:
        out = []
        for b, h in zip(blocks, html):
            if b is None:
                out.append(None)
                continue
            numbered = text_blocks(b)
            keep = {i: m for (i, _), m in zip(numbered, judge(tree.value, [t for _, t in numbered], h if isinstance(h, str) else None))}
            kept, last = [], next(iter(keep.values()), True)
            for i, x in enumerate(b):
                last = keep.get(i, last)
                if x is not None and last:
                    kept.append(dict(x))
            out.append(kept)
        return pd.Series(out, index=blocks.index, dtype=object)

    run.__annotations__ = {"blocks": pd.Series, "html": pd.Series, "return": pd.Series}
    rows = renders.where(F.col("render_id").isNotNull()).select("render_id", pandas_udf(run, f"array<{BLOCK}>").asNondeterministic()("blocks", "html").alias("blocks"))
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    shown = F.transform("blocks", lambda b: F.when(b["type"] == "text", F.concat(F.lit("<p>"), safe(b["text"]), F.lit("</p>"))).when(b["type"] == "image", F.concat(F.lit('<img src="'), safe(b["src"]), F.lit('">'))).otherwise(F.concat(F.lit("<"), b["type"], F.lit(' src="'), safe(b["src"]), F.lit('"></'), b["type"], F.lit(">"))))
    return rows.select("render_id", F.array_join(shown, "\n").alias("html"), F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n").alias("text"), "blocks").dropDuplicates(["render_id"])


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Text blocks outside the main body."""
    return boilerplate_blocks(table(spark, sf_dir, "render_results"))


def p3_main_bodies(spark, sf_dir: str) -> DataFrame:
    """Every page with only its main body."""
    return main_bodies(table(spark, sf_dir, "render_results"))
