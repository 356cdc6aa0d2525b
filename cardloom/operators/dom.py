"""Trees of rendered pages with selectors, and whole render documents.

Works on the flat tree of the reader. A rendered page's tree is cut down to the best of the boxes that the main selectors
name, or to the box around the title, without what the remove selectors name, within a limit of nodes and depth.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .reader import NODE, Tree, parse, plain, title_parts

# Limits of a captured tree, scores and lengths that a title needs.
MAX_NODES, MAX_DEPTH, TITLE_LENGTH, TITLE_SCORE = 6_000, 26, 180, 0.72
_SIMPLE = re.compile(r"^(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:[#.][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@lru_cache(maxsize=1024)
def compile_selector(selector: str) -> tuple[tuple[str, str, tuple], ...] | None:
    """A selector of compounds with descendant and child combinators; None for one that can't be read."""
    out, link = [], " "
    for word in selector.replace(">", " > ").split():
        if word == ">":
            link = ">"
            continue
        m = _SIMPLE.match(word)
        if not m or not word:
            return None
        tests = tuple((p[1] or "[", p[2] or p[3], p[4], p[5]) for p in _PART.finditer(m["rest"]))
        out.append((link, (m["tag"] or "*").lower(), tests))
        link = " "
    return tuple(out) or None


def _fits(tree: Tree, i: int, tag: str, tests: tuple) -> bool:
    if not tree.tag[i] or tag not in ("*", tree.tag[i]):
        return False
    attrs = tree.attrs[i]
    for kind, name, op, value in tests:
        if kind == "#":
            ok = attrs.get("id") == name
        elif kind == ".":
            ok = name in (attrs.get("class") or "").split()
        else:
            have = attrs.get(name)
            ok = name in attrs if op is None else have is not None and {"=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have, "|=": have == value or have.startswith(value + "-")}[op]
        if not ok:
            return False
    return True


def matches(tree: Tree, i: int, selector: str) -> bool:
    """Whether a node matches any of a list of selectors; those that can't be read match nothing."""
    return any(_matches(tree, i, s) for part in selector.split(",") if (s := compile_selector(part.strip())))


def _matches(tree: Tree, i: int, steps: tuple) -> bool:
    link, tag, tests = steps[-1]
    if not _fits(tree, i, tag, tests):
        return False
    if len(steps) == 1:
        return True
    up = tree.parent[i]
    while up >= 0:
        if _matches(tree, up, steps[:-1]):
            return True
        if link == ">":
            return False
        up = tree.parent[up]
    return False


def title_match(text: str, parts: list[str]) -> float:
    """1 where a text is a part of the title, 0.85 where one holds the other, else the share of the part's words it has."""
    flat = plain(text)
    best = 0.0
    for p in parts if flat else ():
        tokens = [t for t in p.split() if len(t) >= 2]
        best = max(best, 1.0 if p == flat else 0.85 if p in flat or flat in p else sum(t in flat for t in tokens) / len(tokens) if tokens else 0.0)
    return best


def captured_tree(html: str | None, base: str | None, title: str | None = None, main: tuple[str, ...] = (), remove: tuple[str, ...] = (), max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> list[dict]:
    """The nodes of a rendered page below its root, in document order, renumbered."""
    if not html:
        return []
    try:
        body = re.search(r"<body[^>]*>([\s\S]*?)</body>", html, re.I)
        tree = parse(body[1] if body else html, base or "")
    except (ValueError, OverflowError):
        return []
    n = len(tree.tag)
    roots = [i for i in range(n) if tree.tag[i] and any(matches(tree, i, s) for s in main)]
    rate = lambda i: (tree.stat(i)[0] + 2 * (tree.stat(i)[3] - 1), -i)
    span = (0, n)
    if roots:
        best = max(roots, key=rate)
        span = (best, tree.end[best])
    elif title:
        parts = title_parts(title, 2)
        found = [(title_match(t, parts), -len(t), -i) for i in range(n) if tree.tag[i] and 0 < tree.stat(i)[0] <= TITLE_LENGTH and (t := tree.below(i, TITLE_LENGTH + 1))]
        score, _, at = max(found, default=(0.0, 0, 0))
        if score >= TITLE_SCORE:
            i = -at
            while tree.parent[i] >= 0:
                i = tree.parent[i]
            span = (i, tree.end[i])
    out: list[dict] = []
    number: dict[int, int] = {}
    i, stop = span
    while i < stop and len(out) < max_nodes:
        depth = tree.depth[i] - tree.depth[span[0]]
        if depth > max_depth or tree.tag[i] and any(matches(tree, i, s) for s in remove):
            i = tree.end[i]
            continue
        number[i] = len(out)
        out.append({"idx": len(out), "parent": number.get(tree.parent[i], -1), "depth": depth, "subtree_end": len(out) + 1, "kind": "element" if tree.tag[i] else "text", "tag": tree.tag[i] or None, "attrs": tree.attrs[i] or None, "text": tree.text[i] or None})
        i += 1
    for node in reversed(out):
        if node["parent"] >= 0:
            above = out[node["parent"]]
            above["subtree_end"] = max(above["subtree_end"], node["subtree_end"])
    return out


def dom_tree(html: Column | str, base: Column | str, title: Column | str | None = None, main: tuple[str, ...] = (), remove: tuple[str, ...] = ()) -> Column:
    def run(html: pd.Series, base: pd.Series, title: pd.Series) -> pd.Series:
        text = lambda x: x if isinstance(x, str) else None
        return pd.Series([captured_tree(text(h), text(b), text(t), main, remove) for h, b, t in zip(html, base, title)], index=html.index, dtype=object)

    run.__annotations__ = {"html": pd.Series, "base": pd.Series, "title": pd.Series, "return": pd.Series}
    return pandas_udf(run, f"array<{NODE}>").asNondeterministic()(html, base, F.lit(None).cast("string") if title is None else title)


def render_document(title: Column, html: Column) -> Column:
    """A whole page around semantic html."""
    from ..functions.columns import escape_html, trimmed

    head = F.coalesce(trimmed(title), F.lit("Preview Document"))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8" /><meta name="viewport" content="width=device-width, initial-scale=1" /><title>'), escape_html(head), F.lit('</title><link rel="stylesheet" href="./preview.css" /></head><body><main class="preview-root">'), html, F.lit("</main></body></html>"))
