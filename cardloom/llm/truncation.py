"""Values cut at a fixed length or in transfer, and how often each source cuts.

Intact values are cut artificially, at limits, at the ends of lines and sentences, and anywhere, which gives positives
and negatives of known kind; a logistic regression over hashed features of how a value closes, its punctuation, its
length and the lengths at which its field piles up, and of what is known of a longer form of it, is fitted on them and
scores every record: the model alone decides. Marks put after the cut are taken off first. What stops at the end of a
sentence, or of a line of its page, is not cut for this purpose, and the artificial cuts are labelled so.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..operators.joins import left_join
from .common import arrow, bounded_sample, materialise, table
from .encoding import CHANNELS
from .notices import Notices, shown
from .residue import SLOT

#: Intact values of each field that the model is fitted on, the size of its feature space, and the passes over them.
INTACT, DIM, EPOCHS = 4000, 1 << 14, 12
#: How often each notice stands among the intact values.
COMPLETE = 4
#: A length is a pile if it has so many values, and so many times as many as the lengths beside it on average.
PILE_LEAST, PILE = 3, 1.5
LIMITS = (80, 100, 120, 140, 150, 155, 160, 180, 200, 240, 250, 255, 256, 280, 300, 320, 500, 512, 700, 800, 1000, 1024, 1500, 2000, 2048, 4096)
_MORE = r"read more|continue reading|more|weiterlesen|mehr lesen|mehr|lire la suite|lire plus|suite|leer más|seguir leyendo|ler mais|continuar a ler|続きを読む|もっと見る|더 보기|계속 읽기"
_MARK = re.compile(rf"\s*(?:(?:…|\.\.\.+|\[\s?(?:…|\.\.\.)\s?\]|\(\s?(?:…|\.\.\.)\s?\)|&hellip;)\s*(?:{_MORE})?|[»→›]\s*(?:{_MORE}))\s*[»→›]?\s*$", re.I)
#: What a rendering leaves behind a value; it says nothing about the value's end.
_TAIL = re.compile(r"\s*(?:\((?:NaN|undefined|null)(?: \w+)?\)|[|–-] (?:undefined|null|NaN))\s*$|�+$")
_SLOT_TAIL = re.compile(rf"\s*(?:[|–:-]\s*)?(?:{SLOT.pattern})\s*$")


def _garbled_stops() -> list[str]:
    """What the stops of Chinese and Japanese look like through the wrong encodings."""
    out = set()
    for garble in CHANNELS.values():
        for c in "。！？":
            try:
                seen = garble(c)
            except UnicodeError:
                continue
            if len(seen) > 1 and not seen.isascii() and seen.strip():
                out.add(seen)
    for codec in ("cp932", "euc_jp", "cp949"):  # read as UTF-8, with lost bytes shown
        out |= {seen for c in "。！？" if len(seen := c.encode(codec).decode("utf-8", "replace")) > 1 and seen.strip("\ufffd")}
    return sorted(out, key=lambda x: (-len(x), x))


_END = re.compile(r"(?:[.!?。！？]|" + "|".join(map(re.escape, _garbled_stops())) + r")[)\]”’\"'»›“」』\x9d]*(?:€\x9d|\x80\x9d)?[.]?$")
_TERMINATOR = re.compile(r"[.!?](?=\s)|[。！？]")
_WORD = re.compile(r"[^\W_]+")
_INLINE_TAG = re.compile(r"(?i)<!--.*?-->|</?(?:a|abbr|b|bdi|cite|code|em|i|kbd|mark|q|s|small|span|strong|sub|sup|time|u)\b[^>]*>", re.S)
_BLOCK_TAG = re.compile(r"<[^>]*>?")
#: A last line shorter than this is looked for in no other form of its page: others begin like it by chance.
LEAST_BYTES = 24
_OPEN = {"(": ")", "[": "]", "“": "”", "„": "“", "«": "»", "「": "」"}


def kept(text: str) -> tuple[str, bool]:
    """A value without a mark put after a cut, and whether it had one."""
    text = text.rstrip()
    if m := _MARK.search(text):
        return text[: m.start()].rstrip(), True
    return text, False


def ends_whole(part: str) -> bool:
    """Whether a kept part stops at the end of a sentence."""
    return _END.search(part.rstrip()) is not None


def stop(text: str, lines: list[str] | None) -> str:
    """Where a value stops on its page: 'inside' a line, at the end of an inner 'line', at the 'end' of all lines, or 'unknown'."""
    part = kept(text)[0]
    rest, lines = " ".join(part.split()), [x for line in lines or () if (x := " ".join((line or "").split()))]
    for at, line in enumerate(lines):
        if rest == line:
            return "end" if at == len(lines) - 1 else "line"
        if not rest.startswith(line + " "):
            return "inside" if line.startswith(rest) else "unknown"
        rest = rest[len(line) + 1 :]
    return "unknown"


@lru_cache(maxsize=1)
def _notices() -> Notices:
    return Notices()


def hashed(text: str, field: str, pile: float, full: str | None = None, lines: list[str] | None = None, broken: bool = False, more: bool = False) -> list[int]:
    """Feature numbers of a value.

    full is the longer form that is known, lines are those of its page, broken is whether its html breaks off within
    text, more whether another form of the page goes on where it stops.
    """
    part, mark = kept(text)
    part = _SLOT_TAIL.sub("", _TAIL.sub("", part))
    words = _WORD.findall(part)
    last = words[-1] if words else ""
    n = len(part)
    sentences = len(_TERMINATOR.findall(part))
    whole, longer, where = ends_whole(part), relation(text, full), stop(text, lines)
    # The row's own blocks stop with its text where a capture broke off, so they tell nothing then.
    known = "more" if more else "unknown" if broken and longer == 0 else str(longer)
    notice = field == "cards" and len(part) < 160 and _notices().score(part) > 0
    named = [
        f"end:{part[-1:]}", f"end3:{part[-3:].lower()}", f"kind:{_kind(part[-1:])}{_kind(part[-2:-1])}", f"word:{last.lower()}", f"size:{min(len(last), 6)}", f"whole:{whole}", f"mark:{mark}", f"many:{min(sentences, 3)}",
        f"whole:{whole}:many:{min(sentences, 2)}", f"long:{min(int(math.log2(n + 1) * 2), 24)}", f"limit:{len(text) in LIMITS or n in LIMITS}", f"pile:{int(min(pile, 12))}", f"open:{any(part.count(a) > part.count(b) for a, b in _OPEN.items())}",
        f"longer:{known}", f"longer:{known}:whole:{whole}", f"longer:{known}:mark:{mark}", f"stop:{where}", f"stop:{where}:longer:{known}", f"broken:{broken}", f"broken:{broken}:whole:{whole}", f"comma:{part[-1:] in ',;:、，'}", f"few:{min(len(words), 8)}:{sentences > 0}", f"notice:{notice}", "bias",
    ]
    return [xxhash.xxh32_intdigest(f"{field}|{f}") % DIM for f in named]


def _kind(ch: str) -> str:
    return "-" if not ch else "d" if ch.isdigit() else "u" if ch.isupper() else "l" if ch.isalpha() else "s" if ch.isspace() else "p"


def cuts(text: str, rng: np.random.Generator) -> list[str]:
    """A value cut at a limit it passes, and anywhere; sometimes with a mark."""
    out = []
    over = [x for x in LIMITS if x < len(text)]
    spots = ([int(over[int(rng.integers(len(over)))])] if over else []) + ([int(rng.integers(len(text) // 3, len(text)))] if len(text) > 6 else [])
    for spot in spots:
        part = text[:spot]
        if ends_whole(part.rstrip()) or not part.strip():
            continue
        draw = rng.random()
        out.append(part.rstrip() + ("…" if draw < 0.15 else "..." if draw < 0.22 else " [...]" if draw < 0.3 else ""))
    return out


def clean_stops(text: str, rng: np.random.Generator) -> list[str]:
    """A value stopped at the end of an inner sentence, sometimes with a mark: cut, but not for this purpose."""
    ends = [m.end() for m in _TERMINATOR.finditer(text) if m.end() < len(text.rstrip())]
    return [text[: ends[int(rng.integers(len(ends)))]] + ("…" if rng.random() < 0.2 else "")] if ends else []


def _up_to(lines: list[str] | None, text: str) -> list[str]:
    """The lines of a page as far as a text goes."""
    out, rest = [], len(" ".join(text.split()))
    for line in lines or ():
        flat = " ".join((line or "").split())
        if rest <= 0:
            break
        out.append(flat[:rest])
        rest -= len(flat) + 1
    return out


def fit(intact: dict[str, list[tuple[str, bool, list[str] | None]]], piles: dict[tuple[str, int], float], seed: int = 5, complete: dict[str, list[str]] | None = None) -> np.ndarray:
    """Weights from intact values by field, each with whether its longer form would be known and its lines; complete ones are not cut."""
    rng = np.random.default_rng(seed)
    rows, ys = [], []

    def add(label: float, *args) -> None:
        rows.append(hashed(*args))
        ys.append(label)

    for field, texts in (complete or {}).items():
        for text in texts:
            for _ in range(COMPLETE):
                add(0.0, text.replace("0", str(rng.integers(100, 600))), field, piles.get((field, len(text)), 0.0))
    for field, values in sorted(intact.items()):
        for text, known, lines in values:
            full = " ".join(text.split()) if known else None
            pile = piles.get((field, len(text)), 0.0)
            add(0.0, text, field, pile, full if rng.random() < 0.6 else None, lines)
            parts = cuts(text, rng)
            inner = [x for x in (lines or ())[:-1] if x and x.strip()]
            if inner and rng.random() < 0.5:  # a stop at the end of a line
                n = int(rng.integers(len(inner))) + 1
                joined = ("\n" if "\n" in text else " ").join((lines or ())[:n])
                if not ends_whole(joined):
                    add(0.0, joined, field, 0.0, full, lines)
            for part in clean_stops(text, rng):
                add(0.0, part, field, piles.get((field, len(part)), 0.0), full if rng.random() < 0.8 else None, lines)
            for part in parts:
                if stop(part, lines) == "line":
                    continue
                pile = float(rng.integers(2, 9)) if len(part) in LIMITS else piles.get((field, len(part)), 0.0)
                add(1.0, part, field, pile, full if rng.random() < 0.8 else None, lines)
                if field == "render_results":  # the same cut in transfer: html and blocks end there too
                    own = _up_to(lines, part) or None
                    flat = " ".join(kept(part)[0].split())
                    add(1.0, part, field, 0.0, flat, own, True, bool(rng.random() < 0.2))
                    add(1.0, part, field, 0.0, flat, own, False, True)
    weights = np.zeros(DIM)
    if not rows:
        return weights
    x, y = np.array(rows), np.array(ys)
    grad = np.full(DIM, 1e-6)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            q = 1 / (1 + np.exp(-np.clip(weights[x[part]].sum(axis=1), -30, 30)))
            g = np.bincount(x[part].ravel(), np.repeat(q - y[part], x.shape[1]), DIM) / len(part) + 1e-6 * weights
            grad += g * g
            weights -= 0.3 * g / np.sqrt(grad)
    return weights


def score(weights: np.ndarray, text: str, field: str, pile: float, full: str | None = None, lines: list[str] | None = None, broken: bool = False, more: bool = False) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[hashed(text, field, pile, full, lines, broken, more)].sum(), -30, 30))))


def relation(text: str | None, full: str | None) -> int:
    """1 where a value is a proper beginning of a longer form, 0 where that form is no longer, -1 where none fits."""
    if not text or not full:
        return -1
    part = re.sub(r"�+$", "", _TAIL.sub("", kept(text)[0]))
    a, b = " ".join(part.split()), " ".join(full.split())
    if not a or not b.startswith(a):
        return -1
    if " ".join(text.split()) == b:  # lost characters at the end of both are no cut
        return 0
    return int(len(a) < len(b))


def page_lines(html: str) -> list[str]:
    """Lines of a page's html: what stands between tags that are not inline, without comments."""
    return [x for part in _BLOCK_TAG.split(_INLINE_TAG.sub("", html)) if (x := " ".join(unescape(part).split()))]


def continued(last: str, lines: list[str]) -> bool:
    """Whether a line of another form of the page goes on where the last line of a value stops."""
    part = re.sub(r"�+$", "", _TAIL.sub("", kept(" ".join(last.split()))[0]))
    return len(part.encode()) >= LEAST_BYTES and any(len(x.rstrip("�")) > len(part) and x.startswith(part) for x in lines)


def _texts(blocks: str = "blocks"):
    return F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])


def _continued(renders: DataFrame, pages: DataFrame) -> DataFrame:
    """(row_id, more) of the renders whose last block goes on in the page's html or in another capture of the page."""
    ends = renders.where(F.col("render_id").isNotNull() & F.col("page_id").isNotNull() & ~F.col("text").rlike(r"[.!?。！？]\s*$")).select("page_id", F.col("render_id").alias("row_id"), F.get(F.reverse(F.filter(_texts(), lambda t: F.trim(t) != "")), F.lit(0)).alias("last"))
    ends = ends.where(F.octet_length("last") >= LEAST_BYTES).distinct()
    html = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select("page_id", "html", F.lit(None).cast("array<string>").alias("lines"))
    captures = renders.where(F.col("page_id").isNotNull()).select("page_id", F.lit(None).cast("string").alias("html"), _texts().alias("lines"))
    more = arrow(lambda last, html, lines: continued(last, page_lines(html) if html is not None else [" ".join((x or "").split()) for x in lines] if lines is not None else []), "boolean", "last", "html", "lines")
    return ends.join(html.unionByName(captures), "page_id").select("row_id", more.alias("more")).where("more").distinct()


def _values(cards: DataFrame, renders: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_table, row_id, page_id, text, full, lines, broken, more): full is the longer form that is known, lines the blocks of a render, broken whether its html breaks off within text, more whether another form of the page goes on there."""
    meta = F.regexp_extract("html", '(?i)<meta\\s+name="description"\\s+content="([^"]*)"', 1)
    plain = F.replace(F.replace(F.replace(F.replace(meta, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    known = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select("page_id", plain.alias("full")).where(F.col("full") != "").groupBy("page_id").agg(F.max("full").alias("full"))
    own = cards.where(F.col("card_id").isNotNull() & (F.trim("description") != "")).select("card_id", "page_id", "description")
    left = left_join(own, known, "page_id", "card_id").select(F.lit("cards").alias("source_table"), F.col("card_id").alias("row_id"), "page_id", F.col("description").alias("text"), "full", F.lit(None).cast("array<string>").alias("lines"), F.lit(False).alias("broken"), F.lit(False).alias("more"))
    tail = F.substring("html", -400, 400)
    # A tag that breaks off ends the line before it if it is a closing one.
    broken = F.coalesce(~tail.rlike(r">\s*(<[^<>]*)?$") & ~tail.rlike(r"<(/[^<>]*)?$") & (F.trim(tail) != ""), F.lit(False))
    right = renders.where(F.col("render_id").isNotNull() & (F.trim("text") != "")).select(
        F.lit("render_results").alias("source_table"), F.col("render_id").alias("row_id"), "page_id", "text", F.array_join(_texts(), " ").alias("full"), _texts().alias("lines"), broken.alias("broken"))
    right = right.join(materialise(_continued(renders, pages)), "row_id", "left").withColumn("more", F.coalesce("more", F.lit(False))).select(left.columns)
    return left.unionByName(right)


def truncated_values(cards: DataFrame, renders: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_table, row_id, page_id, cut) of every description and render text; cut is null-free.

    Null and empty values are not scored, null ids are dropped, repeated rows may repeat, extra columns don't matter.
    Values are read whole. The truncated flag is not read.
    """
    values = materialise(_values(cards, renders, pages))
    piles = {(r[0], r[1]): r[2] for r in length_piles(values).toLocalIterator()}
    whole = values.where((F.translate("text", "\n", " ") == F.translate("full", "\n", " ")) & ~F.col("broken") & ~F.col("more")).select("source_table", "text", F.lit(True).alias("known"), "lines")
    # Titles close without a full stop and are complete: so may a description.
    titles = cards.where(F.length("title") > 3).select(F.lit("cards").alias("source_table"), F.col("title").alias("text"), F.lit(False).alias("known"), F.lit(None).cast("array<string>").alias("lines"))
    sample = whole.unionByName(titles)
    total = {r[0]: r[1] for r in values.groupBy("source_table").count().collect()}
    parts = [bounded_sample(sample.where((F.col("source_table") == s) & (F.col("known") == k)), m, total.get(s, 0), "source_table", "text") for s, k, m in (("cards", True, INTACT), ("cards", False, INTACT // 4), ("render_results", True, INTACT // 2))]
    intact: dict[str, list] = {}
    for part in parts:
        for r in {(r["source_table"], r["text"], r["known"]): r for r in part}.values():
            intact.setdefault(r["source_table"], []).append((r["text"], r["known"], list(r["lines"]) if r["lines"] is not None else None))
    model = values.sparkSession.sparkContext.broadcast((fit(intact, piles, complete={"cards": shown()}), piles))  # notices are complete, however they end

    def run(field: pd.Series, text: pd.Series, full: pd.Series, lines: pd.Series, broken: pd.Series, more: pd.Series) -> pd.Series:
        weights, pile = model.value
        out = []
        for f, t, u, ls, b, m in zip(field, text, full, lines, broken, more):
            # A value without any word has nothing that could be cut.
            worded = _WORD.search(SLOT.sub(" ", kept(t)[0])) is not None
            out.append(bool(worded and score(weights, t, f, pile.get((f, len(t)), 0.0), u if isinstance(u, str) else None, list(ls) if ls is not None else None, bool(b), bool(m)) >= 0.5))
        return pd.Series(out, index=text.index)

    run.__annotations__ = {"field": pd.Series, "text": pd.Series, "full": pd.Series, "lines": pd.Series, "broken": pd.Series, "more": pd.Series, "return": pd.Series}
    return values.select("source_table", "row_id", "page_id", pandas_udf(run, "boolean").asNondeterministic()("source_table", "text", "full", "lines", "broken", "more").alias("cut"))


def length_piles(values: DataFrame) -> DataFrame:
    """(source_table, n, pile) of the lengths at which a field piles up, whatever they are: how many times the mean of the six lengths beside it."""
    counts = values.groupBy("source_table", F.length("text").alias("n")).agg(F.count("*").alias("c"))
    near = counts.select("source_table", F.explode(F.array(*[F.struct((F.col("n") + d).alias("n"), (F.col("c") if d == 0 else F.lit(0)).cast("bigint").alias("c"), (F.lit(0) if d == 0 else F.col("c")).cast("bigint").alias("beside")) for d in range(-3, 4)])).alias("x")).select("source_table", "x.*")
    summed = near.groupBy("source_table", "n").agg(F.sum("c").alias("c"), F.sum("beside").alias("beside"))
    return summed.select("source_table", "n", "c", (F.col("c") / (1 + F.col("beside") / 6)).alias("pile")).where((F.col("c") >= PILE_LEAST) & (F.col("pile") >= PILE)).select("source_table", "n", "pile")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Card descriptions and render texts that were cut inside a word, a sentence or a line."""
    found = truncated_values(table(spark, sf_dir, "cards"), table(spark, sf_dir, "render_results"), table(spark, sf_dir, "pages"))
    return found.where("cut").select("source_table", "row_id").distinct()


def p5_cut_shares(spark, sf_dir: str) -> DataFrame:
    """How often each provider cuts: values, cut values and their share."""
    cards, pages, sites = (table(spark, sf_dir, t) for t in ("cards", "pages", "sites"))
    found = truncated_values(cards, table(spark, sf_dir, "render_results"), pages).groupBy("source_table", "row_id", "page_id").agg(F.max(F.col("cut").cast("int")).alias("cut"))
    host = pages.where(F.col("page_id").isNotNull()).select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).dropDuplicates(["page_id"])
    by_page = found.where(F.col("source_table") != "cards").join(host, "page_id").join(sites.select("host", "provider"), "host").select("provider", "cut")
    by_card = found.where(F.col("source_table") == "cards").join(cards.where(F.col("card_id").isNotNull()).select(F.col("card_id").alias("row_id"), "provider").dropDuplicates(["row_id"]), "row_id").select("provider", "cut")
    both = by_page.unionByName(by_card).groupBy("provider").agg(F.count("*").alias("n_values"), F.sum("cut").alias("n_cut"))
    return both.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 4))
