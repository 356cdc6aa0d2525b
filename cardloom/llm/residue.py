"""Values that hold unfilled placeholders, filler, error messages, script notices or what a failed rendering leaves.

Every value of every field is cut into segments (the blocks of a page, lines and sentences, the value itself) and every
segment is masked: numbers and slots become signs. The distinct segments are counted by field and are the lines from
which templates are mined: a prefix tree of fixed depth (token count, then the first tokens) places them, and within a
leaf those that share most of their tokens are one template, the others' tokens becoming wildcards. A template is judged
once, by what it says (a model of notices fitted on a small labelled table and on lines of the corpus) and by where it
stands (notices fill titles and descriptions alike and recur; content has its own field). Verdicts go back to the values
by a join on the segments. Slots and leftovers inside ordinary text are found separately, segment by segment.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import Kept, arrow, bounded_sample, materialise, table
from .notices import Notices, words_of

#: Depth of the prefix tree; share of a template's tokens that may be wildcards.
DEPTH, WILD = 3, 0.34
#: Log-odds at which a template is a notice. What it says counts, and where it stands: in titles and descriptions alike
#: adds BOTH, recurring in several fields adds RECURS for each doubling, twice at most; recurring in texts alone, as the
#: furniture of pages does, takes RECURS for each doubling, four times at most.
BAR, BOTH, RECURS = 0.6, 0.7, 0.25
#: Lines of the corpus that the model of notices is fitted on beside its labelled table: any, and those that recur most in texts.
CORPUS_LINES, COMMON_LINES = 3000, 500
#: Verdicts up to this many rows of 12 bytes are sent to every task; beyond, the same join shuffles.
MOST_SENT = 1_000_000
#: Size of the bit table that carries filler words to every task, whatever their number.
BITS = 1 << 24

_NAME = r"[A-Za-z][A-Za-z_.]{2,40}"
SLOT = re.compile(
    r"\{\{\{?\s*" + _NAME + r"\s*\}?\}\}|[$#]\{\s*" + _NAME + r"\s*\}|<%=?\s*" + _NAME + r"\s*%>|%%" + _NAME + r"%%|(?<![\w%])%" + _NAME + r"%(?!\w)"
    r"|\[\[\s*" + _NAME + r"\s*\]\]|(?<!\w)\[" + _NAME + r"\]|(?<![\w$#{])\{\s*" + _NAME + r"\s*\}|(?<!\w)__" + _NAME + r"?__(?!\w)|@@" + _NAME + r"@@|(?<![\w$])\$" + _NAME + r"\$|(?:&lt;|<)" + _NAME + r"(?:&gt;|>)"
)
#: What a sentence that speaks of a placeholder says beside it.
_ABOUT = re.compile(r"\b(explain\w*|means?|meant|stands? for|bedeutet|bedeuten|ersetzt|write|template|parser|mail merge|signifi\w+|syntax|quer dizer|quiere decir)\b|뜻|의미|意味", re.I)
_LEFTOVER = re.compile(r"\[object (?:Object|Undefined|Null)\]|\((?:NaN|undefined|null)(?: \w+)?\)|^(?:null|undefined|NaN)(?:\s*[–|:·-]\s|$)|\s[–|·-]\s*(?:undefined|null|NaN)$")
_NUMBER = re.compile(r"\d+")

#: Filler: words of which a passage of dummy text consists; more are learnt from the company they keep.
FILLER_SEED = ("lorem", "ipsum")
FILLER_SHARE, FILLER_COMPANY = 0.7, 0.25
#: The score that stands for filler.
FILLER = 1e6
#: The sign that ends a sentence within a line, and the space before the next one.
_STOP = re.compile(r"[.!?。！？](?:(?<=[.!?])\s+(?=[^\W\da-z])|(?<=[。！？]))")


_SIGN = re.compile(r"[{[%<$#_@&]")
#: What a value holds, in order of weight.
REASONS = ("message", "filler", "leftover", "slot")


def masked(segment: str) -> str:
    if _SIGN.search(segment):
        segment = SLOT.sub("\x01", segment)
    return " ".join(_NUMBER.sub("0", segment).lower().split())


def gaps(text: str, parts: list[str]) -> list[str]:
    """What no part covers of a text. The parts are looked up in their order; one that isn't found there, anywhere."""
    spans, at = [], 0
    for p in parts:
        if (i := text.find(p, at)) >= 0:
            at = i + len(p)
        elif (i := text.find(p)) < 0:
            continue
        spans.append((i, i + len(p)))
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start].strip())
        at = max(at, end)
    return [g for g in (*out, text[at:].strip()) if g]


def sentences(line: str) -> list[str]:
    """The sentences of a line."""
    out, at = [], 0
    for m in _STOP.finditer(line):
        out.append(line[at : m.start() + 1].strip())
        at = m.end()
    return [*out, line[at:].strip()]


def segments(text: str | None, blocks) -> list[str]:
    """The parts a value falls into: its blocks, what stands between and behind them, the lines and sentences of these and
    of the whole, and the whole itself unless its blocks make it up. Repeats count once.
    """
    if not text:
        return []
    whole = text.strip()
    parts = [b.strip() for b in blocks if b and b in text] if blocks is not None else []
    between = gaps(whole, parts)
    # Blocks that make up the text stand in its place; only its lines and sentences, which may go over their ends, are parts beside them.
    covered = sum(map(len, parts)) >= 0.9 * len(whole) and sum(map(len, between)) <= 0.1 * len(whole)
    parts += between if covered else [*between, whole]
    lines = dict.fromkeys(x.strip() for p in (*parts, whole) for x in p.split("\n"))
    return [p for p in dict.fromkeys([*parts, *(s for x in lines for s in sentences(x))]) if p]


def is_filler(words: list[str], known) -> bool:
    """Whether a segment consists of filler words; known tells whether a word is one. Numbers and signs don't count."""
    tokens = [w for w in words if w.isalpha()]
    others = (1 - FILLER_SHARE) * len(tokens) + 1e-9
    if len(tokens) < 3:
        return False
    for t in tokens:
        if not known(t):
            others -= 1
            if others < 0:
                return False
    return True


def local_reason(text: str, parts: list[str]) -> str | None:
    """What a value holds beside content whatever other values hold: 'leftover', 'slot' or None."""
    if ("NaN" in text or "undefined" in text or "null" in text or "[object" in text) and any(_LEFTOVER.search(p) for p in parts):
        return "leftover"
    if _SIGN.search(text):
        for p in parts:
            if _SIGN.search(p) and "\n" not in p and SLOT.search(p) and not _ABOUT.search(SLOT.sub(" ", p)):
                return "slot"
    return None


def _cut(text, blocks) -> dict:
    parts = segments(text, blocks)
    return {"local": local_reason(text, parts), "templates": list(dict.fromkeys(masked(p) for p in parts))}


def _values(cards: DataFrame, renders: DataFrame) -> DataFrame:
    own = cards.select(F.lit("cards").alias("source_table"), F.col("card_id").alias("row_id"), F.explode(F.array(
        F.struct(F.lit("title").alias("field_name"), F.col("title").alias("text")), F.struct(F.lit("description").alias("field_name"), F.col("description").alias("text")),
    )).alias("v")).select("source_table", "row_id", "v.field_name", "v.text", F.lit(None).cast("array<string>").alias("blocks"))
    blocks = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"])
    texts = renders.select(F.lit("render_results").alias("source_table"), F.col("render_id").alias("row_id"), F.lit("text").alias("field_name"), "text", blocks.alias("blocks"))
    return own.unionByName(texts).where(F.col("row_id").isNotNull() & (F.trim("text") != ""))


VALUE = ["source_table", "row_id", "field_name"]
FIELDS = ("title", "description", "text")
KEYS = ["size", *[f"t{i}" for i in range(DEPTH)]]


def cut_values(values: DataFrame) -> DataFrame:
    """VALUE, local, templates, marks: every value cut into masked segments, with their hashes."""
    cut = values.select(*VALUE, arrow(_cut, "struct<local:string,templates:array<string>>", "text", "blocks").alias("p")).select(*VALUE, "p.*")
    return cut.withColumn("marks", F.transform("templates", lambda t: F.xxhash64(t)))


def lines_of(parts: DataFrame) -> DataFrame:
    """(template, n, title, description, text): every distinct segment with its count and the fields it stands in."""
    each = parts.select("field_name", F.explode("templates").alias("template"))
    return each.groupBy("template").agg(F.count("*").alias("n"), *[F.max(F.col("field_name") == f).alias(f) for f in FIELDS])


def filler_bits(lines: DataFrame) -> list[int]:
    """The filler words as bits: words of card values that stand in dummy text in a fair part of the distinct values that have them."""
    short = lines.where(F.col("title") | F.col("description"))
    words = short.select(F.col("template").rlike("|".join(FILLER_SEED)).cast("int").alias("seed"), F.explode(F.array_distinct(F.split("template", r"[^\p{L}]+"))).alias("word"))
    words = words.where(F.length("word") > 3).groupBy("word").agg(F.sum("seed").alias("with"), F.count("*").alias("n")).where(F.expr(f"with >= 2 and with >= {FILLER_COMPANY} * n"))
    return [r[0] for r in words.select(F.pmod(F.xxhash64("word"), F.lit(BITS))).distinct().toLocalIterator()]


def _bit(word: str) -> int:
    h = xxhash.xxh64_intdigest(word, seed=42)
    return (h - (1 << 64) if h >> 63 else h) % BITS


def fit_notices(sample: list[str]) -> Notices:
    """The model of notices; lines of the corpus that the half without them takes for notices are not used as ordinary ones."""
    halves = sample[::2], sample[1::2]
    models = [Notices(h) for h in halves]
    return Notices([x for model, half in zip(models[::-1], halves) for x in half if model.score(x) < 0])


def judged(lines: DataFrame) -> DataFrame:
    """The lines that may be notices, with their score, and those that are filler: next to all others are left out here.

    What a leaf adds to a score is bounded, so a line too low to reach the bar with it needs no place in the tree.
    """
    bits = frozenset(filler_bits(lines)) | frozenset(map(_bit, FILLER_SEED))
    sample = [r["template"] for r in bounded_sample(lines.where((F.length("template") > 1) & ~(F.col("title") & F.col("description"))).select("template"), CORPUS_LINES, lines.count(), "template")]
    furniture = lines.where(~F.col("title") & ~F.col("description") & (F.col("n") > 1)).select("template", "n").orderBy(F.desc("n"), "template").limit(COMMON_LINES)
    sample += [r["template"] for r in furniture.collect()]
    shared = lines.sparkSession.sparkContext.broadcast((fit_notices(sample), bits))

    known = Kept(lambda word: word.isalpha() and _bit(word) in shared.value[1])  # by task

    def run(templates: pd.Series) -> pd.Series:
        lines = templates.tolist()
        words = [words_of(x) for x in lines]
        known.clear_beyond(200_000)
        # Without a filler word a line is no filler.
        dummy = [any(map(known.__getitem__, w)) and is_filler(w, known.__getitem__) for w in words]
        return pd.Series([FILLER if d else -FILLER if "\x01" in x else s for x, d, s in zip(lines, dummy, shared.value[0].scores(lines, words))], dtype=float)

    run.__annotations__ = {"templates": pd.Series, "return": pd.Series}
    score = pandas_udf(run, "double").asNondeterministic()("template")
    scored = lines.select("*", score.alias("score")).where(F.col("score") >= BAR - BOTH - 2 * RECURS)
    return scored.withColumn("filler", F.col("score") == FILLER)


def templates_of(lines: DataFrame) -> DataFrame:
    """Adds the leaf of the prefix tree that a line falls into, and its template there.

    Tokens that two lines of a leaf share at a place stay, others become '*'; a line that would lose more than WILD of
    its tokens keeps them all and is a template of its own.
    """
    df = lines.withColumn("tokens", F.split("template", " "))
    df = df.select("*", F.size("tokens").alias("size"), *[F.coalesce(F.get("tokens", F.lit(i)), F.lit("")).alias(f"t{i}") for i in range(DEPTH)])
    placed = df.select("template", *KEYS, F.posexplode("tokens").alias("at", "token"))
    common = placed.groupBy(*KEYS, "at", "token").agg(F.count("*").alias("same"))
    shape = placed.join(common, [*KEYS, "at", "token"]).groupBy("template").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("same") > 1, F.col("token")).otherwise("*").alias("token")))).alias("shape"))
    shape = shape.select("template", F.transform("shape", lambda x: x["token"]).alias("shape"))
    stars = F.size(F.filter("shape", lambda t: t == "*"))
    return df.join(shape, "template").withColumn("pattern", F.when(stars <= WILD * F.col("size"), F.col("shape")).otherwise(F.col("tokens"))).drop("tokens", "shape")


def message_templates(lines: DataFrame) -> DataFrame:
    """(size, t0.., pattern, n, score, message): the templates of the lines, each judged once."""
    leaves = lines.groupBy(*KEYS, "pattern").agg(F.sum("n").alias("n"), *[F.max(f).alias(f) for f in FIELDS], F.max("score").alias("score"))
    several = sum((F.col(f).cast("int") for f in FIELDS), F.lit(0)) > 1
    in_text = ~F.col("title") & ~F.col("description")
    added = F.when(F.col("title") & F.col("description"), BOTH).otherwise(0.0) + RECURS * F.when(several, F.least(F.log2("n"), F.lit(2.0))).when(in_text, -F.least(F.log2("n"), F.lit(4.0))).otherwise(0.0)
    return leaves.withColumn("message", F.col("score") + added >= BAR)


def verdicts(parts: DataFrame) -> DataFrame:
    """(mark, reason) of every segment that is a message or filler."""
    lines = materialise(lines_of(parts))
    some = materialise(judged(lines))
    placed = templates_of(some.where(~F.col("filler")))
    good = message_templates(placed).where("message").select(*KEYS, "pattern")
    messages = placed.join(good, [*KEYS, "pattern"], "left_semi").select(F.xxhash64("template").alias("mark"), F.lit("message").alias("reason"))
    return materialise(messages.unionByName(some.where("filler").select(F.xxhash64("template").alias("mark"), F.lit("filler").alias("reason"))))


def residue_values(cards: DataFrame, renders: DataFrame) -> DataFrame:
    """(source_table, row_id, field_name, reason) of the values that hold residue or notices.

    Null and empty values are none, rows with a null id are dropped, repeated rows count once; extra columns don't
    matter. Very long texts are cut into segments, never shortened.
    """
    parts = materialise(cut_values(_values(cards, renders)))
    known = verdicts(parts)
    known = F.broadcast(known) if known.count() <= MOST_SENT else known
    shared = parts.select(*VALUE, F.explode("marks").alias("mark")).join(known, "mark").select(*VALUE, "reason")
    own = parts.where(F.col("local").isNotNull()).select(*VALUE, F.col("local").alias("reason"))
    order = F.array(*[F.lit(x) for x in REASONS])
    return shared.unionByName(own).groupBy(*VALUE).agg(F.get(order, F.min(F.array_position(order, F.col("reason"))).cast("int") - 1).alias("reason"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Values that hold residue or notices for content, or within it."""
    return residue_values(table(spark, sf_dir, "cards"), table(spark, sf_dir, "render_results")).select("source_table", "row_id", "field_name")


def p2_reasons(spark, sf_dir: str) -> DataFrame:
    """The same values with what was found."""
    return residue_values(table(spark, sf_dir, "cards"), table(spark, sf_dir, "render_results"))
