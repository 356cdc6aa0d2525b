"""Statistics of a text, and whether it is prose, a list, a table or junk.

Every threshold on a statistic is a labelling function that votes for one type or abstains. Their accuracies are not
given: expectation-maximization over all texts learns, from where the functions agree, how often each type draws each
vote, and gives every text a posterior over the types. Votes make patterns, at most two to the number of functions
whatever the corpus, so the fit needs only the count of each pattern.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .boilerplate import block_texts, fitted_tree, judge
from .common import Kept, arrow, materialise, table
from .residue import residue_values

TYPES = ("prose", "list", "table", "junk")
ROUNDS = 60

_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_KANA_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_BULLET = re.compile(r"^\s*(?:[-*•‣◦·–—]|\(?\d{1,3}[.)]|[a-z]\))\s+\S")
_END = re.compile(r"[.!?。！？…][)\]”’\"'»」』]*\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_COLUMNS = (re.compile(r"\t"), re.compile(r"\s*;\s*"), re.compile(r"\s*\|\s*"), re.compile(r" {2,}"), re.compile(r",\s+"))
_FIGURE = re.compile(r"[\d.,%]+")
_HEX = re.compile(r"[0-9a-f]{2}|[0-9a-f]{4}|[0-9a-f]{8,}")
_DIGIT = re.compile(r"\d")
_VOWEL = re.compile(r"[aeiouyà-ÿ]")
_HANGUL = re.compile(r"[가-힣]")
_CODE = re.compile(r"[{}=<>]|\);|;\s*(?:\n|$)|\bfunction\b|\bvar\b")
_CODE_SIGNS, _HEX_SIGNS = frozenset("{}=<>;"), frozenset("0123456789abcdef")
_KOREAN_END = re.compile(r"[다요까][.!?]?$|[은는이가을를에의로]$")
_KANA_PARTICLE = re.compile(r"[のはをがにでと]")
#: Words and tokens of which is kept what the statistics ask of them.
MOST_KEPT = 200_000


def _token(w: str) -> int:
    """1 for a token of hexadecimal digits, and 1 << 32 for one that is mashed keys."""
    low = w.lower()
    mashed = ";" in low.strip(";") or len(low) > 4 and not _VOWEL.search(low)
    return (w[0] in _HEX_SIGNS and _HEX.fullmatch(w) is not None) + (mashed << 32)


_tokens = Kept(_token)
_kana_han = Kept(lambda w: _KANA_HAN.search(w) is not None)
_east = Kept(lambda w: _CJK.search(w) is not None)
_hangul = Kept(lambda w: _HANGUL.search(w) is not None)
_korean_end = Kept(lambda w: _KOREAN_END.search(w) is not None)


def statistics(text: str | None, common: frozenset, block_count: int | None = None) -> dict:
    """The statistics of a text; of a null or empty one all are 0.

    Words of Chinese characters and kana count as one per two characters. block_count is passed through.
    """
    lines = [x for x in (text or "").split("\n") if x.strip()]
    flat = " ".join(lines)
    n = len(flat)
    spelled = [_WORD.findall(x.lower()) for x in lines]
    words = [w for x in spelled for w in x]
    kinds = Counter(flat)
    letters = figures = symbols = east = all_east = 0
    for c, k in kinds.items():
        if c.isalpha():
            letters += k
            if c > "\u3000" and _CJK.match(c):
                all_east += k
                east += k if _KANA_HAN.match(c) else 0
        elif c.isdigit():
            figures += k
        elif not (c.isalnum() or c.isspace()):
            symbols += k
    for kept in (_tokens, _kana_han, _east, _hangul, _korean_end):
        kept.clear_beyond(MOST_KEPT)
    count = len(words) - sum(map(_kana_han.__getitem__, words)) + east // 2 if east else len(words)
    latin = [w for w in words if not _east[w]] if all_east else words
    korean = [w for w in words if _hangul[w]] if all_east else []
    per_line = [len(w) + (len(_KANA_HAN.findall(x)) / 2 if east else 0) for w, x in zip(spelled, lines)]
    tokens = flat.split()
    odd = sum(map(_tokens.__getitem__, tokens))
    last = [bool(_END.search(x)) for x in lines]
    columns = best = 0.0
    numbered = [(x, x.strip()) for x in lines if _DIGIT.search(x)] if figures else []
    for sign, pattern in zip("\t;| ,", _COLUMNS):
        marked = [x for x, bare in numbered if ("  " if sign == " " else sign) in bare]
        if len(marked) <= best * len(lines):
            continue
        cells = [[c for c in pattern.split(x.strip()) if c] for x in marked]
        good = sum((len(c) >= 3 or len(c) == 2 and _FIGURE.fullmatch(c[1].strip()) is not None) and any(len(y.strip()) < 12 and any(ch.isdigit() for ch in y) for y in c[1:]) for c in cells)
        if good / len(lines) > best:
            best, columns = good / len(lines), float(Counter(map(len, cells)).most_common(1)[0][0])
    top = max(Counter(words).values(), default=0)
    # Two words by turns, which need one of them to be a fourth of all.
    pairs = max(Counter(zip(words, words[1:])).values(), default=0) if 5 * top >= len(words) else 0
    ends = sum(last)
    frequent = sum(map(common.__contains__, words))
    # Signs of code are looked for where one of them can stand.
    code = len(_CODE.findall(flat)) if not _CODE_SIGNS.isdisjoint(kinds) or "function" in flat or "var" in flat else 0
    return {
        "word_count": count, "mean_word_length": round(sum(map(len, latin)) / len(latin), 4) if latin else 0.0,
        "symbol_ratio": round(symbols / n, 4) if n else 0.0,
        "digit_ratio": round(figures / n, 4) if n else 0.0,
        "alpha_ratio": round(letters / n, 4) if n else 0.0,
        "line_count": len(lines), "end_punct_share": round(ends / len(lines), 4) if lines else 0.0,
        "bullet_share": round(sum(bool(_BULLET.match(x)) for x in lines) / len(lines), 4) if lines else 0.0,
        "words_per_line": round(sum(per_line) / len(lines), 4) if lines else 0.0,
        "short_line_share": round(sum(p <= 6 and not e for p, e in zip(per_line, last)) / len(lines), 4) if lines else 0.0,
        "column_share": round(best, 4), "columns": columns,
        "common_share": round(frequent / len(words), 4) if words else 0.0,
        "function_share": round(((sum(map(common.__contains__, latin)) if all_east else frequent) + sum(map(_korean_end.__getitem__, korean))) / max(1, len(latin) + len(korean)), 4) if latin or korean else 0.0,
        "particle_share": round(len(_KANA_PARTICLE.findall(flat)) / east, 4) if east else 0.0,
        "repeat_share": round(max(top, 2 * pairs) / len(words), 4) if len(words) >= 8 else 0.0,
        "code_ratio": round(code / n, 4) if n else 0.0,
        "east_share": round(all_east / n, 4) if n else 0.0,
        "longest_word": max(map(len, tokens), default=0) if not east else 0,
        "hex_share": round((odd & 0xFFFFFFFF) / max(1, len(tokens)), 4),
        "mash_share": round((odd >> 32) / max(1, len(tokens)), 4),
        "block_count": block_count or 0,
    }


STATISTICS = "word_count bigint, mean_word_length double, symbol_ratio double, digit_ratio double, alpha_ratio double, line_count bigint, end_punct_share double, bullet_share double, words_per_line double, short_line_share double, column_share double, columns double, common_share double, function_share double, particle_share double, repeat_share double, code_ratio double, east_share double, longest_word bigint, hex_share double, mash_share double, block_count bigint"

#: Labelling functions: the type each votes for, and the threshold on the statistics at which it does.
FUNCTIONS = [
    ("prose", lambda s: s["end_punct_share"] >= 0.4 and s["words_per_line"] >= 7),
    ("prose", lambda s: s["function_share"] >= 0.2 and s["words_per_line"] >= 6 or s["particle_share"] >= 0.12 and s["words_per_line"] >= 7),
    ("prose", lambda s: s["words_per_line"] >= 9 and s["symbol_ratio"] < 0.08 and s["digit_ratio"] < 0.08 and s["mash_share"] < 0.1 and s["repeat_share"] < 0.3 and s["hex_share"] < 0.2 and s["longest_word"] < 40),
    ("list", lambda s: s["bullet_share"] >= 0.6 and s["words_per_line"] < 8 and s["end_punct_share"] < 0.35),
    ("list", lambda s: s["short_line_share"] >= 0.6 and s["line_count"] >= 4 and s["column_share"] < 0.4 and s["code_ratio"] < 0.03 and s["symbol_ratio"] < 0.3),
    ("list", lambda s: s["words_per_line"] <= 5 and s["line_count"] >= 5 and s["end_punct_share"] <= 0.25 and s["column_share"] < 0.4 and s["alpha_ratio"] > 0.35 and s["mash_share"] < 0.2 and s["repeat_share"] < 0.5 and s["code_ratio"] < 0.03),
    ("table", lambda s: s["column_share"] >= 0.6 and s["line_count"] >= 2 and s["bullet_share"] < 0.5),
    ("table", lambda s: s["column_share"] >= 0.4 and s["columns"] >= 3 and s["digit_ratio"] >= 0.08 and s["bullet_share"] < 0.5),
    ("table", lambda s: 0.1 <= s["digit_ratio"] <= 0.6 and s["words_per_line"] <= 5 and s["bullet_share"] < 0.3 and s["column_share"] >= 0.3),
    ("junk", lambda s: s["alpha_ratio"] < 0.45 and s["column_share"] < 0.4 and s["bullet_share"] < 0.3 and s["east_share"] < 0.2),
    ("junk", lambda s: s["symbol_ratio"] > 0.3 and s["column_share"] < 0.5 and s["bullet_share"] < 0.5),
    ("junk", lambda s: s["repeat_share"] >= 0.5),
    ("junk", lambda s: s["code_ratio"] >= 0.05),
    ("junk", lambda s: s["hex_share"] >= 0.5 or s["longest_word"] >= 50),
    ("junk", lambda s: s["mash_share"] >= 0.25),
    ("junk", lambda s: s["function_share"] <= 0.02 and s["word_count"] >= 15 and s["words_per_line"] >= 5 and s["east_share"] < 0.1 and s["bullet_share"] < 0.3 and s["column_share"] < 0.3),
]


def votes(stats: dict) -> int:
    """The votes of all functions as the bits of a number."""
    return sum(1 << i for i, (_, f) in enumerate(FUNCTIONS) if f(stats))


def fit(patterns: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Class shares and the chance of each vote under each class, by expectation-maximization on counts of vote patterns."""
    k, m = len(TYPES), len(FUNCTIONS)
    own = np.array([TYPES.index(t) for t, _ in FUNCTIONS])
    prior = np.array([0.7, 0.1, 0.1, 0.1])
    chance = np.full((k, m), 0.05)
    chance[own, np.arange(m)] = 0.7
    if not patterns:
        return prior, chance
    keys = sorted(patterns)
    bits = np.array([[p >> i & 1 for i in range(m)] for p in keys], dtype=float)
    weight = np.array([patterns[p] for p in keys], dtype=float)
    for _ in range(ROUNDS):
        post = posterior(bits, prior, chance) * weight[:, None]
        total = post.sum(axis=0)
        # Each function starts as one that is right more often than not; the pseudo-counts keep it so where texts are few.
        hope = np.full((k, m), 0.05)
        hope[own, np.arange(m)] = 0.7
        chance = np.clip((post.T @ bits + 20 * hope) / (total[:, None] + 20), 1e-4, 1 - 1e-4)
        prior = (total + 5) / (total + 5).sum()
    return prior, chance


def posterior(bits: np.ndarray, prior: np.ndarray, chance: np.ndarray) -> np.ndarray:
    log = np.log(prior) + bits @ np.log(chance).T + (1 - bits) @ np.log(1 - chance).T
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(axis=1, keepdims=True)


def main_texts(renders: DataFrame) -> DataFrame:
    """(render_id, body, block_count) of every render: the text blocks of its main body, one a line; without blocks its text."""
    tree = fitted_tree(renders)

    def body(text, texts, html) -> str | None:
        own = list(texts) if texts is not None else []
        return "\n".join(t for t, main in zip(own, judge(tree.value, own, html)) if main) if own else text

    rows = renders.where(F.col("render_id").isNotNull())
    return rows.select("render_id", arrow(body, "string", "text", block_texts(), "html").alias("body"), F.col("block_count").cast("bigint").alias("block_count"))


def noted_renders(residue: DataFrame) -> DataFrame:
    """(render_id) of the renders whose text holds residue or notices."""
    return residue.where((F.col("source_table") == "render_results") & (F.col("field_name") == "text")).select(F.col("row_id").alias("render_id")).distinct()


def text_types(bodies: DataFrame, noted: DataFrame, quality: DataFrame, common_words: DataFrame) -> DataFrame:
    """(source_table, row_key, statistics..., kind, posterior, noted) of each main body and each text of a quality case.

    noted is true for renders that hold residue or notices; they take no part in the fit. Null and empty texts have
    statistics of 0 and are prose by prior; null keys are dropped; repeated rows count once; extra columns don't matter.
    Texts are read whole.
    """
    common = frozenset(r[0].lower() for r in common_words.select("word").where(F.col("word").isNotNull()).distinct().toLocalIterator())

    def run(text, block_count):
        stats = statistics(text, common, None if block_count is None or block_count != block_count else int(block_count))
        return {**stats, "votes": votes(stats)}

    marked = bodies.join(noted.withColumn("noted", F.lit(True)), "render_id", "left")
    a = marked.select(F.lit("render_results").alias("source_table"), F.col("render_id").cast("string").alias("row_key"), F.coalesce("body", F.lit("")).alias("text"), "block_count", F.coalesce("noted", F.lit(False)).alias("noted"))
    b = quality.where(F.col("case_id").isNotNull()).select(F.lit("quality_cases").alias("source_table"), F.col("case_id").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"), F.size("blocks").cast("bigint").alias("block_count"), F.lit(False).alias("noted"))
    judged = a.unionByName(b).select("source_table", "row_key", "noted", arrow(run, f"struct<{', '.join(p.replace(' ', ':', 1) for p in STATISTICS.split(', '))},votes:bigint>", "text", "block_count").alias("s")).groupBy("source_table", "row_key").agg(F.first("s").alias("s"), F.max("noted").alias("noted"))
    judged = materialise(judged)
    counts = judged.groupBy("s.votes").agg(F.sum((~F.col("noted")).cast("bigint")).alias("n")).collect()
    patterns = {r[0]: r[1] for r in counts if r[1]}
    prior, chance = fit(patterns)
    known = sorted(r[0] for r in counts)
    post = posterior(np.array([[p >> i & 1 for i in range(len(FUNCTIONS))] for p in known], dtype=float), prior, chance) if known else np.zeros((0, len(TYPES)))
    table_ = judged.sparkSession.createDataFrame([(p, TYPES[int(q.argmax())], round(float(q.max()), 6)) for p, q in zip(known, post)], "votes bigint, kind string, posterior double")
    return judged.select("source_table", "row_key", "noted", "s.*").join(F.broadcast(table_), "votes").drop("votes")


def _typed(spark, sf_dir: str) -> DataFrame:
    renders, cards, quality, words = (table(spark, sf_dir, t) for t in ("render_results", "cards", "quality_cases", "common_words"))
    return text_types(main_texts(renders), noted_renders(residue_values(cards, renders)), quality, words)


def p6_statistics(spark, sf_dir: str) -> DataFrame:
    """The statistics of each text with its type."""
    return _typed(spark, sf_dir).drop("noted")


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Texts that are mainly a list, a table or junk."""
    return _typed(spark, sf_dir).where((F.col("kind") != "prose") & ~F.col("noted")).select("source_table", "row_key", "kind")
