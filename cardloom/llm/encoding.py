"""Text that was decoded with the wrong character encoding: which values, and what they said.

Noisy channel. A channel is a way to garble one character: its bytes in the true encoding, shown through another one,
with the bytes that the second cannot show left out. Left-out bytes are the wildcards of the lattice: a run of garbled
characters stands for every character whose bytes show as it. A word is read back by Viterbi over the ways to cut it
into such runs, under the counts of all characters in the corpus; the best readings of each word are then weighed by how
often the corpus has the word itself and has each reading, and a second Viterbi pass over the words of a value, which
charges for a change of channel, decides which words are damaged.

Characters number at most some tens of thousands whatever the corpus, so their counts go to every task. Words don't, so
word counts are joined: only words that hold a character from outside ASCII and the East Asian blocks take part.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import arrow, field_values, materialise

#: Characters that hold no trace of a wrong single-byte decoding: ASCII and the East Asian blocks.
_PLAIN = r"\x00-\x7Fᄀ-ᇿ　-ヿ㄰-㆏ㇰ-ㇿ㐀-䶿一-鿿가-힣＀-￯"
_ODD = re.compile(f"[^{_PLAIN}]")
#: Words that may be damaged, as a pattern for the scan: the marks that garbling leaves.
_SUSPECT = re.compile(
    f"[^{_PLAIN}àâäáãçéèêëíîïñóôöõúùûüßœæÀÁÉÊÓÚÍÜÖÄÕÑÇ¿¡‘’“”„«»–—…·•°£€©ªº®×]"
    "|[a-z][ÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ]|[a-z]['¿¡“”„«»…·•°£€©®×][a-z]|[ÃÂâ]|^[ÀÁÉÊÓÚÍÜÖÄÕÑÇ¿…·•©®ª£º×æ][^a-zA-Z]?$|[ÓÚÍÉÊÁÀÈ][a-z]+[ÓÚÍÉÊÁÀÈ]|^[ÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜæ][a-z]|î$|^[ñóá]$|&[aA][a-z]+;"
)
#: A sign inside a word, as no language has it.
_SYMBOL = re.compile("[a-z][²³¹º¬¦§¨´¸÷×‡†‰ÆͰ-Ͽ -‐∀-◿][a-z]")
_ENTITY = re.compile(r"&[A-Za-z]+;")
LOST = "�"
_TRIM = " \t\r\n.,;:!?()[]{}\"'|-"
_QUOTES = "“”„«»‘’「」\"'"
BEAM = 6


def _show(raw: bytes, codec: str, lost: str) -> str:
    """Bytes seen through a single-byte codec; those it has no character for are dropped, kept as control characters, or replaced."""
    out = []
    for b in raw:
        if codec == "latin-1" and 0x80 <= b < 0xA0:
            out.append({"drop": "", "keep": chr(b), "mark": LOST}[lost])
            continue
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append({"drop": "", "keep": chr(b), "mark": LOST}[lost])
    return "".join(out)


def _through(true: str, seen: str, lost: str, times: int = 1):
    def garble(ch: str) -> str:
        for _ in range(times):
            ch = _show(ch.encode(true), seen, lost)
        return ch

    return garble


def _as_utf8(true: str):
    """Single bytes read as UTF-8: each becomes the replacement character."""
    return lambda ch: "".join(chr(b) if b < 128 else LOST for b in ch.encode(true))


CHANNELS = {
    "utf-8 as cp1252": _through("utf-8", "cp1252", "keep"),
    "utf-8 as cp1252, bytes lost": _through("utf-8", "cp1252", "drop"),
    "utf-8 as latin-1": _through("utf-8", "latin-1", "keep"),
    "utf-8 as latin-1, bytes lost": _through("utf-8", "latin-1", "drop"),
    "utf-8 as cp1252, twice": _through("utf-8", "cp1252", "keep", 2),
    "utf-8 as cp1252, twice, bytes lost": _through("utf-8", "cp1252", "drop", 2),
    "utf-8 as mac-roman": _through("utf-8", "mac_roman", "keep"),
    "utf-8 as cp1251": _through("utf-8", "cp1251", "keep"),
    "utf-8 as cp1251, bytes lost": _through("utf-8", "cp1251", "drop"),
    "utf-8 as cp437": _through("utf-8", "cp437", "keep"),
    "cp1252 as mac-roman": _through("cp1252", "mac_roman", "keep"),
    "cp1252 as cp437": _through("cp1252", "cp437", "keep"),
    "cp1252 as cp850": _through("cp1252", "cp850", "keep"),
    "cp1252 as cp1251": _through("cp1252", "cp1251", "keep"),
    "mac-roman as cp1252": _through("mac_roman", "cp1252", "keep"),
    "cp1252 as utf-8": _as_utf8("cp1252"),
    "shift-jis as cp1252": _through("cp932", "cp1252", "keep"),
    "shift-jis as cp1252, bytes lost": _through("cp932", "cp1252", "drop"),
    "euc-jp as latin-1": _through("euc_jp", "latin-1", "keep"),
    "euc-kr as cp1252": _through("cp949", "cp1252", "keep"),
}
NAMES = list(CHANNELS)
#: The channel that leaves one and the same sign for every character that it garbles.
LOSSY = "cp1252 as utf-8"
#: A word with at least this share of all occurrences is hot, so there are at most its inverse of them; hot words are joined in so many parts.
HOT_SHARE, PARTS = 1 / 2000, 64


class Lattice:
    """Reads words back through every channel, under counts of characters."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.rare = math.log(total)
        self.cost = {c: math.log(total / n) for c, n in counts.items() if n > 0}
        self.back: list[dict[str, list[tuple[float, str]]]] = []
        self.longest: list[int] = []
        for garble in CHANNELS.values():
            table: dict[str, list[tuple[float, str]]] = {}
            for ch, cost in self.cost.items():
                if ord(ch) < 128 or ch == LOST:
                    continue
                try:
                    shown = garble(ch)
                except (UnicodeError, ValueError):
                    continue
                if shown and shown != ch and not shown.isascii():
                    table.setdefault(shown, []).append((cost, ch))
            self.back.append({k: sorted(v)[:BEAM] for k, v in table.items()})
            self.longest.append(max(map(len, table), default=1))

    def identity(self, word: str) -> float:
        return sum(self.cost.get(c, self.rare) for c in word)

    def read(self, word: str, channel: int) -> list[tuple[float, str, int]]:
        """The BEAM cheapest readings as (cost, text, garbled characters of runs of two or more); none if a mark stays unread."""
        back, longest = self.back[channel], self.longest[channel]
        best: list[list[tuple[float, str, int]]] = [[(0.0, "", 0)]] + [[] for _ in word]
        for end in range(1, len(word) + 1):
            found: dict[str, tuple[float, str, int]] = {}
            ch = word[end - 1]
            steps = [(end - 1, [(self.cost.get(ch, self.rare), ch)], 0)] if ord(ch) < 128 else []
            for size in range(1, min(longest, end) + 1):
                if got := back.get(word[end - size : end]):
                    steps.append((end - size, got, size if size > 1 else 0))
            for start, got, runs in steps:
                for cost0, text0, runs0 in best[start]:
                    for cost1, text1 in got:
                        item = (cost0 + cost1, text0 + text1, runs0 + runs)
                        if item[1] not in found or item[0] < found[item[1]][0]:
                            found[item[1]] = item
            best[end] = sorted(found.values())[:BEAM]
        return best[-1]


_lattices: dict[str, Lattice] = {}


def _lattice(counts) -> Lattice:
    """The lattice of one run, made once a worker; runs are told apart by a name of their own, as workers outlive them."""
    run, by_char = counts.value
    if run not in _lattices:
        _lattices.clear()
        _lattices[run] = Lattice(by_char)
    return _lattices[run]


@lru_cache(maxsize=100_000)
def _core(word: str) -> str:
    return word.strip(_TRIM)


def split_words(text: str) -> list[str]:
    """The words of a text with their ASCII punctuation taken off; entities for letters are read first."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return [c for w in re.split(r"[ \t\r\n]+", text) if (c := _core(w))]


def _odd_words(text: str) -> list[str]:
    """Those of split_words that hold an odd character, which none within ASCII does."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if text.isascii():
        return []
    return [_core(w) for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if not w.isascii() and _ODD.search(w)]


def _joined(texts: Iterable[str], most: int = 1_000_000) -> Iterator[str]:
    """The texts in their order, joined until they are that long."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text)
        if n >= most:
            yield "".join(part)
            part, n = [], 0
    yield "".join(part)


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of characters and of odd words, added up per batch before anything is shuffled."""
    for pdf in batches:
        chars: Counter = Counter()
        words: Counter = Counter()
        for text in pdf["__text"]:
            words.update(_odd_words(text))
        for text in _joined(pdf["__text"]):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            counts = np.bincount(codes)
            for code in np.flatnonzero(counts).tolist():
                chars[chr(code)] += int(counts[code])
        yield pd.DataFrame({"char": [True] * len(chars) + [False] * len(words), "key": [*chars, *words], "n": [*chars.values(), *words.values()]})


def shape(word: str) -> str | None:
    """A word as it shows where its bytes were read as UTF-8: every odd character lost; None where nothing is."""
    try:
        out = word.encode("cp1252").decode("ascii", "replace")  # as CHANNELS[LOSSY] does character by character
    except UnicodeError:
        return None
    return out if LOST in out else None


def suspects(text: str) -> list[dict]:
    """Words that may be damaged, with their places among the words of the text."""
    words = split_words(text)
    alone = {w.strip(_QUOTES) for w in words if len(w) <= 3 and not w.isascii()}
    return [{"at": i, "word": w, "last": i == len(words) - 1, "alone": sorted(alone - {w})} for i, w in enumerate(words) if _SUSPECT.search(w) or LOST in w]


def _quoted(word: str) -> bool:
    return len(word) > 2 and word[0] in _QUOTES and word[-1] in _QUOTES and len(word.strip(_QUOTES)) <= 4


def _mention(word: str, restored: str, words: set[str]) -> bool:
    """A mark that is spoken of: it stands in quotes, or alone in a text that also has the right character alone."""
    inner = restored.strip(_QUOTES + _TRIM)
    return _quoted(word) or len(inner) <= 1 and any(w.strip(_QUOTES) == inner for w in words)


def _quote_only(text: str) -> bool:
    """An ASCII word behind an opening or before a closing quotation mark: known however rare the two are together."""
    inner = text.lstrip("“«„‘").rstrip("”»“’")
    return len(inner) > 1 and inner.isascii() and inner.isalpha() and inner != text


def decide(items: list) -> list[dict]:
    """Viterbi over the suspect words of a value; states are 'sound' and the channels.

    items: dicts with at, word, n (count of the word in the corpus) and readings (channel, text, gain, n). Returns the
    damaged words with channel and reading; a lost character that no channel reads gives a null reading.
    """
    SWITCH, DAMAGED = 3.0, 2.0
    lossy = NAMES.index(LOSSY)
    kin = lambda state: lossy if state == -2 else state  # a loss that nothing reads is of the channel that loses
    states: list[list[tuple[int, float, str | None]]] = []
    for x in items:
        options: list[tuple[int, float, str | None]] = [(-1, 0.0, None)]
        for r in x["readings"] or []:
            fit = math.log((r["n"] + 0.2) / (x["n"] + 0.2)) + (4.0 if _SYMBOL.search(x["word"]) else 0.0)
            if LOST in x["word"] and not r["runs"] and r["n"] >= 2:  # a word of the corpus is better than none, the commoner the better
                options.append((r["channel"], -4.5 - 0.1 * math.log(r["n"]), r["text"]))
                continue
            gain = r["gain"] + min(fit, 6.0) if r["runs"] else fit - 1.5 if r["n"] >= 2 else 1.0 if _quote_only(r["text"]) else -9.0
            options.append((r["channel"], -gain + (0.0 if r["n"] else 0.5), r["text"]))
        if LOST in x["word"]:
            options.append((-2, -4.0, None))
        states.append(options)
    if not states:
        return []
    costs = [c + (DAMAGED if s != -1 else 0) for s, c, _ in states[0]]
    back = []
    for before, now in zip(states, states[1:]):
        new, links = [], []
        for s, c, _ in now:
            step = [costs[i] + (0.0 if kin(s) == kin(t) else SWITCH if s != -1 and t != -1 else DAMAGED if s != -1 else 0.0) for i, (t, _, _) in enumerate(before)]
            i = min(range(len(step)), key=step.__getitem__)
            new.append(step[i] + c)
            links.append(i)
        costs, back = new, [*back, links]
    i = min(range(len(costs)), key=costs.__getitem__)
    path = [i]
    for links in reversed(back):
        path.append(i := links[i])
    out = []
    for x, options, i in zip(items, states, reversed(path)):
        channel, _, text = options[i]
        if channel != -1:
            out.append({"at": int(x["at"]), "word": x["word"], "channel": NAMES[channel] if channel >= 0 else None, "restored": text})
    return out


def _readings(word: str, n: int, lattice: Lattice) -> list[dict]:
    out: dict[str, dict] = {}
    own = lattice.identity(word)
    for k in range(len(NAMES)):
        for cost, text, runs in lattice.read(word, k)[: BEAM if LOST in word else 2]:
            if text != word and (text not in out or runs > out[text]["runs"]):
                out[text] = {"channel": k, "text": text, "gain": float(own - cost), "runs": runs}
    return sorted(out.values(), key=lambda r: -r["gain"])[: 3 * BEAM]


def damaged_values(values: DataFrame, *, keys: tuple[str, ...] = ("source_table", "row_id", "field_name"), text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """One row per value that was wholly or partly decoded wrongly: keys and words (at, word, channel, restored).

    With only, a table of keys, no other values are judged; characters and words are counted in all of them all the same.

    restored is null where nothing fits, as where every byte of a character was lost. Values whose only garbled marks
    are spoken of, in quotes or beside the right character, are sound, and so are those whose only lost character is
    their last, which a cut leaves. Null and empty values are sound; repeated rows count once; only keys and text_col are read. Character counts, some tens of thousands at most, go to every task; words are joined.
    """
    base = values.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("__text")).where(F.col("__text").rlike(f"[^\\x00-\\x7F]|&[a-zA-Z]+;"))
    ids = [f"__k{i}" for i in range(len(keys))]
    tally = materialise(base.select("__text").mapInPandas(_tally, "char boolean, key string, n bigint").groupBy("char", "key").agg(F.sum("n").alias("n")))
    counts = values.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, {r["key"]: r["n"] for r in tally.where("char").toLocalIterator()}))
    counted = tally.where("not char").select(F.col("key").alias("word"), "n")
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = base
    if only is not None:
        judged = base.join(only.select(*[F.col(k).alias(i) for i, k in zip(ids, keys)]).distinct(), ids, "left_semi")
    found = judged.select(*ids, F.explode(arrow(suspects, "array<struct<at:int,word:string,last:boolean,alone:array<string>>>", "__text")).alias("s")).select(*ids, "s.*").distinct()
    doubtful = counted.where(F.col("word").rlike(_SUSPECT.pattern) | F.col("word").contains(LOST))
    if only is not None:
        found = materialise(found)
        doubtful = doubtful.join(found.select("word").distinct(), "word", "left_semi")
    doubtful = materialise(doubtful)
    reading = "struct<channel:int,text:string,gain:double,runs:int>"
    rated = doubtful.repartition(spread, "word").select("word", "n", F.explode_outer(arrow(lambda w, n: _readings(w, n, _lattice(counts)), f"array<{reading}>", "word", "n")).alias("r"))
    known = counted.select(F.col("word").alias("__reading"), F.col("n").alias("__count"))
    rated = rated.join(known, F.col("r.text") == F.col("__reading"), "left").where(F.col("r").isNull() | (F.col("r.runs") > 0) | F.col("__count").isNotNull())
    rated = rated.select("word", "n", F.when(F.col("r").isNotNull(), F.struct("r.channel", "r.text", "r.gain", "r.runs", F.coalesce("__count", F.lit(0)).alias("n"))).alias("r"))
    # Where one sign stands for every lost character the lattice can't tell them apart: the words of the corpus that show as such a word are its readings, all of them.
    shaped = counted.select(F.col("word").alias("__reading"), F.col("n").alias("__count"), arrow(shape, "string", "word").alias("__shape")).where(F.col("__shape").isNotNull())
    lost = doubtful.where(F.col("word").contains(LOST)).join(shaped, F.col("word") == F.col("__shape"))
    lost = lost.select("word", "n", F.struct(F.lit(NAMES.index(LOSSY)).alias("channel"), F.col("__reading").alias("text"), F.lit(0.0).alias("gain"), F.lit(0).alias("runs"), F.col("__count").alias("n")).alias("r"))
    rated = rated.unionByName(lost).groupBy("word", "n").agg(F.sort_array(F.collect_set("r")).alias("readings"))
    rated = rated.where((F.size("readings") > 0) | F.col("word").contains(LOST))
    # A hot word is joined in PARTS parts, so that no task gets all of its occurrences.
    total = doubtful.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(doubtful.where(F.col("n") >= max(1.0, HOT_SHARE * total)).select("word", F.lit(True).alias("hot")))
    found = found.join(hot, "word", "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64(*ids), F.lit(PARTS))).otherwise(F.lit(0).cast("bigint"))).drop("hot")
    rated = rated.join(hot, "word", "left").withColumn("part", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))).drop("hot")
    found = found.join(rated, ["word", "part"]).groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("at", "word", "last", "alone", "n", "readings"))).alias("items"))
    found = found.select(*ids, arrow(_verdict, "array<struct<at:int,word:string,channel:string,restored:string>>", "items").alias("words"))
    return found.where(F.size("words") > 0).select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], "words")


def _verdict(items) -> list[dict]:
    rows = [{**x, "readings": list(x["readings"])} for x in items]
    out = decide(rows)
    last = {x["at"] for x in rows if x["last"]}
    alone = {x["at"]: set(x["alone"]) for x in rows}
    strong = [x for x in out if not _mention(x["word"], x["restored"] if x["restored"] is not None else x["word"], alone[x["at"]]) and not (x["word"].count(LOST) == 1 and x["word"].endswith(LOST) and x["at"] in last)]
    return out if strong else []


def restore(text: str, words: list) -> str:
    """The text with its damaged words put right; words whose reading is null stay as they are."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    fixes, at, out = {w["at"]: w for w in words if w["restored"] is not None}, -1, []
    for part in re.split(r"([ \t\r\n]+)", text):
        if core := _core(part):
            at += 1
            if at in fixes and fixes[at]["word"] == core:
                part = part.replace(core, fixes[at]["restored"], 1)
        out.append(part)
    return "".join(out)


def restored_values(values: DataFrame) -> DataFrame:
    """damaged_values with the text before and after."""
    keys = ["source_table", "row_id", "field_name"]
    bad = damaged_values(values)
    return values.select(*keys, "text").distinct().join(bad, keys).withColumn("restored", arrow(restore, "string", "text", "words"))


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Values that were decoded wrongly."""
    return damaged_values(field_values(spark, sf_dir)).select("source_table", "row_id", "field_name")


def p7_restored(spark, sf_dir: str) -> DataFrame:
    """The same values with their text before and after."""
    return restored_values(field_values(spark, sf_dir)).select("source_table", "row_id", "field_name", "text", "restored")
