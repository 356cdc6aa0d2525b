"""Sentences of held-out items inside documents.

Containment search with size partitions: a held-out sentence of up to s words is looked up among windows of 2s words
that overlap by half, so that one of them holds the sentence whole however long the document is. Within a partition both
sides have alike sizes, and MinHash bands tuned to the containment threshold find the candidates. Words that no held-out
item has can't add to the containment and are left out of the windows first, which empties nearly all of them; they are
known by a bit table of fixed size, whatever their number. Every candidate is verified by the exact containment of the
sentence's shingles of two words in the window, since a few words may be exchanged; an exact check of facts follows: the
numbers and names of the sentence must stand there in its order, and enough of its other words with them.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import arrow, materialise, table

BANDS, ROWS = 64, 2
#: Share of a sentence's words that must stand in the document, in order; the rest may be exchanged.
CONTAINED = 0.75
#: Least words of a sentence that counts as material of an item, and words so common in the items that they tell nothing.
LEAST, COMMON = 6, 0.2
#: Share of a sentence's two-word shingles that must stand in the window: a fourth of its words exchanged breaks up to half of them.
SHINGLES = 0.5
#: Size of the bit tables that carry the words of items to every task.
BITS = 1 << 24
#: Up to this many sentences their bands go to every task, and documents are searched where they lie; beyond, the same bands meet by joins.
MOST_SENTENCES = 50_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[(?:b|i|/b|/i)\]")
_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def tokens(text: str | None) -> list[str]:
    """Words and numbers, apart from case, spacing, punctuation and markup."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", _TAG.sub(" ", html.unescape(text)))
    return [t.lower() for t in _TOKEN.findall(text)]


def size_class(n: int) -> int:
    """Windows of a sentence of n words have twice as many words as the next power of two."""
    return 2 * max(16, 1 << (n - 1).bit_length())


def bands(words) -> list[int]:
    """One hash per band of a set of words."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in sorted(set(words))], dtype=np.uint64)
    if not len(h):
        return []
    low = ((h[:, None] * _A + _B) >> np.uint64(20)).min(axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(low)]


class Words:
    """A set of words as bits: of fixed size, and sure of every word in it; of others it takes a few in as well."""

    def __init__(self, words):
        self.bits = np.zeros(BITS // 8, dtype=np.uint8)
        for w in words:
            h = xxhash.xxh64_intdigest(w) % BITS
            self.bits[h >> 3] |= 1 << (h & 7)
        self.seen: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        if (got := self.seen.get(word)) is None:
            h = xxhash.xxh64_intdigest(word) % BITS
            got = bool(self.bits[h >> 3] >> (h & 7) & 1)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def __getstate__(self):
        return {"bits": self.bits, "seen": {}}


def windows(words: list[str], size: int, known: set, least: int, names: set, least_names: int) -> list[dict]:
    """Windows of a document that could hold a sentence, as (no, words): they have enough of its kind's words and names.

    known and names are those words of the document that the items may have.
    """
    out = []
    if len(names) < least_names or len(known) < least:
        return out
    half = size // 2
    for no, start in enumerate(range(0, max(1, len(words) - half), half)):
        part = words[start : start + size]
        if len(part) >= LEAST:
            own = set(part)
            if len(own & known) >= least and len(own & names) >= least_names:
                out.append({"size": size, "no": no, "words": part})
    return out


def shingled(words: list[str], sentence: list[str]) -> bool:
    """Whether enough of a sentence's two-word shingles stand in a window."""
    own = set(zip(sentence, sentence[1:]))
    return len(own & set(zip(words, words[1:]))) >= SHINGLES * len(own)


def contains(words: list[str], sentence: list[str], facts: list[bool]) -> bool:
    """Whether the words hold the sentence: all its facts and enough of the rest, in its order, close together."""
    have = set(words)
    if not all(w in have for w, f in zip(sentence, facts) if f):
        return False
    # Longest common subsequence in which a fact weighs more than all other words, so that none is given up for others.
    n, weight = len(sentence), len(sentence) + 1
    row = [0] * (len(words) + 1)
    for w, f in zip(sentence, facts):
        gain, left, diagonal = (weight if f else 1), 0, 0
        new = [0] * (len(words) + 1)
        for j, x in enumerate(words, 1):
            best = row[j - 1] + gain if x == w else row[j]
            left = best if best > left else left
            if row[j] > left:
                left = row[j]
            new[j] = left
        row = new
    matched, rest = divmod(row[-1], weight)
    return matched == sum(facts) and matched + rest >= CONTAINED * n


def item_sentences(items: list[tuple[int, str]]) -> list[dict]:
    """The sentences of the items with their facts: numbers, and names (words that the items only have in capitals)."""
    parts = [(i, s) for i, text in items if text for s in _SENTENCE.split(text)]
    small = {w for _, s in parts for w in re.findall(r"\b[a-z]+\b", s)}
    inside = {w.lower() for _, s in parts for w in re.findall(r"(?<=\w[\s,] )\b[A-Z][a-z]+\b|(?<=[a-z0-9,] )\b[A-Z][a-z]+\b", s)}
    names = inside - small
    out, counts = [], {}
    for i, s in parts:
        words = tokens(s)
        if len(words) < LEAST:
            continue
        out.append({"item_id": i, "words": words, "facts": [w.isdigit() or w in names for w in words], "names": sorted({w for w in words if w in names})})
        for w in set(words):
            counts[w] = counts.get(w, 0) + 1
    for k, s in enumerate(out):
        s |= {"sentence": k, "size": size_class(len(s["words"])), "keys": sorted({w for w in s["words"] if counts[w] <= max(5, COMMON * len(out))})}
    return out


class Index:
    """Bands of sentences, to look windows up in."""

    def __init__(self, sentences: list[dict], known: Words, names: Words):
        self.sentences, self.known, self.names = sentences, known, names
        self.sizes = sorted({s["size"] for s in sentences})
        self.least = max(1, int(CONTAINED * min((len(s["keys"]) for s in sentences), default=0)))
        self.fewest = min((len(s["names"]) for s in sentences), default=0)
        self.facts = [frozenset(w for w, f in zip(s["words"], s["facts"]) if f) for s in sentences]
        self.buckets: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(sentences):
            for b in bands(s["keys"]):
                self.buckets.setdefault((s["size"], b), []).append(k)

    def items(self, text: str | None) -> list[int]:
        """The items of which a text holds a sentence."""
        words, out = tokens(text), set()
        own = set(words)
        known = set(filter(self.known.__contains__, own))
        names = set(filter(self.names.__contains__, own))
        for size in self.sizes:
            for w in windows(words, size, known, self.least, names, self.fewest):
                found = {k for b in bands(known.intersection(w["words"])) for k in self.buckets.get((size, b), ())}
                have = set(w["words"]) if found else set()
                for k in found:
                    s = self.sentences[k]
                    if s["item_id"] not in out and self.facts[k] <= have and shingled(w["words"], s["words"]) and contains(w["words"], s["words"], s["facts"]):
                        out.add(s["item_id"])
        return sorted(out)


def leaked_documents(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_sentences: int = MOST_SENTENCES) -> DataFrame:
    """(item_id, doc_id) of every document that holds a whole sentence of an item.

    Items are a set of evaluation items that the driver can hold. Null and empty texts on either side hold nothing, null
    ids are dropped, repeated rows count once, extra columns don't matter; documents of any length are read whole. Both
    ways of searching hash the same windows into the same bands and give the same rows.
    """
    spark = documents.sparkSession
    items = sorted({(r[0], r[1]) for r in benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator()})
    sentences = item_sentences(items)
    schema = "item_id bigint, words array<string>, facts array<boolean>, sentence int, size int, keys array<string>"
    asked = spark.createDataFrame([{k: v for k, v in s.items() if k != "names"} for s in sentences], schema)
    names = Words({w for s in sentences for w in s["names"]})
    known = Words({w for s in sentences for w in s["keys"]})
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text")).where(F.col("doc_id").isNotNull() & (F.length("__text") > 0))
    if len(sentences) <= most_sentences:
        index = spark.sparkContext.broadcast(Index(sentences, known, names))
        held = docs.select("doc_id", F.explode(arrow(lambda t: index.value.items(t), "array<bigint>", "__text")).alias("item_id"))
        return held.select("item_id", "doc_id").distinct()
    shared = spark.sparkContext.broadcast((known, sorted({s["size"] for s in sentences}), min((len(s["keys"]) for s in sentences), default=0), names, min((len(s["names"]) for s in sentences), default=0)))

    def cut(text):
        words, (keep, sizes, least, own, fewest) = tokens(text), shared.value
        every = set(words)
        known, names = set(filter(keep.__contains__, every)), set(filter(own.__contains__, every))
        return [w for size in sizes for w in windows(words, size, known, max(1, int(CONTAINED * least)), names, fewest)]

    held = materialise(docs.select("doc_id", F.explode(arrow(cut, "array<struct<size:int,no:int,words:array<string>>>", "__text")).alias("w")).select("doc_id", "w.*"))

    def keys(words):
        keep = shared.value[0]
        return bands([w for w in words if w in keep])

    hashed = held.select("doc_id", "no", "size", F.posexplode(arrow(keys, "array<bigint>", "words")).alias("band", "hash"))
    wanted = asked.select("sentence", "size", F.posexplode(arrow(bands, "array<bigint>", "keys")).alias("band", "hash"))
    pairs = hashed.join(wanted, ["size", "band", "hash"]).select("doc_id", "size", "no", "sentence").distinct()
    checked = pairs.join(held, ["doc_id", "size", "no"]).join(asked.select("sentence", "item_id", F.col("words").alias("said"), "facts"), "sentence")
    sure = arrow(lambda w, s, f: shingled(list(w), list(s)) and bool(contains(list(w), list(s), list(f))), "boolean", "words", "said", "facts")
    return checked.where(sure).select("item_id", "doc_id").distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a whole sentence of a benchmark item, with the item."""
    return leaked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
