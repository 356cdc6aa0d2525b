"""The language of each document and of each segment, with a confidence, whatever its label says.

Nearest centroid: texts are vectors of character n-grams, weighted by TF-IDF and scaled to length one; every language
has several centroids, found by clustering its samples; a segment takes the language of the nearest by cosine, and none
if all are too far or two languages are about as near. Segments are sentences of the main body.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow, bounded_sample, field_values, materialise, table
from .encoding import damaged_values
from .residue import residue_values
from .texttype import main_texts, noted_renders, text_types

#: Centroids per language, longest n-gram; a sure answer needs this share of the cosine that a language's own sentences have at least when held out, and a lead of this share of its cosine.
CENTROIDS, GRAMS, NEAREST, LEAD = 4, 4, 0.5, 0.1
#: Words of a segment whose language can be told; three East Asian characters count as one.
SHORTEST = 2
#: Samples that the centroids are fitted on at most.
MOST_SAMPLES = 20_000

# Names and codes under which a label may name a language, lower case.
SPELLINGS = {
    "en": "en eng english inglés anglais englisch 영어 英語", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues",
    "ko": "ko kor korean 한국어", "ja": "ja jpn japanese 日本語 jp",
}
_LABELS = {name: code for code, names in SPELLINGS.items() for name in names.split()}
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?](?![\w])|[。！？]|\n|$)[\"”’»」』)]*")
_STOP = re.compile(r"[.!?。！？][\"”’»」』)]*\s*$")
_WORDS = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_QUOTE = re.compile(r"[“«„「『\"]")
_QUOTED = re.compile(r"[“«„「『\"][^”»“」』\"]{0,200}[”»“」』\"]")


def label_code(label: Column) -> Column:
    """The language that a label names; null for a missing label or one that names none."""
    codes = F.create_map(*[F.lit(x) for pair in sorted(_LABELS.items()) for x in pair])
    return F.try_element_at(codes, F.regexp_extract(F.lower(F.trim(label)), "^([^_-]*)", 1))


def _word_grams(word: str) -> Counter:
    """The character n-grams of a word between its spaces."""
    w = f" {word} "
    return Counter(w[i : i + n] for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " ")


def grams(text: str) -> Counter:
    out: Counter = Counter()
    for w in _WORDS.findall(text.lower()):
        out.update(_word_grams(w))
    return out


class Centroids:
    """Several centroids per language over the TF-IDF vectors of its samples' n-grams, all of length one."""

    def __init__(self, samples: list[tuple[str, str]], seed: int = 1, calibrate: bool = True):
        samples = sorted(set(samples))
        counts = [grams(t) for _, t in samples]
        df = Counter(g for c in counts for g in c)
        self.index = {g: i for i, g in enumerate(sorted(df))}
        self.idf = np.array([math.log((1 + len(samples)) / (1 + df[g])) + 0.3 for g in sorted(df)])
        #: Weight of an n-gram that no sample has.
        self.unseen = math.log(1 + len(samples)) + 0.3
        self.langs: list[str] = []
        rows = []
        for lang in sorted({x for x, _ in samples}):
            own = np.array([self.dense(c) for (x, _), c in zip(samples, counts) if x == lang])
            for centre in _cluster(own, min(CENTROIDS, len(own)), zlib.crc32(lang.encode()) + seed):
                rows.append(centre)
                self.langs.append(lang)
        self.matrix = np.array(rows).T if rows else np.zeros((0, 0))
        #: The languages by name, and where the centroids of each begin.
        self.names = sorted(set(self.langs))
        self.bounds = [self.langs.index(x) for x in self.names]
        self.forget()
        self.floor: dict[str, float] = {}
        if calibrate:
            half = Centroids(samples[::2], seed, False)
            for lang, text in samples[1::2]:
                for s in filter(lambda s: size(s) >= 4, sentences(text)):
                    words = _WORDS.findall(s.lower())
                    if words and lang in half.names and (near := half.cosines([words])[0, half.names.index(lang)]):
                        self.floor[lang] = min(self.floor.get(lang, 1.0), NEAREST * float(near))

    def dense(self, counts: Counter) -> np.ndarray:
        out = np.zeros(len(self.index))
        for g, n in counts.items():
            if g in self.index:
                out[self.index[g]] = n * self.idf[self.index[g]]
        return out / max(float(np.linalg.norm(out)), 1e-12)

    def number(self, word: str) -> int:
        """The number of a word: its dot products with all centroids, and its n-grams by number with their weights, are kept under it, as words recur.

        N-grams that no sample has get numbers from a hash, beyond those of the index.
        """
        counts = _word_grams(word)
        known = [(self.index[g], n) for g, n in counts.items() if g in self.index]
        lost = [(len(self.index) + zlib.crc32(g.encode()), n * self.unseen) for g, n in counts.items() if g not in self.index]
        i = np.array([k for k, _ in known], dtype=np.int64)
        w = np.array([n for _, n in known], dtype=float) * self.idf[i] if known else np.zeros(0)
        row, end = len(self.seen), self.used + len(counts)
        if row == len(self.first):
            self.first, self.count, self.dots = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.count, self.dots))
        while end > len(self.at):
            self.at, self.weight = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.weight))
        self.dots[row] = w @ self.matrix[i] if known else 0.0
        self.at[self.used : end] = np.concatenate([i, np.array([k for k, _ in lost], dtype=np.int64)])
        self.weight[self.used : end] = np.concatenate([w, np.array([x for _, x in lost])])
        self.first[row], self.count[row], self.used = self.used, len(counts), end
        self.seen[word] = row
        return row

    def forget(self) -> None:
        """Starts anew with no words kept."""
        self.seen: dict[str, int] = {}
        self.used = 0
        self.first, self.count, self.dots = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), np.zeros((256, len(self.langs)))
        self.at, self.weight = np.zeros(4096, dtype=np.int64), np.zeros(4096)

    def nearest(self, text: str) -> tuple[str | None, float]:
        """Language and confidence; None where every centroid is too far or two languages are about as near."""
        return self.nearest_all([_WORDS.findall(text.lower())])[0]

    def nearest_all(self, texts: list[list[str]]) -> list[tuple[str | None, float]]:
        """The same for several texts, given by their words in small letters."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        if not self.langs or not any(texts):
            return out
        best = self.cosines(texts)
        first = best.argmax(axis=1)  # of equal ones the first by name
        top = best[np.arange(len(best)), first]
        second = np.zeros(len(best))
        if len(self.names) > 1:
            best[np.arange(len(best)), first] = -np.inf
            second = best.max(axis=1)
        for k, i, high, low in zip((k for k, words in enumerate(texts) if words), first.tolist(), top.tolist(), second.tolist()):
            lang, lead = self.names[i], high - low
            sure = round(min(1.0, max(0.0, lead / max(high, 1e-9))), 4)
            out[k] = (lang if high >= self.floor.get(lang, 0.0) and lead >= LEAD * high else None, sure)
        return out

    def spoken(self, texts: list[list[str]]) -> dict[str, float]:
        """The languages that nearest_all gives to several texts, with the greatest confidence of each.

        Confidence needs no length, as it is a share; the floor does. So the texts of a language are held against it by
        falling confidence, and only until one passes.
        """
        texts = [words for words in texts if words]
        if not self.langs or not texts:
            return {}
        best = np.maximum.reduceat(self._sums(texts)[0], self.bounds, axis=1)
        first = best.argmax(axis=1)
        top = best[np.arange(len(best)), first]
        best[np.arange(len(best)), first] = -np.inf if len(self.names) > 1 else 0.0
        share = (top - best.max(axis=1)) / np.maximum(top, 1e-12)
        out: dict[str, float] = {}
        left = first.copy()
        # What is as near to the lead as rounding goes is left to nearest_all, too.
        for k in np.argsort(-share, kind="stable").tolist():
            if left[k] < 0 or 0.0 < top[k] and share[k] < LEAD - 1e-9:
                continue
            lang, sure = self.nearest_all([texts[k]])[0]
            if lang is not None:
                out[lang] = max(sure, out.get(lang, 0.0))
                left[left == first[k]] = -1
        return out

    def _sums(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dot products of texts, each of which has words, with all centroids; the numbers of all words; how many each text has."""
        if len(self.seen) > 100_000:
            self.forget()
        flat = [w for words in texts for w in words]
        found = list(map(self.seen.get, flat))
        if None in found:
            found = [self.number(w) if (row := self.seen.get(w)) is None else row for w in flat]
        rows, words = np.array(found), np.array([len(words) for words in texts])
        return np.add.reduceat(self.dots[rows], np.cumsum(words) - words, axis=0), rows, words

    def cosines(self, texts: list[list[str]]) -> np.ndarray:
        """Cosine with the nearest centroid of each language in names, a row for each text that has words."""
        texts = [words for words in texts if words]
        total, rows, words = self._sums(texts)
        begin = np.cumsum(words) - words
        # The length of each sum: equal n-grams of several words of a text are added up before they are squared.
        count = self.count[rows]
        place = np.arange(count.sum()) + np.repeat(self.first[rows] - (np.cumsum(count) - count), count)
        at, weight = self.at[place], self.weight[place]
        own = np.add.reduceat(count, begin)
        key = (np.repeat(np.arange(len(texts)), own) << 34) + at
        order = key.argsort(kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(weight[order], starts)
        ends = np.searchsorted(starts, np.cumsum(own)).tolist()
        length = np.sqrt([float((x := sums[a:b]) @ x) for a, b in zip([0, *ends], ends)])
        return np.maximum.reduceat(total / np.maximum(length, 1e-12)[:, None], self.bounds, axis=1)


def _cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; centres of length one."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(12):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.array([x[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text in order; none is left out for being short."""
    return [p for m in _SENTENCE.finditer(text) if (p := m[0].strip())]


def is_whole(part: str) -> bool:
    """Whether a stop ends it."""
    return _STOP.search(part) is not None


def size(text: str) -> float:
    if text.isascii():
        return len(_WORDS.findall(text))
    east = len(_CJK.findall(text))
    return len(_WORDS.findall(_CJK.sub(" ", text))) + east / 3


def _speaking(found: list[str]) -> tuple[list[float], list[list[str]]]:
    """The size of each sentence, and the words that speak for it: what stands in quotation marks does not."""
    sizes, spoken = [], []
    for s in found:
        words = _WORDS.findall(s.lower())
        sizes.append(len(words) if s.isascii() or _CJK.search(s) is None and "İ" not in s else size(s))
        if _QUOTE.search(s) and (bare := _QUOTED.sub(" ", s)) != s and size(bare) >= 3:
            words = _WORDS.findall(bare.lower())
        spoken.append(words)
    return sizes, spoken


def judged_segments(body: str, model: Centroids, whole: bool = False) -> list[dict]:
    """Sentences and lines of a body with language and confidence, and whether they are whole sentences; with whole, only those that are.

    What stands in quotation marks does not speak for its sentence. What is under SHORTEST words is too short to tell.
    """
    found = sentences(body)
    if whole:
        found = [s for s in found if is_whole(s)]
    sizes, spoken = _speaking(found)
    return [{"segment": s, "lang": lang if n >= SHORTEST else None, "confidence": sure, "whole": whole or is_whole(s)} for s, n, (lang, sure) in zip(found, sizes, model.nearest_all(spoken))]


def spoken_languages(body: str, model: Centroids) -> dict[str, float]:
    """The languages of the whole sentences of a body, with the greatest confidence of each: what judged_segments says, without its segments."""
    sizes, spoken = _speaking([s for s in sentences(body) if is_whole(s)])
    return model.spoken([words for n, words in zip(sizes, spoken) if n >= SHORTEST])


def fitted(samples: DataFrame) -> Centroids:
    rows = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").distinct()
    return Centroids([(r["lang"], r["text"]) for r in bounded_sample(rows, MOST_SAMPLES, samples.count(), "lang", "text")])


SEGMENTS = "array<struct<segment:string,lang:string,confidence:double,whole:boolean>>"


def language_segments(bodies: DataFrame, samples: DataFrame, *, texts: bool = True) -> DataFrame:
    """(render_id, segments) of each main body: its sentences in order, with language and confidence.

    Without texts the segments are one per language of a whole sentence, without their wording. Null and empty bodies have none, repeated
    rows count once; extra columns don't matter; texts are read whole.
    """
    model = bodies.sparkSession.sparkContext.broadcast(fitted(samples))

    def run(body):
        if texts:
            return judged_segments(body, model.value) if body else []
        return [{"segment": None, "lang": x, "confidence": sure, "whole": True} for x, sure in sorted(spoken_languages(body, model.value).items())] if body else []

    rows = bodies.select("render_id", arrow(run, SEGMENTS, "body").alias("segments"))
    return rows.dropDuplicates(["render_id"]) if texts else rows.groupBy("render_id").agg(F.max("segments").alias("segments"))


def corrected_languages(segments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(render_id, lang) of renders whose label is missing, names no language or a wrong one, or that mix languages.

    One row per language of a whole sentence. Renders without a snapshot have no label.
    """
    langs = segments.where(F.col("segments").isNotNull()).select("render_id", F.array_distinct(F.transform(F.filter("segments", lambda s: s["whole"] & s["lang"].isNotNull()), lambda s: s["lang"])).alias("langs")).where(F.size("langs") > 0)
    labels = snapshots.where(F.col("render_id").isNotNull()).select("render_id", label_code(F.col("lang_label")).alias("label")).groupBy("render_id").agg(F.max("label").alias("label"))
    both = langs.join(labels, "render_id", "left")
    return both.where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.coalesce("label", F.lit("")))).select("render_id", F.explode("langs").alias("lang"))


def p4_segments(spark, sf_dir: str) -> DataFrame:
    """Every sentence of every main body with its language and confidence."""
    found = language_segments(main_texts(table(spark, sf_dir, "render_results")), table(spark, sf_dir, "language_samples"))
    return found.select("render_id", F.posexplode("segments").alias("segment_no", "s")).select("render_id", "segment_no", "s.segment", "s.lang", "s.confidence", "s.whole")


def p4_found(spark, sf_dir: str) -> DataFrame:
    """Renders with a missing or wrong label or several languages, and the languages of their sentences.

    Renders that hold residue, are no prose or are decoded wrongly are left out by the verdicts of those operators.
    """
    renders, cards, quality, words, samples, snapshots = (table(spark, sf_dir, t) for t in ("render_results", "cards", "quality_cases", "common_words", "language_samples", "snapshots"))
    noted = materialise(noted_renders(residue_values(cards, renders)))
    bodies = materialise(main_texts(renders))
    found = materialise(corrected_languages(language_segments(bodies.join(noted, "render_id", "left_anti"), samples, texts=False), snapshots))
    kinds = text_types(bodies, noted, quality, words)
    other = kinds.where((F.col("source_table") == "render_results") & (F.col("kind") != "prose")).select(F.col("row_key").cast("bigint").alias("render_id"))
    asked = found.select(F.lit("render_results").alias("source_table"), F.col("render_id").alias("row_id"), F.lit("text").alias("field_name"))
    garbled = damaged_values(field_values(spark, sf_dir), only=asked).select(F.col("row_id").alias("render_id"))
    return found.join(other.unionByName(garbled), "render_id", "left_anti")
