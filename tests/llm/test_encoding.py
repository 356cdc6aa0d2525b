import pytest
from pyspark.sql import functions as F

from cardloom.llm import encoding as E

SOUND = ["Le dépôt de tramways prête les repères de crue et répare les volets peints à côté du moulin.", "Die Brücke über dem alten Kai schützt die Fensterläden.", "A razão é simples: a estação mede três barcos.", "駅の裏で気象観測所は手描きの地図を測っている。", "The café next door keeps a copy — “cash only”."]
VALUES = "source_table string, row_id bigint, field_name string, text string, word string"


def garbled(text, true, seen):
    return text.encode(true).decode(seen, "replace")


@pytest.fixture(scope="module")
def found(spark):
    bad = [garbled(SOUND[0], "utf-8", "latin-1"), garbled(SOUND[1], "cp1252", "mac_roman"), garbled(SOUND[2], "utf-8", "cp1251"), garbled(SOUND[3], "utf-8", "latin-1"), garbled(SOUND[4], "utf-8", "mac_roman")]
    fine = ["Every Ã© on the old printouts was once a é, says the archivist.", "Seeing “√§” in place of “ä” is how we noticed.", "ÂMBAR E LIMÕES – À L’ÂGE DE RAISON", "cut in a char�", "", None]
    rows = [("cards", i, "title", t, "x") for i, t in enumerate(SOUND * 30)] + [("cards", 1000 + i, "title", t, "x") for i, t in enumerate(bad)] + [("cards", 2000 + i, "title", t, "x") for i, t in enumerate(fine)] + [("cards", 1000, "title", bad[0], "x")]
    values = spark.createDataFrame(rows, VALUES)
    got = E.damaged_values(values).join(values.drop("word").distinct(), ["source_table", "row_id", "field_name"])
    return {r.row_id: E.restore(r.text, [w.asDict() for w in r.words]) for r in got.collect()}


def test_damaged_values_are_found_once_and_sound_ones_left(found):
    assert sorted(found) == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("i", range(5))
def test_round_trip(found, i):
    assert found[1000 + i] == SOUND[i]


def test_only_some_values_are_judged_by_the_counts_of_all(spark):
    bad = garbled(SOUND[1], "cp1252", "mac_roman")
    rows = [("cards", i, "title", t, "x") for i, t in enumerate(SOUND * 30)] + [("cards", 1000 + i, "title", bad, "x") for i in range(3)]
    values = spark.createDataFrame(rows, VALUES)
    only = spark.createDataFrame([("cards", 1001, "title"), ("cards", 3, "title"), ("cards", 1001, "title")], "source_table string, row_id bigint, field_name string")
    every = {r.row_id: r.words for r in E.damaged_values(values).collect()}
    some = {r.row_id: r.words for r in E.damaged_values(values, only=only).collect()}
    assert set(every) == {1000, 1001, 1002} and some == {1001: every[1001]}


def test_lost_characters_are_read_by_the_words_of_the_corpus(spark):
    lost = "f\ufffdr die Br\ufffdcke"
    rows = [("cards", i, "title", "für die Brücke", "x") for i in range(20)] + [("cards", 100, "title", lost, "x")]
    got = E.restored_values(spark.createDataFrame(rows, VALUES)).collect()
    assert [(r.row_id, r.restored) for r in got] == [(100, "für die Brücke")]


def test_a_hot_word_gives_the_same_as_any(spark, monkeypatch):
    bad = garbled(SOUND[1], "cp1252", "mac_roman")
    values = spark.createDataFrame([("cards", i, "title", t, "x") for i, t in enumerate(SOUND * 20)] + [("cards", 1000 + i, "title", bad, "x") for i in range(30)], VALUES)
    few = {(r.row_id, str(r.words)) for r in E.damaged_values(values).collect()}
    monkeypatch.setattr(E, "HOT_SHARE", 10.0)
    assert few == {(r.row_id, str(r.words)) for r in E.damaged_values(values).collect()} and len(few) == 30


def test_empty(spark):
    assert E.damaged_values(spark.createDataFrame([], VALUES)).count() == 0


def test_lattice_reads_lost_bytes():
    lattice = E.Lattice({c: n for n, c in enumerate("古い波止場で夜éüA", 5)})
    shown = E.CHANNELS["utf-8 as cp1252, bytes lost"]
    word = "".join(map(shown, "古い波止場"))
    assert lattice.read(word, E.NAMES.index("utf-8 as cp1252, bytes lost"))[0][1] == "古い波止場"


def test_tally_is_that_of_single_characters_and_words():
    from collections import Counter

    import pandas as pd

    texts = ["Ã© b\tc\r\nÃ©.", "&eacute;t&eacute; x&amp;y", "caf\ufffd, “č”\u3000z", "plain", "\ud83d\ude00 \ud800", "日本 の"]
    got, none = E._tally(iter([pd.DataFrame({"__text": texts}), pd.DataFrame({"__text": []})]))
    assert none.empty
    assert dict(zip(got.key[got.char], got.n[got.char])) == Counter("".join(texts))
    assert dict(zip(got.key[~got.char], got.n[~got.char])) == Counter(w for t in texts for w in E.split_words(t) if E._ODD.search(w))
    lossy = E.CHANNELS[E.LOSSY]
    assert [E.shape(w) for w in ("café", "naïve“", "č", "plain", "caf\ufffd")] == ["".join(map(lossy, "café")), "".join(map(lossy, "naïve“")), None, None, None]
