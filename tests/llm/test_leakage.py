import pytest

from cardloom.llm import leakage as L

ITEM = "Entry to Rasmere costs 90 pennies for every 87 tubs, but Dunshaw wants only 92 for the last 106 of damp candles. A barge leaves Yarshaw at 5:59 with 257 sacks of finest slate tiles and ties up at Ulmcombe after 99 locks."
ONE, TWO = ITEM.split(". ")[0] + ".", ITEM.split(". ")[1]
FILL = "nothing to see in these words at all, "


@pytest.mark.parametrize("most", [1000, 0])
def test_leaks_against_brute_force(spark, most):
    texts = {
        1: ONE, 2: FILL * 40 + TWO.upper() + FILL * 30, 3: "<p>" + ONE.replace(" ", "&nbsp;\n") + "</p>", 4: ONE.replace("wants only", "asks merely"), 5: ONE.replace("90", "91"), 6: ONE.replace("Dunshaw", "Selshaw"),
        7: " ".join(ONE.split()[:9]), 8: "", 9: None, 10: FILL * 2000, 11: "Entry to Ulmcombe costs 90 pennies for every 87 tubs, but Yarshaw wants only 92 for the last 106 of damp candles.",
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(1, ONE, 0), (None, ONE, 0)], "doc_id bigint, text string, size int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (None, ITEM), (9, "")], "item_id bigint, text string")
    got = sorted(tuple(r) for r in L.leaked_documents(docs, items, most_sentences=most).collect())
    sentences = L.item_sentences([(7, ITEM)])
    brute = sorted((7, i) for i, t in texts.items() if any(L.contains(L.tokens(t), s["words"], s["facts"]) for s in sentences))
    assert got == brute == [(7, 1), (7, 2), (7, 3), (7, 4)]


def test_recall_of_both_ways_on_the_documents(spark):
    """Against brute force over all pairs of sentence and document that share a name or number of the sentence."""
    import pandas as pd

    docs, items = (pd.read_parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    sentences = L.item_sentences(sorted({(int(i), t) for i, t in zip(items.item_id, items.text)}))
    brute = set()
    for i, text in zip(docs.doc_id, docs.text):
        words = L.tokens(text)
        have = set(words)
        for s in sentences:
            if all(w in have for w, f in zip(s["words"], s["facts"]) if f) and L.contains(words, s["words"], s["facts"]):
                brute.add((s["item_id"], int(i)))
    args = spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(items[["item_id", "text"]])
    ways = [{tuple(r) for r in L.leaked_documents(*args, most_sentences=most).collect()} for most in (1000, 0)]
    assert ways[0] == ways[1] and len(ways[0] & brute) >= 0.99 * len(brute) and len(brute) > 10


def test_words_as_bits():
    words = L.Words(["ab", "cd"])
    assert "ab" in words and "cd" in words and sum(f"x{i}" in words for i in range(20_000)) == 0


def test_empty_tables(spark):
    docs, items = "doc_id bigint, text string", "item_id bigint, text string"
    assert L.leaked_documents(spark.createDataFrame([(1, ONE)], docs), spark.createDataFrame([], items)).count() == 0
    assert L.leaked_documents(spark.createDataFrame([], docs), spark.createDataFrame([(1, ITEM)], items)).count() == 0
