from __future__ import annotations

import random

from pyspark.sql import functions as F

from quiverlake.llm.leaks import ItemAutomaton, leaked_items, placed_words, without_leaks, words
from tests.conftest import rows


def brute(docs, items, n):
    grams = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in items}
    return {(d, i) for d, w in docs for i, g in grams.items() if any(tuple(w[k : k + n]) in g for k in range(len(w) - n + 1))}


def test_equals_brute_force():
    rng = random.Random(1)
    for n in (2, 3, 5):
        items = [(i, [rng.choice("abcd") for _ in range(rng.randrange(12))]) for i in range(30)]
        docs = [(d, [rng.choice("abcde") for _ in range(rng.randrange(40))]) for d in range(80)]
        a = ItemAutomaton(items, n)
        assert {(d, i) for d, w in docs for i in a.leaked(w)} == brute(docs, items, n)
        for _, w in docs:
            hit = [False] * len(w)
            for i, j in a.spans(w):
                hit[i:j] = [True] * (j - i)
            want = [False] * len(w)
            for _, iw in items:
                grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in grams:
                        want[k : k + n] = [True] * n
            assert hit == want


def test_words():
    assert words("Ｆｕｌｌ－width ﬁre, STRASSE!") == ["full", "width", "fire", "strasse"]
    assert words("so­ft zero​width a_b") == ["soft", "zerowidth", "a", "b"]
    assert words("été") == words("été") and words(None) == words("") == words(" ​") == []
    t = "  Ｅné so­ft — x"
    assert [t[a:b] for _, a, b in placed_words(t)] == ["Ｅné", "so­ft", "x"]


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_tables(spark):
    docs = [
        (1, "before " + ITEM.upper().replace(" ", ",  ") + " after and some more words that stay in this text for sure yes"), (2, " ".join(ITEM.split()[1:10])), (3, None), (4, ""),
        (5, " ".join(ITEM.split()[2:])), (5, " ".join(ITEM.split()[2:])), (6, "word " * 5000 + ITEM),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, ITEM), (8, ITEM + " thirteen"), (8, ITEM), (9, "too short"), (None, ITEM), (10, None)], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    want = sorted([(1, 7), (1, 8), (5, 7), (5, 8), (5, 7), (5, 8), (6, 7), (6, 8)], key=repr)
    assert rows(leaked_items(d, items)) == want
    assert rows(leaked_items(d, items, max_item_chars=70).distinct()) == sorted(set(want), key=repr)
    assert rows(leaked_items(d.limit(0), items)) == rows(leaked_items(d, items.limit(0))) == []
    clean = {r["doc_id"]: r for r in without_leaks(d, items).collect()}
    assert clean[1]["n_leaked"] == 12 and not clean[1]["dropped"] and clean[1]["clean_text"] == "before  after and some more words that stay in this text for sure yes"
    assert clean[5]["dropped"] and clean[5]["clean_text"] is None
    assert clean[2]["clean_text"] == docs[1][1] and clean[3]["clean_text"] is None and clean[4]["clean_text"] == ""
    parts = {r["doc_id"]: tuple(r) for r in without_leaks(d, items, max_item_chars=70).collect()}
    assert parts == {k: tuple(r) for k, r in clean.items()} and without_leaks(d, items, max_item_chars=70).count() == len(docs)
