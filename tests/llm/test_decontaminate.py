import random

import pytest

from corpusgauge.llm import decontaminate as D


def plain(text, items, slack=0):
    words, hit, found = D.words_of(text), set(), set()
    for number, item in items:
        own = D.words_of(item)
        width = min(10, len(own))
        for a in range(len(own) - width + 1 if own else 0):
            for p in range(len(words) - width + 1):
                if words[p : p + width] == own[a : a + width]:
                    hit.update(range(p, p + width))
                    found.add(number)
    return len(words), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block", [200_000, 30])
def test_equals_brute_force(spark, odd_rows, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(3)
    voc = ["a", "b", "c", "dé", "e1"]
    docs = [(i, " ".join(rng.choices(voc, k=rng.randint(0, 60)))) for i in range(120)] + [(8, "A,B;c")] + [(i, t) for i, t, _ in odd_rows]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(0, 9)))) for i in range(8)] + [(101, None), (102, "  ")]
    items += [(200 + i, docs[i][1]) for i in range(5)] + [(300, odd_rows[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = D.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(set(r["items"]) <= set(r["near_items"]) for r in rows)
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])))) for r in rows)
    assert got == sorted(str((i, *plain(t, items))) for i, t in docs)


@pytest.mark.parametrize("block", [200_000, 3])
def test_repeated_and_null_item_ids_are_listed_once(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    items = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "a b c"), (None, "g h i"), (2, "x y")]
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "g h i"), (3, "z")], "doc_id long, text string")
    rows = D.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    for kind in ("items", "near_items"):
        assert {r.doc_id: sorted(r[kind], key=str) for r in rows} == {1: [1, None], 2: [None], 3: []}


def test_near_matches_allow_shifted_words(spark):
    item = "one two three four five six seven eight nine ten"
    near = "one two three extra four five six seven eight nine ten"
    rows = D.matches(
        spark.createDataFrame([(1, near), (2, "ten nine"), (3, item)], "doc_id long, text string"),
        spark.createDataFrame([(9, item)], "item_id long, text string"),
    ).collect()
    found = {r.doc_id: (list(r["items"]), list(r["near_items"])) for r in rows}
    assert found == {1: ([], [9]), 2: ([], []), 3: ([9], [9])}


def test_empty_tables(spark, odd, nothing, odd_rows):
    tests = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.matches(nothing, tests).count() == 0
    rows = D.matches(odd, tests.where("1 = 0")).collect()
    assert len(rows) == len(odd_rows) and all(r.n_hit == 0 for r in rows)
