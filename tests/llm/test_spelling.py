"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from corpusgauge.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def brute(counts):
    links, out = {}, {}
    for w, n in counts.items():
        mates = [x for x in counts if near(w, x)]
        best = min(mates, key=lambda x: (-counts[x], x), default=None)
        links[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = len(mates)
    found = set()
    for w, n in counts.items():
        root = w
        while links[root] is not None:
            root = links[root]
        found.add((w, links[w], root, n, out[w], None if links[w] is None else counts[links[w]]))
    return found


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    rng = random.Random(9)
    words = ["aaaaaa", "aaaaaaa", "ärgerlich", "Banane", "colour", "color", "colours", "straße", "strasse", "naïveté", "letter", "lettre", "littre", "latter", "battery", "÷÷÷÷÷÷", "××××××"]
    words += ["".join(rng.choices("abcé", k=rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        bits = [rng.choice([*words[: 1 + i % len(words)], *words]) for _ in range(rng.randrange(60))]
        bits = [w[:k] + rng.choice(["", "z", "é"]) + w[k + 1 :] if rng.random() < 0.1 else w for w in bits for k in [rng.randrange(len(w))]]
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "1", "€", "\n", "日"]).join(bits)))
    return [*rows, (1000, "Colour " * 300 + "Colours " * 40 + "Coloursi " * 6)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_WORDS", 30)
    monkeypatch.setattr(S, "STEP_BYTES", 50)
    monkeypatch.setattr(S, "PASS_WORDS", 20)
    rows = corpus()
    want = brute(counted(rows))
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)
    assert got(S.variants(S.frequent_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))) == want


def test_checksums_by_parts():
    words = [w.encode("latin-1") for w in ("a", "colour", "straße", "é" * 32, "é" * 33, "z" * 64, "y" * 200)]
    held = S.Words(one_in=1)
    starts = [zlib.crc32(f"{d}:".encode()) for d in (0, 5, 10**12)]
    held.count(words * 3, starts, [len(words)] * 3)
    want = Counter()
    for start in starts:
        for w in words:
            h = zlib.crc32(w.decode("latin-1").encode(), start)
            want[w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert dict(held.totals()) == want


def test_signatures_meet_and_select():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñ", k=rng.randrange(6, 14))) for _ in range(400)]
    edits = []
    for w in words:
        k = rng.randrange(len(w))
        edits.append((w, w[:k] + "x" + w[k + 1 :], w[:k] + w[k + 1 :]))
    whole, replaced, shorter = zip(*edits)
    share = lambda a, b: (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    equal = [S.signatures(list(x), S.REPLACED, 2) for x in (whole, replaced)]
    assert share(equal[0][0], equal[1][0]).all()
    assert (np.bitwise_count(equal[0][1] ^ equal[1][1]) <= 2).all()
    longer = S.signatures(list(whole), S.INSERTED, 1, shorter=1)
    less = S.signatures(list(shorter), S.INSERTED, 1)
    assert share(longer[0], less[0]).all() and (np.bitwise_count(longer[1] ^ less[1]) <= 1).all()
    others = np.roll(equal[0][0], 7, axis=0)
    assert share(equal[0][0], others).mean() < 0.05


def test_chain_of_forms(spark):
    rows = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("zzzzzz", 9), ("zzzzzzz", 44)]
    found = {r.word: (r.form, r.root) for r in S.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found["aaaaaa"] == ("aaaaab", "aaabbb") and found["aaabbb"] == (None, "aaabbb") and found["zzzzzz"] == (None, "zzzzzz")


def test_odd_rows(spark, odd, odd_rows, nothing):
    long = "Verylongword" * 30_000
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(9, f"{long} {long} {long}x {long} {long} {long}")], "doc_id long, text string"))
    rows = [(i, t) for i, t, _ in odd_rows] + [(9, f"{long} {long} {long}x {long} {long} {long}")]
    assert got(S.variants(S.frequent_words(df))) == brute(counted(rows))
    assert got(S.variants(S.frequent_words(odd.withColumn("word", odd["key"]).withColumn("n", odd["key"])))) == brute(counted([(i, t) for i, t, _ in odd_rows]))
    assert S.variants(S.frequent_words(nothing)).count() == 0
