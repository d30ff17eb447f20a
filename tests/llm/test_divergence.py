"""Source divergence against a dense computation with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from corpusgauge.llm import divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dense(rows, min_docs, top=50):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        own = sorted(s for g, s in groups if g == lang)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, n) for n, (v, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(n=160):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("Ärger", "tree", "ßa", "日本", "x×", "Zoo") for b in "abcdefgh"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["de", "en", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "ä"])
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choices(words, [1 + (i + len(source or "")) % 9 for i in range(len(words))], k=rng.randrange(30)))
        rows.append((lang, source, rng.choice([text, text, text, "", None])))
    return [*rows, ("fr", "only", "un deux"), ("fr", "none", None), ("it", "alone", "uno")]


@pytest.mark.parametrize("blocks, chunks, held", [(1_024, 256, 400_000), (5, 2, 40)])
def test_against_dense(spark, monkeypatch, blocks, chunks, held):
    monkeypatch.setattr(D, "BLOCK_TERMS", blocks)
    monkeypatch.setattr(D, "CHUNK_GROUPS", chunks)
    monkeypatch.setattr(D, "MOST_ROWS", held)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = dense(rows, 12)
    assert {w[2] for w in want} == {"pair", "term"}
    assert got(D.divergence(df, min_docs=12)) == want


def test_long_text_in_pieces(monkeypatch):
    text = "Ab cd-EFé " * 500
    whole = D.text_terms(text)
    monkeypatch.setattr(D, "STEP_BYTES", 7)
    assert D.text_terms(text) == whole == {b"ab": 500, b"cd": 500, "efé".encode(): 500}


def test_odd_rows(spark, odd, odd_rows, nothing):
    df = odd.withColumn("lang", odd["key"]).withColumn("source", odd["host"]).withColumn("term", odd["key"]).withColumn("p", odd["key"])
    want = dense([(s, s, t) for _, t, s in odd_rows], 2)
    assert got(D.divergence(df, min_docs=2)) == want
    assert D.divergence(df.where("1 = 0")).count() == 0
