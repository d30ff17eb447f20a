"""Draws of exact size, and the backoff model's probabilities."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import backoff, draws


def population(n=700):
    rng = random.Random(6)
    rows = [(i * 7919 - 2000 if i % 50 else -i, rng.choice("ab"), rng.choice("xyz"), rng.gauss(10, 3)) for i in range(n)]
    return rows + rows[:3] + [(None, "a", "x", 1.0), (5, "a", "x", None), (6, None, "x", 2.0)]


SCHEMA = "k long, g string, c string, v double"


def smallest(rows, salt, size):
    """Rows (k, ..., v) with the smallest hashes; equal hashes by key and value."""
    h = draws.mixed(draws.key_hash(np.array([r[0] for r in rows], np.int64)) ^ salt)
    return [rows[i] for i in sorted(range(len(rows)), key=lambda i: (int(h[i]), rows[i][0], rows[i][-1]))[:size]]


@pytest.mark.parametrize("spread, size", [(8.0, 300), (0.01, 300), (8.0, 1), (8.0, 702)])
def test_subset_sums_are_exact(spark, monkeypatch, spread, size):
    monkeypatch.setattr(draws, "SPREAD", spread)  # a narrow histogram puts thresholds into its open ends
    rows = [r for r in population() if r[0] is not None and r[3] is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.draw: r.s for r in draws.exact_subset_sums(df, F.col("k"), F.col("v"), size, len(rows), 130, 3).collect()}
    want = [sum(r[3] for r in smallest(rows, s, size)) for s in draws.salts(130, 3)]
    assert np.allclose([got[i] for i in range(130)], want, rtol=1e-12)


def test_bottom_samples(spark):
    rows = [r for r in population() if r[0] is not None and r[1] is not None and r[3] is not None]
    got = draws.bottom_samples(spark.createDataFrame(population(), SCHEMA).where("k is not null").repartition(4), F.col("k"), F.col("g"), F.col("c"), F.col("v"), [4, 30, 400], 3, 9).collect()
    found = {}
    for r in got:
        found.setdefault((r.grp, r["size"], r.rep), []).append((r.payload, r.v))
    salt = draws.salts(9, 9)
    assert set(found) == {(g, s, r) for g in "ab" for s in (4, 30) for r in range(3)} | {(g, 400, r) for g in "ab" if sum(x[1] == g for x in rows) >= 400 for r in range(3)}
    for (g, size, rep), values in found.items():
        want = smallest([r for r in rows if r[1] == g], salt[[4, 30, 400].index(size) * 3 + rep], size)
        assert sorted(values) == sorted((r[2], r[3]) for r in want)


def test_permutation_of_odd_rows(spark):
    df = spark.createDataFrame(population(), SCHEMA)
    found = draws.permutation_test(df, F.col("k"), F.col("g") == "a", F.col("v"), draws=200).first()
    assert found.n_a + found.n_b == 704 and 0 < found.p <= 1
    shifted = draws.permutation_test(df, F.col("k"), F.col("g") == "a", F.col("v") + 5 * (F.col("g") == "a").cast("int"), draws=200).first()
    assert shifted.p == pytest.approx(1 / 201)
    one = draws.permutation_test(df.where("g = 'a'"), F.col("k"), F.col("g") == "a", F.col("v"), draws=20).first()
    assert one.p is None and one.n_b == 0


def test_contexts_add_up_to_one(spark):
    words = ["x", "y", "z", "unknown"]
    every = [w for triple in itertools.product(words, repeat=3) for w in triple]
    docs = [(1, "en", True, ["x", "y", "x", "z", "y", "x", "y"]), (2, "en", True, ["y"]), (3, "en", False, every), (6, "en", False, []), (7, "de", True, ["x"]), (8, "de", False, ["x", "y"])]
    docs += [(100 + n, "en", False, list(p)) for n, p in enumerate(itertools.product(words, repeat=3))]
    df = spark.createDataFrame(docs, "doc_id int, lang string, ref boolean, t array<string>")
    counts = backoff.padded_trigrams(df, ["doc_id", "lang", "ref"], "t")
    model = backoff.trigram_model(counts, ["lang"], "ref").where("lang = 'en'").collect()
    sums = {}
    for r in model:
        sums[r.a, r.b] = sums.get((r.a, r.b), 0.0) + r.p
    assert len(sums) == 21 and all(abs(s - 1) < 1e-12 for s in sums.values())
    got = {r.doc_id: r for r in backoff.trigram_perplexity(df, "doc_id", ["lang"], "t", "ref").collect()}
    assert 6 not in got and got[3].n == len(every)
    # German: one word seen once, so p(x) after the start is (1 - .75) / 1.
    assert got[7].ppl_trigram == pytest.approx(4.0)


def test_column_hash_equals_the_array_hash(spark):
    keys = [0, 1, -1, 2**31, 2**32 + 5, -(2**40), 2**63 - 1]
    rows = spark.createDataFrame([(k, d) for k in [*keys, None] for d in range(4)], "k long, d int")
    got = {(r[0], r[1]): r[2] for r in rows.select("k", "d", draws.draw_column(F.col("k"), F.col("d"), 4, 6)).collect()}
    want = draws.mixed(draws.key_hash(np.array(keys))[:, None] ^ draws.salts(4, 6)[None, :])
    assert all(got[k, d] == want[i, d] for i, k in enumerate(keys) for d in range(4))
    assert all(got[None, d] == got[0, d] for d in range(4))
