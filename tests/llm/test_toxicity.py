import random

import numpy as np
import pytest

from corpusgauge.llm import toxicity as X
from corpusgauge.llm.queries import QUERIES
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 63, 64, 65, 96, 200, 1000):
        starts = X.window_starts(n)
        covered = {w for s in starts for w in range(s, min(n, s + X.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    windows = [[b"aa", b"bb", b"cc"], [b"bb"], [b"cc", b"dd", b"aa", b"aa"]]
    p = {"word": 0.5 * rng.standard_normal((4, X.WORD_DIM)), "gram": 0.5 * rng.standard_normal((3, X.GRAM_DIM))}
    for side in "fb":
        p |= {"w" + side: 0.5 * rng.standard_normal((X.WORD_DIM + X.GRAM_DIM, 3 * X.HIDDEN)), "u" + side: 0.5 * rng.standard_normal((X.HIDDEN, 3 * X.HIDDEN))}
        p["c" + side] = np.zeros(3 * X.HIDDEN)
    p |= {"att": rng.standard_normal(2 * X.HIDDEN), "out": rng.standard_normal(2 * X.HIDDEN), "bias": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = X.Model({b"aa": 1, b"bb": 2, b"cc": 3}, {"^aa": 0, "bb$": 1, "^cc": 2}, p)
    target = np.array([1, 0, 1], np.float32)

    def loss():
        z = X.Scorer(model).logits(windows).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - target * z))

    before = loss()
    for _ in range(60):
        X._train(model, windows, target, 0.01, np.random.default_rng(1), {})
    assert loss() < 0.5 * before


def labelled(rng, word):
    """Windows of which every other one holds the word somewhere."""
    out = []
    for i in range(1200):
        words = prose(rng, X.WINDOW, 200)
        if i % 2:
            words[rng.randrange(len(words))] = word()
        out.append((i, i % 2, [w.encode() for w in words]))
    return out


def test_a_text_scores_the_largest_window(spark):
    rng = random.Random(1)
    model = X.train(labelled(rng, lambda: "idiot"))
    scorer = X.Scorer(model)
    long = prose(rng, 700, 200)
    long[650] = "idiot"
    found = scorer.texts([" ".join(long), " ".join(prose(rng, 700, 200)), "", None])
    words = X.words_of(" ".join(long))
    parts = scorer.logits([words[s : s + X.WINDOW] for s in X.window_starts(len(words))])
    assert found[0] == pytest.approx(parts.max(), abs=1e-4)
    assert found[0] > found[1] and found[2] == found[3]


def test_unseen_spellings_carry_their_characters():
    rng = random.Random(3)
    bad = lambda: "zqx" + "".join(rng.choices("abcdef", k=3))
    scorer = X.Scorer(X.train(labelled(rng, bad)))
    clean = [w.encode() for w in prose(rng, 40, 200)]
    assert scorer.logits([[*clean, b"zqxghi"]])[0] > scorer.logits([[*clean, b"w17"]])[0] + 1


def test_held_out_accuracy(spark):
    import duckdb

    rows = QUERIES["op2_toxicity"].run(spark, SF).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in neg] for a in pos])
    assert auc > 0.7


def test_labels_of_one_kind_and_odd_rows(spark, odd, nothing, odd_rows):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(odd, labels)
    assert model == 0.0
    assert X.score(odd.drop("score"), model).count() == len(odd_rows)
    assert X.fit(odd, labels.where("1 = 0")) == 0.5
    assert X.score(nothing, model).count() == 0
